"""Boolean queries: a tree that gives both the service's query string and a Spark predicate.

Without the remote service, a term matches where its text occurs in a field, ignoring case.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.errors import BadInput

OPERATORS = ("AND", "OR", "AND NOT")
#: Fixed field tags of the service.
FIELD_TAGS = ("TITLE", "TITLE-ABS-KEY", "TITLE-ABS-KEY-AUTH", "ABS", "KEY", "AUTH", "AUTHKEY", "AFFIL", "AFFILORG", "SRCTITLE", "DOI", "ALL")
TAGGED = re.compile(r"^[A-Z][A-Z-]*\(")


def checked_field(field: str | None) -> str | None:
    if field is None:
        return None
    if not isinstance(field, str) or not re.fullmatch(r"[A-Z-]+", tag := field.strip(" \t\r\n").upper()):
        raise BadInput("a field tag has letters and hyphens only, such as TITLE-ABS-KEY")
    return tag


def wrap(text: str, field: str | None) -> str:
    return f"{field}({text})" if field else text


def wrap_unless_tagged(text: str, field: str | None) -> str:
    return text if TAGGED.match(text) else wrap(text, field)


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None

    def to_string(self) -> str:
        return wrap(self.text, self.field)

    def to_column(self, fields: Mapping[str | None, Column]) -> Column:
        return F.contains(F.lower(fields[self.field]), F.lit(self.text.lower()))


@dataclass(frozen=True)
class Joined:
    """Terms joined by one operator, without brackets, from left to right."""

    operator: str
    parts: tuple[Term | Joined, ...]

    def to_string(self) -> str:
        return f" {self.operator} ".join(p.to_string() for p in self.parts)

    def to_column(self, fields: Mapping[str | None, Column]) -> Column:
        join = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "AND NOT": lambda a, b: a & ~b}[self.operator]
        return reduce(join, (p.to_column(fields) for p in self.parts))


Query = Term | Joined


def query(*terms: str, operator: str = "AND", field: str | None = None) -> Query:
    if operator not in OPERATORS:
        raise BadInput(f"the operator must be one of {', '.join(OPERATORS)}")
    if not terms or not all(isinstance(t, str) and t.strip() for t in terms):
        raise BadInput("terms must be non-blank strings")
    tag = checked_field(field)
    made = tuple(Term(t, tag) for t in terms)
    return made[0] if len(made) == 1 else Joined(operator, made)
