"""Search plans: a query split into cells, checked before anything is requested."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.query import Query, checked_field, wrap

#: Fixed page ceilings of the service's views.
PAGE_CEILING = {"STANDARD": 200, "COMPLETE": 25}
YEAR_RANGE = (1700, 2200)


def checked_query(query: str | Query) -> str:
    text = query if isinstance(query, str) else query.to_string()
    if not text.strip():
        raise BadInput("the query is blank")
    return text


def checked_years(years: Iterable[int] | None) -> tuple[int, ...] | None:
    if years is None:
        return None
    found = list(years)
    if not found or any(isinstance(y, bool) or not isinstance(y, (int, float)) or y != int(y) or not YEAR_RANGE[0] <= y <= YEAR_RANGE[1] for y in found):
        raise BadInput("years are whole numbers from 1700 to 2200")
    return tuple(sorted({int(y) for y in found}))


def checked_view(view: str) -> str:
    if view not in PAGE_CEILING:
        raise BadInput(f"view must be one of {', '.join(PAGE_CEILING)}")
    return view


def checked_page_size(size: int | None, view: str) -> int:
    ceiling = PAGE_CEILING[view]
    if size is None:
        return ceiling
    if isinstance(size, bool) or size != int(size) or not 1 <= size <= ceiling:
        raise BadInput(f"a page holds 1 to {ceiling} records in the view {view}")
    return int(size)


def checked_limit(limit: float | None) -> int | None:
    """A positive whole number of records; None and infinity mean all."""
    if limit is None or limit == float("inf"):
        return None
    if isinstance(limit, bool) or limit != limit or limit < 1 or limit != int(limit):
        raise BadInput("a limit is a positive whole number")
    return int(limit)


def date_limit(years: tuple[int, ...] | None) -> str | None:
    if not years:
        return None
    return str(years[0]) if len(years) == 1 else f"{min(years)}-{max(years)}"


@dataclass(frozen=True)
class Cell:
    cell: int
    query: str
    date: str | None
    year: int | None
    view: str
    page_size: int


@dataclass(frozen=True)
class SearchPlan:
    base_query: str
    years: tuple[int, ...] | None = None
    field: str | None = None
    view: str = "STANDARD"
    page_size: int = 200
    partition: str = "none"

    @classmethod
    def make(cls, query: str | Query, years: Iterable[int] | None = None, field: str | None = None, view: str = "STANDARD", page_size: int | None = None, partition: str = "none") -> SearchPlan:
        text, wanted, view = checked_query(query), checked_years(years), checked_view(view)
        if partition not in ("none", "year"):
            raise BadInput("partition must be none or year")
        if partition == "year" and not wanted:
            raise BadInput("a plan by year needs years")
        return cls(text, wanted, checked_field(field), view, checked_page_size(page_size, view), partition)

    @property
    def wrapped(self) -> str:
        return wrap(self.base_query, self.field)

    def cells(self) -> list[Cell]:
        if self.partition == "year":
            return [Cell(i, self.wrapped, str(y), y, self.view, self.page_size) for i, y in enumerate(self.years, 1)]
        return [Cell(1, self.wrapped, date_limit(self.years), None, self.view, self.page_size)]

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "cell int, query string, date string, year int, view string, page_size int"
        return spark.createDataFrame([(c.cell, c.query, c.date, c.year, c.view, c.page_size) for c in self.cells()], schema)

    def predicate(self, timestamp: Column) -> Column:
        """The year limit as half-open ranges, which reach the Parquet scan."""
        if not self.years:
            return F.lit(True)
        low, high = self.years[0], self.years[-1]
        start = lambda y: F.lit(f"{y:04d}-01-01").cast("timestamp_ntz")
        return (timestamp >= start(low)) & (timestamp < start(high + 1))

    def to_code(self) -> str:
        """Python that makes an equal plan; it never holds a credential."""
        given = {"query": self.base_query, "years": years_code(self.years), "field": self.field, "view": self.view, "page_size": self.page_size, "partition": self.partition}
        lines = [f"    {k}={v if k == 'years' else repr(v)}," for k, v in given.items() if v is not None]
        return "\n".join(["from citelake.plans.search import SearchPlan", "", "plan = SearchPlan.make(", *lines, ")"])


def years_code(years: tuple[int, ...] | None) -> str | None:
    if not years:
        return None
    if len(years) > 1 and years == tuple(range(years[0], years[-1] + 1)):
        return f"range({years[0]}, {years[-1] + 1})"
    return repr(list(years))


def years_of_limits(limits: Iterable[str | None]) -> str | None:
    """The span of years named in date limits, such as "2015 to 2020"."""
    found = [int(y) for limit in limits if limit for y in re.findall(r"[0-9]{4}", limit)]
    if not found:
        return None
    return str(min(found)) if min(found) == max(found) else f"{min(found)} to {max(found)}"


def terms_of(text: str) -> list[str]:
    """The distinct non-blank terms of a comma-separated list, in order."""
    return list(dict.fromkeys(t for t in (p.strip() for p in text.split(",")) if t))


def requests_needed(total: int | None, limit: int | None, page_size: int, ceiling: int) -> int:
    wanted = min(x for x in (total, limit, ceiling) if x is not None)
    return max(1, -(-wanted // page_size))
