"""Column functions over identifiers, names and field text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n"
#: Fixed patterns of DOI prefixes, removed once each in this order.
RESOLVER = r"(?i)^\s*(https?://)?(www\.)?(dx\.)?doi\.org/"
SCHEME = r"(?i)^\s*doi:\s*"
#: Fixed replacements of characters that BibTeX reserves.
BIBTEX = {
    "\\": r"\textbackslash{}",
    "&": r"\&",
    "%": r"\%",
    "$": r"\$",
    "#": r"\#",
    "_": r"\_",
    "{": r"\{",
    "}": r"\}",
    "~": r"\textasciitilde{}",
    "^": r"\textasciicircum{}",
}


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_doi(c: Column) -> Column:
    """A bare DOI; null for none. A resolver is removed, then a scheme, each at most once."""
    bare = F.regexp_replace(F.regexp_replace(trimmed(c), RESOLVER, ""), SCHEME, "")
    return blank_to_null(trimmed(bare))


def folded(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def plain_text(c: Column) -> Column:
    """Text without markup, with plain hyphens and single spaces."""
    return folded(F.regexp_replace(F.translate(c, "\u2010\u2011", "--"), "<[^>]*>", ""))


def file_safe(c: Column) -> Column:
    """A name for files: every run of other than ASCII letters and digits is one underscore. Different texts may agree."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")


def html_escaped(c: Column) -> Column:
    """Text that HTML shows as it is, in elements and in quoted attributes."""
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    return c


def without_ansi(c: Column) -> Column:
    """Text without the terminal's colour and cursor codes."""
    return F.regexp_replace(c, "\u001b\\[[0-9;?]*[A-Za-z]", "")


def names(c: Column) -> Column:
    """The non-blank names of a "; " list, trimmed; an empty array for none."""
    parts = F.filter(F.transform(F.split(c, "; "), trimmed), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def keywords(c: Column, separator: str = ";") -> Column:
    """Keywords of a list, trimmed, blanks kept except one at the very end; an empty array for null."""
    parts = F.transform(F.split(c, F.lit(separator)), trimmed)
    last_blank = F.endswith(c, F.lit(separator)) | (c == "")
    kept = F.when(last_blank, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(kept, F.array().cast("array<string>"))


def bibtex_escaped(c: Column) -> Column:
    """One pass over the characters, so what a replacement brings in isn't replaced again."""
    reserved = F.create_map(*(F.lit(x) for pair in BIBTEX.items() for x in pair))
    marked = F.regexp_replace(c, r"([\\&%$#_{}~^])", "\x01$1\x01")
    pieces = F.split(marked, "\x01")
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(reserved[x], x)), "")


def year_of(c: Column) -> Column:
    """The leading four digits as a year; null without them."""
    return F.regexp_extract(c, r"^([0-9]{4})", 1).try_cast("int")


def whole_number(c: Column) -> Column:
    """An integer, with any fraction cut off; null for what isn't a number."""
    return c.try_cast("double").try_cast("int")


def identifier(c: Column) -> Column:
    return F.regexp_replace(c, "^SCOPUS_ID:", "")


def citation_base(authors: Column, year: Column, record_id: Column) -> Column:
    """Surname and year; failing a surname the record id; failing that a constant."""
    first = F.try_element_at(F.split(F.try_element_at(names(authors), F.lit(1)), "[ ,]"), F.lit(1))
    surname = F.coalesce(F.lower(F.regexp_replace(first, "[^A-Za-z0-9]", "")), F.lit(""))
    plain = F.coalesce(F.regexp_replace(record_id, "[^A-Za-z0-9]", ""), F.lit(""))
    dated = F.concat(surname, F.coalesce(year.cast("string"), F.lit("")))
    return F.when(surname != "", dated).when(plain != "", F.concat(F.lit("scopus"), plain)).otherwise("scopusrecord")


def suffixed(base: Column, repeat: Column) -> Column:
    """base for repeat 0, base + a..z for 1..26, then base + the number."""
    letter = F.char(F.lit(96) + repeat)
    return F.when(repeat == 0, base).when(repeat <= 26, F.concat(base, letter)).otherwise(F.concat(base, repeat.cast("string")))
