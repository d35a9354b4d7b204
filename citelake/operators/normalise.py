"""Nested JSON entries as records: a fixed schema over whatever fields an entry happens to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import identifier, whole_number, year_of

#: Fixed fields of an entry.
FIELDS = ("dc:identifier", "prism:doi", "dc:title", "dc:creator", "prism:coverDate", "prism:publicationName", "citedby-count", "authkeywords", "error")


def scalar(entry: Column, field: str) -> Column:
    """A field as text: a scalar as it is, an array of scalars joined by "; ", all else null.

    A null element makes an array non-scalar; an empty array is null.
    """
    path = f"$['{field}']"
    value = F.try_variant_get(entry, path, "variant")
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(entry, path, "array<string>")
    flat = ~kind.rlike("OBJECT|ARRAY<ARRAY|ARRAY<VOID|VARIANT") & (F.size(items) > 0) & ~F.exists(items, lambda x: x.isNull())
    joined = F.when(flat, F.array_join(items, "; "))
    return F.when(kind.startswith("ARRAY"), joined).when(~kind.startswith("OBJECT") & (kind != "VOID"), F.try_variant_get(entry, path, "string"))


def drop_sentinel(entries: DataFrame) -> DataFrame:
    """Without the lone error entry by which the service says that nothing was found.

    entries: (page, position, entry variant). A record that has an error field besides an id stays.
    """
    lone = entries.groupBy("page").agg(F.count("*").alias("_n"))
    missing = lambda f: F.try_variant_get("entry", f"$['{f}']", "string").isNull()
    empty = ~missing("error") & missing("dc:identifier") & missing("prism:doi")
    return entries.join(lone, "page").where(~((F.col("_n") == 1) & F.coalesce(empty, F.lit(False)))).drop("_n")


def entries_to_records(entries: DataFrame, query: str, view: str = "STANDARD", position: str = "position") -> DataFrame:
    """Records of (position, entry as JSON text or variant); invalid JSON raises in the task."""
    parsed = F.parse_json("entry") if dict(entries.dtypes)["entry"] == "string" else F.col("entry")
    rows = entries.select(F.col(position).alias("entry_number"), parsed.alias("entry"))
    field = lambda name: scalar(F.col("entry"), name)
    columns = [
        F.col("entry_number").cast("int").alias("entry_number"), identifier(field("dc:identifier")).alias("record_id"), field("prism:doi").alias("doi"),
        field("dc:title").alias("title"), field("dc:creator").alias("authors"), year_of(field("prism:coverDate")).alias("year"), field("prism:coverDate").alias("date"),
        field("prism:publicationName").alias("publication"), whole_number(field("citedby-count")).alias("citations"), F.lit(query).alias("query"),
    ]
    if view == "COMPLETE":
        columns.append(field("authkeywords").alias("authkeywords"))
    return rows.select(*columns)
