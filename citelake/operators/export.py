"""Records as BibTeX, RIS and a tagged frame: one text column a record, so any sink can write it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.text import bibtex_escaped, citation_base, folded, names, suffixed
from citelake.operators.sets import BLOCK


def citation_keys(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """records with a column key: the first use of a base stays, repeats get suffixes in row order.

    Repeats are ranked inside blocks of entry_number and offset by the base's counts in earlier blocks,
    so a base that many records share (those without author and id) is not ranked in one task.
    """
    based = records.withColumn("_base", citation_base(F.col("authors"), F.col("year"), F.col("record_id"))).withColumn("_block", F.floor(F.col("entry_number") / block))
    counts = based.groupBy("_base", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_base").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_base", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_base", "_block").orderBy("entry_number")) - 1
    ranked = based.withColumn("_rank", rank).join(offsets, ["_base", "_block"])
    return ranked.withColumn("key", suffixed(F.col("_base"), F.col("_rank") + F.col("_offset"))).select(*records.columns, "key")


def _given(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def as_bibtex(records: DataFrame) -> DataFrame:
    """(entry_number, key, entry)."""
    text = lambda c: bibtex_escaped(folded(c.cast("string")))
    author = F.array_join(F.transform(names(F.col("authors")), text), " and ")
    fields = [("author", F.size(names(F.col("authors"))) > 0, author)]
    fields += [(name, _given(F.col(c)), text(F.col(c))) for name, c in (("title", "title"), ("journal", "publication"), ("year", "year"), ("doi", "doi"))]
    fields.append(("note", F.col("record_id").isNotNull(), bibtex_escaped(F.concat(F.lit("Scopus ID: "), "record_id"))))
    lines = F.array_compact(F.array(*(F.when(there, F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))) for name, there, value in fields)))
    body = F.array_join(F.concat(F.array(F.concat(F.lit("@article{"), "key", F.lit(","))), lines, F.array(F.lit("}"))), "\n")
    return citation_keys(records).select("entry_number", "key", body.alias("entry"))


def as_ris(records: DataFrame) -> DataFrame:
    """(entry_number, entry)."""
    line = lambda tag, c: F.when(_given(c), F.concat(F.lit(f"{tag}  - "), folded(c.cast("string"))))
    authors = F.transform(names(F.col("authors")), lambda a: F.concat(F.lit("AU  - "), folded(a)))
    number = F.when(F.col("record_id").isNotNull(), F.concat(F.lit("N1  - Scopus ID: "), folded(F.col("record_id"))))
    parts = F.concat(
        F.array(F.lit("TY  - JOUR"), line("TI", F.col("title"))), authors,
        F.array(line("PY", F.col("year")), line("JO", F.col("publication")), line("DO", F.col("doi")), number, F.lit("ER  - ")),
    )
    return records.select("entry_number", F.array_join(F.array_compact(parts), "\n").alias("entry"))


def as_tagged(records: DataFrame, database: str = "SCOPUS") -> DataFrame:
    """The tagged columns of science-mapping tools; names upper-cased, identifiers as they are."""
    return records.select(
        "entry_number",
        F.upper("authors").alias("AU"), F.upper("title").alias("TI"), F.upper("publication").alias("SO"), F.col("doi").alias("DI"),
        F.col("year").alias("PY"), F.col("citations").alias("TC"), F.col("record_id").alias("UT"), F.lit(database).alias("DB"),
    )
