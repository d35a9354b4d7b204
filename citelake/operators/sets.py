"""Operators on record sets whose row order matters: bind, merge, de-duplicate, number, compare.

Order is the column entry_number (1..n). Nothing here sorts a whole table in one task: numbers are
prefix sums of counts by block, and first occurrences are windows over their own key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.text import clean_doi

BLOCK = 1 << 16


def renumber(df: DataFrame, position: str = "entry_number", out: str = "entry_number", block: int = BLOCK) -> DataFrame:
    """out = 1..n in the order of the distinct whole numbers in `position`.

    Rows are ranked inside blocks of `block` positions and offset by the counts of earlier blocks;
    the table of blocks is smaller than the data by that factor.
    """
    inside = df.withColumn("_block", F.floor(F.col(position) / block))
    counts = inside.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(position))
    ranked = inside.withColumn("_rank", rank).join(offsets, "_block")
    return ranked.withColumn(out, (F.col("_rank") + F.col("_offset")).cast("int")).drop("_block", "_rank", "_offset")


def bind(sets: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sets in order, columns unioned by name, renumbered."""
    return renumber(_placed(sets))


def _placed(sets: Sequence[DataFrame]) -> DataFrame:
    """All rows with entry_numbers that follow on from set to set, with gaps where a set has any."""
    if not sets:
        raise ValueError("nothing to bind")
    marked = [s.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    sizes = every.groupBy("_set").agg(F.max("entry_number").alias("_n"))
    before = Window.orderBy("_set").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_set", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    moved = every.join(F.broadcast(offsets), "_set")  # a row for each set
    return moved.withColumn("entry_number", F.col("entry_number") + F.col("_offset")).drop("_set", "_offset")


def record_key() -> Column:
    """Identity of a record: its id, failing that its DOI as it stands, failing that itself."""
    by_id = F.concat(F.lit("id:"), F.col("record_id"))
    by_doi = F.concat(F.lit("doi:"), F.lower("doi"))
    return F.coalesce(by_id, by_doi, F.concat(F.lit("row:"), F.col("entry_number").cast("string")))


def first_of(df: DataFrame, key: Column, order: str = "entry_number") -> DataFrame:
    """The first row of each key, in one shuffle: minima of whole rows are pre-aggregated, so a hot key costs no sort."""
    rest = [c for c in df.columns if c != order]
    firsts = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(order, *rest), order).alias("r"))
    return firsts.select(*(F.col(f"r.`{c}`") for c in df.columns))


def dedupe(records: DataFrame) -> DataFrame:
    return renumber(first_of(records, record_key()))


def combine(sets: Sequence[DataFrame], remove_duplicates: bool = False) -> DataFrame:
    """All rows of all sets, of records that are the same the first; numbered once, at the end."""
    placed = _placed(sets)
    return dedupe(placed) if remove_duplicates else renumber(placed)


def accounting(sets: Sequence[DataFrame], combined: DataFrame) -> dict[str, int]:
    n_in = sum(s.count() for s in sets)
    n_out = combined.count()
    return {"n_in": n_in, "n_out": n_out, "n_removed": n_in - n_out}


def accounting_table(sets: Sequence[DataFrame], combined: DataFrame) -> DataFrame:
    """One row: n_in, n_out and n_removed, without a count on the driver."""
    counts = [s.agg(F.count("*").alias("n")).withColumn("kind", F.lit("in")) for s in sets] + [combined.agg(F.count("*").alias("n")).withColumn("kind", F.lit("out"))]
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    return reduce(DataFrame.unionByName, counts).agg(of("in").alias("n_in"), of("out").alias("n_out"), (of("in") - of("out")).alias("n_removed"))


def distinct_dois(records: DataFrame, remove_duplicates: bool = True) -> DataFrame:
    """(entry_number, doi): clean DOIs in input order; of equal ones ignoring case, the first."""
    found = records.select("entry_number", clean_doi(F.col("doi")).alias("doi")).where("doi IS NOT NULL")
    return first_of(found, F.lower("doi")) if remove_duplicates else found


def doi_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doi, status): added, removed or unchanged, by DOI ignoring case; unchanged ones as in new."""
    a, b = (distinct_dois(x).select(F.lower("doi").alias("k"), "doi") for x in (old, new))
    both = a.withColumnRenamed("doi", "was").join(b.withColumnRenamed("doi", "now"), "k", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("unchanged")
    return both.select(F.coalesce("now", "was").alias("doi"), status.alias("status"))


STATUS_ORDER = ("added", "removed", "unchanged")


def ordered_diff(diff: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return diff.orderBy(rank, "doi")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER))


def capped_per_year(records: DataFrame, cap: int, years: tuple[int, int] | None = None) -> DataFrame:
    """The first `cap` records of each year, renumbered; a feature of demonstrations.

    years: the span asked for. What of it lies outside the records' own years is cut off; a span wholly outside becomes the nearest year.
    """
    if years:
        own = records.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
        clamp = lambda y: F.least(F.greatest(F.lit(y), "_a"), "_b")
        records = records.join(F.broadcast(own)).where(F.col("year").between(clamp(years[0]), clamp(years[1]))).drop("_a", "_b")  # one row
    rank = F.row_number().over(Window.partitionBy("year").orderBy("entry_number"))
    return renumber(records.withColumn("_k", rank).where(F.col("_k") <= cap).drop("_k"))
