"""Counts, shares and rankings over record sets: one pass over the input each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.functions.stats import share, wilson
from citelake.functions.text import keywords, names, trimmed
from citelake.query import Query

SEPARATOR = " × "


def top(records: DataFrame, by: str = "source", n: int = 10) -> DataFrame:
    """(value, n): the n most frequent sources or authors; ties in byte order."""
    if by not in ("source", "author"):
        raise BadInput("by must be source or author")
    value = F.explode(names(F.col("authors"))) if by == "author" else trimmed(F.col("publication"))
    counted = records.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").cast("int").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(n)


def year_counts(records: DataFrame) -> DataFrame:
    """(year, n) for every year from the first to the last, 0 where there is no record."""
    counted = records.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))
    span = counted.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    years = span.select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(counted, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


def summary(records: DataFrame) -> DataFrame:
    """One row: counts, year span, sum and exact median of citations, top record, modal source.

    One scan counts the whole, each number of citations and each source at once (grouping sets, combined before the
    shuffle); the median weighs equal citations, so a value's rows never meet in one task.
    """
    cited = F.when(F.col("citations").isNotNull(), F.struct("citations", (-F.col("entry_number")).alias("o"), F.col("title").alias("t")))
    sets = records.groupingSets([[], ["citations"], ["publication"]], "citations", "publication").agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.min("year").alias("a"),
        F.max("year").alias("b"),
        F.count("doi").alias("d"),
        F.max(cited).alias("best"),
    )
    whole, value, source = F.col("g") == 3, (F.col("g") == 1) & F.col("citations").isNotNull(), (F.col("g") == 2) & F.col("publication").isNotNull()
    counted = sets.select(
        *(F.when(whole, F.col(c)).alias(c) for c in ("a", "b", "d", "best")), F.when(whole, F.col("n")).alias("n"),
        F.when(value, F.col("citations")).alias("c"), F.when(value, F.col("n")).otherwise(0).alias("w"),
        F.when(source, F.struct(F.col("n").alias("n"), F.col("publication").alias("p"))).alias("s"),
    )
    return counted.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n_records"),
        F.max("a").alias("year_min"),
        F.max("b").alias("year_max"),
        F.coalesce(F.max("d"), F.lit(0)).alias("n_with_doi"),
        F.coalesce(F.sum(F.col("c") * F.col("w")), F.lit(0)).cast("long").alias("citations_total"),
        F.max("best")["t"].alias("top_cited"),
        F.expr("percentile(c, 0.5, w)").alias("citations_median"),
        F.count("s").alias("n_sources"),
        F.max("s.n").alias("top_source_n"),
        F.min(F.when(F.col("s").isNotNull(), F.struct((-F.col("s.n")).alias("k"), F.col("s.p").alias("p"))))["p"].alias("top_source"),
    )


def trend(matches: DataFrame, years: Sequence[int], label: str) -> DataFrame:
    """(query, year, n): matches in each listed year; 0, not null, where there are none."""
    wanted = sorted(set(years))
    spark = matches.sparkSession
    listed = spark.createDataFrame([(y,) for y in wanted], "year int")
    counted = matches.where(F.col("year").isin(wanted)).groupBy("year").agg(F.count("*").alias("n"))
    return listed.join(counted, "year", "left").select(F.lit(label).alias("query"), "year", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def compare_topics(table: DataFrame, reference: Query, terms: Sequence[Query], years: Sequence[int], fields: Mapping[str | None, Column]) -> DataFrame:
    """The share of each term in the reference literature by year, and over the period.

    One scan counts the reference and every term by year with conditional counts; the years x terms
    result is then unpivoted. Terms aren't de-duplicated.
    """
    wanted = sorted(set(years))
    inside = reference.to_column(fields)
    hits = [F.count_if(t.to_column(fields)).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = table.where(F.col("year").isin(wanted) & inside).groupBy("year").agg(F.count("*").alias("ref"), *hits)
    listed = table.sparkSession.createDataFrame([(y,) for y in wanted], "year int")
    filled = listed.join(counted, "year", "left").na.fill(0)
    entry = lambda kind, full, short, n: F.struct(F.lit(kind).alias("query_type"), F.lit(full).alias("query"), F.lit(short).alias("abridged_query"), n.cast("double").alias("n"))
    ref = reference.to_string()
    rows = [entry("reference", ref, ref, F.col("ref"))]
    rows += [entry("comparison", f"{ref} AND {t.to_string()}", t.to_string(), F.col(f"t{i}")) for i, t in enumerate(terms)]
    positions = filled.select("year", F.col("ref").cast("double").alias("reference_n"), F.posexplode(F.array(*rows)).alias("_topic", "r"))
    return shares(positions.select("_topic", "r.*", "year", "reference_n")).drop("_topic")


def shares(counts: DataFrame) -> DataFrame:
    """Adds comparison_percentage and average_comparison_percentage to counts of topics by year.

    The average is the ratio of sums over the years in which both counts are known; a year with
    reference 0 counts. It is null if there is no such year or the reference sums to 0.
    """
    topic = Window.partitionBy("_topic")
    known = F.col("n").isNotNull() & F.col("reference_n").isNotNull()
    over = lambda c: F.sum(F.when(known, F.col(c))).over(topic)
    return counts.select(
        "_topic", "query", "query_type", "abridged_query", "year", "n", "reference_n",
        share(F.col("n"), F.col("reference_n")).alias("comparison_percentage"),
        share(over("n"), over("reference_n")).alias("average_comparison_percentage"),
    )


def ordered_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.col("query_type") != "reference", F.desc_nulls_last("average_comparison_percentage"), "query", "year")


def with_band(comparison: DataFrame) -> DataFrame:
    low, high = wilson(F.col("n"), F.col("reference_n"))
    return comparison.withColumn("low", low).withColumn("high", high)


def check_concepts(concepts: Mapping[str, Query], intersections: Sequence[Sequence[str]], abbreviations: Mapping[str, str] | None = None, separator: str = SEPARATOR) -> list[tuple[str, tuple[str, ...]]]:
    """(label, members) of every intersection; raises before any job if something doesn't fit."""
    short = dict(abbreviations or {})
    if not concepts or not all(isinstance(k, str) and k for k in concepts):
        raise BadInput("concepts need names")
    if unknown := [k for k in short if k not in concepts]:
        raise BadInput(f"abbreviations of unknown concepts: {', '.join(unknown)}")
    out, seen = [], set(concepts)
    for members in intersections:
        if len(members) < 2 or len(set(members)) != len(members):
            raise BadInput("an intersection has two or more different members")
        if unknown := [m for m in members if m not in concepts]:
            raise BadInput(f"unknown members: {', '.join(unknown)}")
        label = separator.join(short.get(m, m) for m in members)
        if label in seen:
            raise BadInput(f"the label {label!r} occurs twice")
        seen.add(label)
        out.append((label, tuple(members)))
    return out


def concept_sizes(table: DataFrame, concepts: Mapping[str, Query], intersections: Sequence[Sequence[str]], fields: Mapping[str | None, Column], abbreviations: Mapping[str, str] | None = None, separator: str = SEPARATOR) -> DataFrame:
    """(label, query, n, type, size, members): concepts, then intersections, all in one aggregate."""
    wanted = [(c, (c,), "concept") for c in concepts]
    wanted += [(label, members, "intersection") for label, members in check_concepts(concepts, intersections, abbreviations, separator)]
    tests = [reduce(lambda a, b: a & b, (concepts[m].to_column(fields) for m in members)) for _, members, _ in wanted]
    counted = table.agg(*(F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests)))
    rows = [
        F.struct(
            F.lit(label).alias("label"), F.lit(" AND ".join(concepts[m].to_string() for m in members)).alias("query"), F.col(f"c{i}").cast("double").alias("n"),
            F.lit(kind).alias("type"), F.lit(len(members)).alias("size"), F.lit("; ".join(members)).alias("members"),
        )
        for i, (label, members, kind) in enumerate(wanted)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def keyword_counts(table: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """(keyword, n) over rows of a delimited column, every occurrence counted."""
    return table.select(F.explode(keywords(F.col(column), separator)).alias("keyword")).where("keyword <> ''").groupBy("keyword").agg(F.count("*").alias("n"))


def all_or_nothing_sum(column: str, empty: float | None = 0.0) -> Column:
    """The sum, null if any value is null; `empty` for no rows at all."""
    return F.when(F.count("*") == 0, F.lit(empty).cast("double")).when(F.count("*") == F.count(column), F.sum(column).cast("double"))
