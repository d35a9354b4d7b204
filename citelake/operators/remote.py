"""Counts that the service gives: trends, topic comparisons and intersections without any records.

Each cell (a query and a date limit) is one request for one record, of which only the total is used.
Cells are dealt to `parallel` tasks, and the answers are written under cache_dir before anything reads
them twice. A cell whose answer has no total is null, with a warning; a refused request raises.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import BadInput, MissingCounts
from citelake.operators import analyse
from citelake.plans.search import checked_field, checked_query, checked_view, checked_years, date_limit
from citelake.query import wrap, wrap_unless_tagged
from citelake.sources.transport import Service, total_of


@dataclass(frozen=True)
class Counted:
    table: DataFrame
    remaining: int | None  # requests left of the quota, as far as the service said


def count_cells(spark: SparkSession, cells: Sequence[tuple[str, str | None]], service: Service, cache_dir: str, view: str = "STANDARD", parallel: int = 4) -> DataFrame:
    """(cell, query, date, n, remaining) of (query, date limit), numbered from 0; written once."""
    service.headers()  # a missing key fails here, not in every task
    checked_view(view)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [service.page(q, 1, start=0, date=d, view=view) for q, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, left = pa.array([total_of(r) for r, _ in found], pa.float64()), pa.array([q.remaining for _, q in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, left], names=["cell", "query", "date", "n", "remaining"])

    asked = spark.createDataFrame([(i, q, d) for i, (q, d) in enumerate(cells)], "cell int, query string, date string")
    path = f"{cache_dir.rstrip('/')}/counts-{uuid.uuid4().hex}"
    asked.repartition(parallel, "cell").mapInArrow(ask, "cell int, query string, date string, n double, remaining int").write.parquet(path)
    made = spark.read.parquet(path)
    if missing := made.where("n IS NULL").count():
        warnings.warn(f"{missing} of {len(cells)} counts have no total and are null", MissingCounts, stacklevel=3)
    return made


def _remaining(counted: DataFrame) -> int | None:
    return counted.agg(F.min("remaining").alias("r")).first()["r"]


def _wanted(years: Iterable[int] | None) -> tuple[int, ...]:
    found = checked_years(years)
    if not found:
        raise BadInput("years are needed")
    return found


def trend(spark: SparkSession, query: str, years: Iterable[int], service: Service, cache_dir: str, field: str | None = None, view: str = "STANDARD", parallel: int = 4) -> Counted:
    """(query, year, n) for each year, one request a year."""
    asked, wanted = wrap(checked_query(query), checked_field(field)), _wanted(years)
    made = count_cells(spark, [(asked, str(y)) for y in wanted], service, cache_dir, view, parallel)
    return Counted(made.select("query", F.col("date").cast("int").alias("year"), "n"), _remaining(made))


def compare_topics(
    spark: SparkSession, reference: str, terms: Sequence[str], years: Iterable[int], service: Service, cache_dir: str, field: str | None = None, view: str = "STANDARD", parallel: int = 4
) -> Counted:
    """The comparison of analyse.compare_topics from the service's counts: (1 + terms) x years requests."""
    if isinstance(terms, str) or not terms or not all(isinstance(t, str) and t.strip() for t in terms):
        raise BadInput("terms must be non-blank strings")
    tag, wanted = checked_field(field), _wanted(years)
    base = wrap(checked_query(reference), tag)
    topics = [("reference", base, reference), *(("comparison", f"{base} AND {wrap(t, tag)}", t) for t in terms)]
    made = count_cells(spark, [(q, str(y)) for _, q, _ in topics for y in wanted], service, cache_dir, view, parallel)
    listed = [(i * len(wanted) + k, i, kind, short, y) for i, (kind, _, short) in enumerate(topics) for k, y in enumerate(wanted)]
    named = spark.createDataFrame(listed, "cell int, _topic int, query_type string, abridged_query string, year int").join(made, "cell")
    base_n = named.where("_topic = 0").select("year", F.col("n").alias("reference_n"))
    rows = named.join(base_n, "year").select("_topic", "query", "query_type", "abridged_query", "year", "n", "reference_n")
    return Counted(analyse.ordered_comparison(analyse.shares(rows).drop("_topic")), _remaining(made))


def concept_sizes(
    spark: SparkSession, concepts: Mapping[str, str], intersections: Sequence[Sequence[str]], service: Service, cache_dir: str, years: Iterable[int] | None = None, field: str | None = None,
    abbreviations: Mapping[str, str] | None = None, separator: str = analyse.SEPARATOR, view: str = "STANDARD", parallel: int = 4,
) -> Counted:
    """(label, query, n, type, size, members) as analyse.concept_sizes has it, one request a row."""
    checked = analyse.check_concepts(concepts, intersections, abbreviations, separator)
    tag, date = checked_field(field), date_limit(checked_years(years))
    asked = {name: wrap_unless_tagged(checked_query(q), tag) for name, q in concepts.items()}
    rows = [(name, asked[name], "concept", (name,)) for name in concepts]
    rows += [(label, " AND ".join(f"({asked[m]})" for m in members), "intersection", members) for label, members in checked]
    made = count_cells(spark, [(q, date) for _, q, _, _ in rows], service, cache_dir, view, parallel)
    named = spark.createDataFrame([(i, label, kind, len(members), "; ".join(members)) for i, (label, _, kind, members) in enumerate(rows)], "cell int, label string, type string, size int, members string")
    return Counted(named.join(made, "cell").orderBy("cell").select("label", "query", "n", "type", "size", "members"), _remaining(made))
