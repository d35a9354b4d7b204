"""One line about each kind of result, for logs and notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.operators.sets import STATUS_ORDER
from citelake.plans.search import SearchPlan, years_of_limits


def trend_total(trend: DataFrame) -> float:
    """All counted records of a trend; unknown years count as none."""
    return trend.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()["n"]


def trend_line(trend: DataFrame) -> str:
    return f"trend over {trend.count()} years: {trend_total(trend):,.0f} records"


def comparison_line(comparison: DataFrame) -> str:
    row = comparison.agg(F.count_distinct(F.when(F.col("query_type") == "comparison", F.col("query"))).alias("t"), F.min("year").alias("a"), F.max("year").alias("b")).first()
    return f"comparison of {row['t']} terms with the reference, {row['a']} to {row['b']}"


def diff_line(diff: DataFrame) -> str:
    row = diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER)).first()
    return ", ".join(f"{row[s]} {s}" for s in STATUS_ORDER)


def sizes_line(sizes: DataFrame) -> str:
    row = sizes.agg(F.count_if(F.col("type") == "concept").alias("c"), F.count_if(F.col("type") == "intersection").alias("i")).first()
    return f"{row['c']} concepts and {row['i']} intersections"


def plan_line(plan: SearchPlan) -> str:
    cells = plan.cells()
    return f"plan of {len(cells)} cells for {plan.wrapped}, {years_of_limits(c.date for c in cells) or 'any year'}, {plan.page_size} a page"


def records_line(records: DataFrame) -> str:
    row = records.agg(F.count("*").alias("n"), F.count("doi").alias("d"), F.min("year").alias("a"), F.max("year").alias("b")).first()
    return f"{row['n']:,} records, {row['d']:,} with a DOI" + (f", {row['a']} to {row['b']}" if row["a"] is not None else "")


def abstracts_line(found: DataFrame) -> str:
    row = found.agg(F.count("*").alias("n"), F.count("abstract").alias("a"), F.count_if(F.col("status") != "ok").alias("f")).first()
    return f"{row['n']} identifiers, {row['a']} with an abstract, {row['f']} failed"
