"""What charts of results need: reduced tables (as DataFrames) and axis numbers (small, on the driver).

Drawing is left to whichever plotting tool takes the tables.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.operators.analyse import with_band


def _dropping(before: DataFrame, kept: DataFrame, why: str) -> DataFrame:
    if gone := before.count() - kept.count():
        warnings.warn(f"{gone} rows {why} are left out", stacklevel=3)
    return kept


def share_lines(comparison: DataFrame) -> DataFrame:
    """Rows of a share chart: known shares with their band, each topic's total, the last year marked."""
    known = comparison.where("query_type = 'comparison'")
    known = _dropping(known, known.where("comparison_percentage IS NOT NULL"), "without a share")
    total = F.sum("n").over(Window.partitionBy("abridged_query"))
    rows = with_band(known).withColumn("topic_total", total)
    last = rows.agg(F.max("year").alias("_last")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")  # one row
    marked = rows.withColumn("last_year", F.col("year") == F.col("_last")).drop("_one", "_last")
    return marked.orderBy(F.desc_nulls_last("average_comparison_percentage"), "abridged_query", "year")


def positive_sizes(sizes: DataFrame) -> DataFrame:
    """Rows that a log axis can show, in order of size."""
    return _dropping(sizes, sizes.where("n > 0"), "without a positive count").orderBy("n", "label")


def spread_labels(ends: DataFrame, value: str, gap: float) -> DataFrame:
    """Adds label_at: values moved up just as far as keeps neighbours `gap` apart, in their order.

    A running maximum of value - gap x rank is the same as moving one label after the other.
    """
    order = Window.orderBy(value)  # a row for each label of a figure
    rank = F.row_number().over(order) - 1
    ranked = ends.withColumn("_rank", rank)
    base = F.max(F.col(value) - gap * F.col("_rank")).over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("label_at", base + gap * F.col("_rank")).drop("_rank")


def log_limits(counts: Sequence[float], margin: float = 0.1) -> tuple[float, float]:
    """The limits of a log axis: the decades that the counts span, and a share of them (one at least) on either side."""
    if not counts or min(counts) <= 0:
        raise BadInput("a log axis needs positive counts")
    low, high = math.log10(min(counts)), math.log10(max(counts))
    aside = margin * max(1.0, high - low)
    return 10 ** (low - aside), 10 ** (high + aside)


def log_breaks(low: float, high: float) -> list[float]:
    """Powers of ten in the limits; with fewer than four, three times each power as well."""
    powers = [10.0**e for e in range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1)]
    inside = lambda values: [v for v in values if low <= v <= high]
    return found if len(found := inside(powers)) >= 4 else inside(sorted([*powers, *(3 * p for p in powers)]))


def year_breaks(years: Sequence[int], most: int = 12, wanted: int = 5) -> list[int]:
    """All years if they are few, else whole years at a round step."""
    found = sorted(set(years))
    if len(found) <= most:
        return found
    span = found[-1] - found[0]
    step = min((s * 10**k for k in range(5) for s in (1, 2, 5)), key=lambda s: abs(span / s - wanted))
    start = found[0] // step * step
    return list(range(start, found[-1] + step, step))


def upper_limit(values: Sequence[float | None]) -> float:
    """The next multiple of 5 percent above all values, 100 at most."""
    known = [v for v in values if v is not None]
    return min(100.0, math.ceil(max(known, default=0) / 5) * 5.0)


def free_quadrant(points: Sequence[tuple[float, float]]) -> tuple[str, str]:
    """The quadrant of the points' own box that holds fewest of them, for a legend; of equals, the upper, then the left one."""
    known = [p for p in points if math.isfinite(p[0]) and math.isfinite(p[1])]
    mid = [(min(v) + max(v)) / 2 if v else 0.0 for v in (list(c) for c in zip(*known, strict=True))] or [0.0, 0.0]
    held = Counter(("upper" if y > mid[1] else "lower", "right" if x > mid[0] else "left") for x, y in known)
    return min(product(("upper", "lower"), ("left", "right")), key=lambda q: held[q])
