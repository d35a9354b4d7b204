"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives every document posteriors over the domains (the
combinations of the label columns). Projected-gradient least squares then fits a nonnegative rate
for each document so that the expected tokens of each domain, sum of rate x tokens x posterior,
meet the targets. A domain's miss counts relative to its tokens, and steps carry momentum, so that few
are needed; the first rates are 1 and a small pull holds them there.
The gradient of a document depends on the corpus through one number a domain, so an iteration
is one distributed sum of a few numbers a domain. The driver keeps the history of those
numbers, and each task replays it on its own documents: no rates are written, joined or gathered
between iterations. Steps go on until no domain misses its target by more than TOLERANCE of all
tokens, or until they no longer come closer (targets out of reach of nonnegative rates); a fit that
neither reaches within ITERATIONS warns, and Rates.miss holds every step's miss.

With an anchor, the documents that belong to that domain (posterior of one half or more) keep rate 1, no
rate is above 1, and the targets are relative to the anchor's tokens: others are lowered to them, and
never raised.

Defined cases: a null text counts as empty (no tokens; its rate follows its posteriors); repeated
rows count as often as they occur; a domain whose target is MOST_RAISE times its expected tokens or more
can't be reached and is left out of the fit, with a warning, and the others share its target; without labels all posteriors are equal; an empty table gives an empty table;
input columns with the names of the output's are replaced. realise draws by a hash of id and text, so
rows with null or repeated ids draw by their texts, and equal rows alike.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from citelake.llm.common import materialise, read_table
from citelake.llm.text_model import fit_on_labels, with_posteriors

#: Domains of label columns quality, toxic by class number, and the share of tokens each should get.
DOMAINS = ("low", "low_toxic", "good", "good_toxic")
TARGETS = {"low": 0.06, "low_toxic": 0.01, "good": 0.90, "good_toxic": 0.03}
ITERATIONS = 100
TOLERANCE = 1e-5  # of all tokens
MOST_RAISE = 50  # times its tokens that a domain's target may be
PULL = 1e-6


@dataclass
class Rates:
    """What a document's rate follows from: rate = 1, then one projected step for each gradient, with momentum."""

    pull: float = PULL
    anchor: int | None = None
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)  # gradient and momentum
    miss: list[float] = field(default_factory=list)

    def limits(self, posteriors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest rate of each document."""
        n = len(posteriors)
        if self.anchor is None:
            return np.zeros(n), np.full(n, np.inf)
        return (posteriors[:, self.anchor] >= 0.5).astype(float), np.ones(n)

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        least, most = self.limits(posteriors)
        rate = before = np.ones(len(posteriors))
        for g, momentum in self.steps:
            moved = np.clip(rate - (posteriors @ g + self.pull * (rate - 1)), least, most)
            rate, before = np.clip(moved + momentum * (moved - before), least, most), moved
        return rate


def _matrix(column: pa.Array, classes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def _sums(table: DataFrame, rates: Rates, classes: int) -> np.ndarray:
    """Sums over documents of rate x tokens x posterior."""
    shared = table.sparkSession.sparkContext.broadcast(rates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes)
        for batch in batches:
            p, t = _matrix(batch.column(0), classes), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += (shared.value.of(p) * t) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(classes)), pa.array(total)], names=["k", "v"])

    parts = table.select("posteriors", "n_tokens").mapInArrow(run, "k long, v double")
    found = {r["k"]: r["v"] for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    shared.destroy()
    return np.array([found.get(k, 0.0) for k in range(classes)])


def fit_rates(table: DataFrame, targets: np.ndarray, anchor: int | None = None) -> Rates:
    """Rates for a table of posteriors and n_tokens whose domain token totals meet targets (shares)."""
    classes, rates = len(targets), Rates(anchor=anchor)
    share = _sums(table, rates, classes)
    total = share.sum()
    if not total:
        return rates
    share = share / total
    open_ = share * MOST_RAISE > targets
    if left_out := [int(k) for k in np.flatnonzero(~open_ & (targets > 0))]:
        warnings.warn(f"domains {left_out} have too few expected tokens for their targets and are left out", stacklevel=2)
    goal = np.where(open_, targets, 0.0)
    goal = goal / goal.sum() if goal.sum() else share
    if anchor is not None and goal[anchor]:
        goal = goal * share[anchor] / goal[anchor]
        open_ = open_ & (np.arange(classes) != anchor)  # its documents stay as they are
    # posteriors sum to 1, so the weighted second moments have no eigenvalue above 1: a full step is never too long
    weight = np.where(open_, 1 / np.maximum(share, 1e-9), 0.0)
    pace, loss = 1.0, np.inf
    for _ in range(ITERATIONS):
        miss = np.where(open_, _sums(table, rates, classes) / total - goal, 0.0)
        rates.miss.append(float(np.abs(miss).max()))
        if rates.miss[-1] < TOLERANCE or (len(rates.miss) > 6 and abs(rates.miss[-1] - rates.miss[-6]) < TOLERANCE / 10):
            break
        if (loss_now := float(weight @ miss**2)) > loss:
            pace = 1.0  # past the valley: momentum starts afresh
        loss, following = loss_now, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        rates.steps.append((weight * miss, (pace - 1) / following))
        pace = following
    else:
        warnings.warn(f"targets are missed by {rates.miss[-1]:.1e} of all tokens after {ITERATIONS} steps", stacklevel=2)
    return rates


def with_rates(scored: DataFrame, rates: Rates, classes: int) -> DataFrame:
    """scored with a column `rate` from its column `posteriors`."""
    shared = scored.sparkSession.sparkContext.broadcast(rates)
    at = scored.columns.index("posteriors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = pa.array(shared.value.of(_matrix(batch.column(at), classes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, rate], names=[*batch.schema.names, "rate"])

    return scored.mapInArrow(run, StructType([*scored.schema.fields, StructField("rate", DoubleType())]))


def mix(docs: DataFrame, labels: DataFrame, label_columns: tuple[str, ...], targets: np.ndarray, keep: list[str] | None = None, anchor: int | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens, posteriors and rate."""
    model = fit_on_labels(docs, labels, label_columns)
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "posteriors", "rate")]
    if "text" in wanted:  # texts are scored again rather than written
        rates = fit_rates(materialise(with_posteriors(docs, model, "posteriors", "n_tokens", keep=[]), "posteriors"), targets, anchor)
        return with_posteriors(docs, model, "posteriors", "n_tokens", keep=wanted, derived=("rate", rates.of))
    table = materialise(with_posteriors(docs, model, "posteriors", "n_tokens", keep=wanted), "posteriors")
    return with_rates(table, fit_rates(table, targets, anchor), model.classes)


def realise(rated: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as its rate says: the whole part, and one more by a hash of its id and text.

    The draw follows from the row alone, so a run repeated after a lost executor draws alike.
    """
    draw = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    copies = F.floor(F.col("rate") + draw).cast("int")
    return rated.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*columns)


def query(spark: SparkSession, sf_dir: str, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    goal = np.array([targets[d] for d in DOMAINS])
    mixed = mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ("quality", "toxic"), goal, keep=["doc_id"])
    parts = [F.element_at("posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *parts, "rate")
