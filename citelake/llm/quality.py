"""Quality classifier with hierarchical empirical Bayes.

A document classifier (text_model, fitted on the labels' `quality`) gives each document's evidence.
Grouped aggregation gives the mean quality of each site (source) and each path on it (source and
language). Sparse groups are shrunk: a site towards the corpus, a path towards its site, each with
a prior strength estimated from all groups by the method of moments. The document's odds are then
those of the classifier with the training share replaced by its path's posterior mean:
logit p = logit p_document - logit share + logit p_path. A document stays if p >= THRESHOLD.

Scale: two passes over the texts, no shuffle of texts; the aggregates have a row for each site and
path, partially summed before the shuffle, and are joined under Spark's own size check.

Defined cases: a null text counts as empty and is scored as such; a null source or language is the
group ''; repeated rows count as often as they occur; without labels the share is one half and only
sites decide; an empty table gives an empty table; input columns with the names of the output's
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm.common import materialise, read_table
from citelake.llm.text_model import fit_on_labels, with_posteriors

THRESHOLD = 0.5
OUTPUT = ("p_document", "p_site", "p_path", "p_quality", "keep")


def _logit(p: F.Column) -> F.Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def prior_strength(groups: DataFrame, total: float, mean: float, n_groups: int) -> float:
    """How many documents the prior is worth, by moments over groups (n, s): sizes and sums of p.

    Between-group variance is the weighted variance of group means less what sampling within groups
    explains (a yes/no outcome). No spread beyond sampling means full shrinkage.
    """
    row = groups.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    within = mean * (1 - mean)
    if n_groups < 2 or not total or within <= 0:
        return 1e6
    spread = (row["between"] - (n_groups - 1) * within) / max(total - row["n2"] / total, 1e-9)
    return min(max(within / spread - 1, 1.0), 1e6) if spread > 0 else 1e6


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(_site, _path, p_site, p_path) from rows (_site, _path, p_document)."""
    paths = materialise(scored.groupBy("_site", "_path").agg(F.count("*").alias("n"), F.sum("p_document").alias("s")), "paths")
    sites = paths.groupBy("_site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    row = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("paths"), F.count_distinct("_site").alias("sites")).first()
    total, mean = float(row["n"] or 0), float(row["s"] or 0) / max(float(row["n"] or 0), 1.0)
    by_site = prior_strength(sites, total, mean, row["sites"])
    by_path = prior_strength(paths, total, mean, row["paths"])
    sites = sites.select("_site", ((F.col("s") + by_site * mean) / (F.col("n") + by_site)).alias("p_site"))
    return paths.join(sites, "_site").select("_site", "_path", "p_site", ((F.col("s") + by_path * F.col("p_site")) / (F.col("n") + by_path)).alias("p_path"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the columns of OUTPUT."""
    model = fit_on_labels(docs, labels, ("quality",))
    share = float(model.share[1])
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUT]
    sited = docs.select(
        *(docs[c] for c in dict.fromkeys([*wanted, "text"])),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("_site"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("_path"),
    )

    def scored(columns: list[str]) -> DataFrame:
        found = with_posteriors(sited, model, "_posterior", keep=[*columns, "_site", "_path"])
        return found.select(*(found[c] for c in columns), "_site", "_path", F.element_at("_posterior", 2).alias("p_document"))

    if "text" in wanted:  # texts are scored twice rather than written or shuffled
        groups, rows = site_posteriors(scored([])), scored(wanted)
    else:
        rows = materialise(scored(wanted), "scored")
        groups = site_posteriors(rows)
    odds = _logit(F.col("p_document")) - _logit(F.lit(share)) + _logit(F.col("p_path"))
    joined = rows.join(groups, ["_site", "_path"], "left").withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return joined.select(*wanted, "p_document", "p_site", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
