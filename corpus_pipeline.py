"""A training corpus from `documents`: five stages, each one operator of citelake.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of docs.

Defined cases: a null or empty text is a document without words, which stage 1 judges like any other
and stages 2 to 5 keep; rows that repeat an id and a text become one in stage 2, and a repeated or null
id with another text is another document; texts are taken whole at any length; further columns of docs
pass through all stages but the last, unless they bear the name of a column that a stage adds (those of
quality.OUTPUT, n_tokens, posteriors, rate); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from citelake.llm import bpe, mixing, partenum, pii, quality
from citelake.llm.common import discard, materialise, read_table, scratch

#: Shares of tokens that stage 4 gives to documents without and with toxic text, at most; clean ones stay as they are.
TARGETS = np.array([0.98, 0.02])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    return partenum.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents once each, and toxic ones as often as brings their tokens down to TARGETS."""
    rated = mixing.mix(docs, read_table(spark, sf_dir, "labels"), ("toxic",), TARGETS, anchor=0)
    return mixing.realise(rated, docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document, and the text decoded from them."""

    def emit(encoder: bpe.Encoder, texts: list[str | None]) -> dict[str, list]:
        made = bpe.ids_and_text(encoder, texts)
        return {"n_tokens": list(map(len, made["ids"])), "ids": made["ids"], "text": made["decoded"]}

    return bpe.bpe(docs, bpe.vocabulary_bytes(), emit=emit, schema="n_tokens long, ids array<int>, text string")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_to_targets),
    ("BPE encoding and decoding", encode_tokens),
]
#: No stage's decisions can be put in SQL (trained models, vocabularies); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again; a stage's own tables go with it."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            following = materialise(stage(spark, docs, sf_dir), f"stage{k}", lasting=True)
        if k:
            discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
