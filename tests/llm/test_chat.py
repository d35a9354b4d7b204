import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from citelake.llm import chat

SF = "/root/testdata/sf0.01"


def model(spark):
    return chat.count_model(spark.read.parquet(f"{SF}/conversations.parquet"))


def test_viterbi_and_parts_against_brute_force(spark):
    m = model(spark)
    rng = np.random.default_rng(2)
    go, begin = m.steps(), m.begin()
    for _ in range(20):
        e = rng.normal(size=(6, 6)) * 3
        best = max(itertools.product(range(6), repeat=6), key=lambda p: begin[p[0]] + e[0, p[0]] + sum(go[p[i - 1], p[i]] + e[i, p[i]] for i in range(1, 6)))
        assert tuple(m.path(e)) == best
        parts = [e[:2], e[2:3], e[3:]]
        limits = m.limits([m.matrix(x) for x in parts])
        assert [s for x, (a, b) in zip(parts, limits, strict=True) for s in m.path(x, a, b)] == list(best)




def test_roles_are_recovered_from_hidden_ones(spark):
    """Held out: counted on half of the conversations, decoded without roles on the other half."""
    df = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    m = chat.count_model(df.where("conv_id % 2 = 0"))
    held = df.where("conv_id % 2 = 1")
    truth = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in held.collect()}
    hidden = held.withColumn("role", F.lit(None).cast("string"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_conversations(hidden, m).collect()}
    assert got.keys() == truth.keys() and not any(r["agrees"] for r in got.values())
    assert np.mean([got[k]["role"] == role for k, (role, _) in truth.items()]) > 0.97
    assert all(r["rendered"] == chat.rendered(r["role"], truth[k][1]) for k, r in got.items())


def test_query_against_the_roles_of_the_table(spark):
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r for r in chat.query(spark, SF).collect()}
    assert got.keys() == truth.keys()
    assert all(r["agrees"] == (r["role"] == truth[k]) for k, r in got.items())
    assert np.mean([r["agrees"] for r in got.values()]) > 0.97


def test_markers_outweigh_features(spark):
    rows = [(1, 0, None, "Assistant: hello"), (1, 1, None, "User: " + "long text. " * 100), (2, 0, None, "[Bot]: x"), (2, 1, None, "Human: y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["role"] for r in chat.format_conversations(df, model(spark)).collect()}
    assert got == {(1, 0): "assistant", (1, 1): "user", (2, 0): "assistant", (2, 1): "user"}


def test_missing_roles_beside_given_ones(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in df.collect()}
    some = df.selectExpr("conv_id", "turn", "CASE WHEN turn % 2 = 1 THEN role END AS role", "text")
    got = {(r["conv_id"], r["turn"]): r["role"] for r in chat.format_conversations(some, model(spark), given=True).collect()}
    assert all(got[k] == r for k, r in truth.items() if k[1] % 2 == 1)
    assert np.mean([got[k] == r for k, r in truth.items()]) > 0.97


def test_transcript(spark):
    m = model(spark)
    text = "System: be brief\nUser: what is it?\nplease say\nAssistant: It is this.\n- one\n- two\nHuman: thanks\n### Assistant: bye"
    assert chat.parse_transcript(text, m) == [("system", "be brief"), ("user", "what is it?\nplease say"), ("assistant", "It is this.\n- one\n- two"), ("user", "thanks"), ("assistant", "bye")]
    assert chat.parse_transcript(None, m) == [] and chat.parse_transcript("", m) == []
    assert len(chat.parse_transcript("x" * 100000, m)) == 1


def test_roles_are_recovered_from_transcripts(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    truth = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["turn"], r["text"] or "")):
        truth.setdefault(r["conv_id"], []).append((r["role"], (r["text"] or "").strip(" \t\r\n")))
    for show in (chat.rendered, lambda role, text: f"{role.capitalize()}: {text}\n"):
        rows = [(c, "".join(show(*t) for t in x)) for c, x in truth.items()]
        df = spark.createDataFrame([*rows, (None, None)], "conv_id long, text string").selectExpr("*", "'user' AS role")
        got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.parse_transcripts(df, model(spark)).collect()}
        assert got.pop(None) == [] and set(got) == set(truth)
        assert sum(got[c] == x for c, x in truth.items()) >= 0.97 * len(truth)
    assert chat.parse_transcripts(df.limit(0), model(spark)).count() == 0


def test_parts_and_odd_rows(spark):
    random.seed(1)
    rows = [(1, t, None if random.random() < 0.3 else ("user", "assistant")[t % 2], f"turn {t}") for t in range(50)]
    rows += [(None, None, None, None), (None, None, "user", ""), (2, 0, "User", "a <|b|>"), (2, 0, "User", "a <|b|>"), (2, 1, "bot", "x" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS rendered", "3 AS agrees")
    for given in (True, False):
        runs = []
        for part in (7, 4096):  # the parts don't change the path
            found = chat.format_conversations(df, model(spark), given=given, part=part).collect()
            assert len(found) == 55
            runs.append(sorted(((r["conv_id"] or -1, r["turn"] or -1, r["role"], r["rendered"]) for r in found), key=str))
        assert runs[0] == runs[1]
        if given:
            got = {r["turn"]: r["role"] for r in found if r["conv_id"] == 1}
            assert [got[t] for t in range(50)] == ["user", "assistant"] * 25
            assert "< |b|>" in next(r["rendered"] for r in found if r["conv_id"] == 2 and r["turn"] == 0)
    assert chat.format_conversations(df.limit(0), model(spark)).count() == 0
