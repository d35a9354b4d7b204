import collections

import corpus_pipeline
from citelake.llm import bpe, pii
from tests.llm.test_partenum import brute_components

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns
    first, unique, clean, mixed, ids = seen
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in first}
    assert len(bad & kept) <= 0.1 * len(bad) and len(good & kept) >= 0.99 * len(good)
    component = brute_components([(r["doc_id"], r["text"]) for r in first])
    assert {r["doc_id"] for r in unique} == {c for _, c in component.values()} and len(unique) == len({r["doc_id"] for r in unique})
    texts = {r["doc_id"]: r["text"] for r in unique}
    model = pii.trained()
    assert {r["doc_id"]: r["text"] for r in clean} == {k: pii.redacted(t, model.spans(t)) for k, t in texts.items()}
    assert {r["doc_id"] for r in mixed} <= set(texts)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    spared = [r["doc_id"] for r in clean if r["doc_id"] in good - toxic]
    after = collections.Counter(r["doc_id"] for r in mixed)
    assert max(after.values()) == 1 and sum(d in after for d in spared) >= 0.99 * len(spared)
    encoder = bpe.Encoder(bpe.vocabulary_bytes())
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert len(ids) == len(mixed) and all(encoder.decode(r["ids"]) == r["text"] == texts[r["doc_id"]] for r in ids)


def test_odd_rows_through_all_stages(spark, monkeypatch):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "s"), (None, "word " * 60000, "en", "s"), (None, "other text of some words", None, "s"), (3, "other text of some words", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "9L AS n_chars", "'x' AS _hash")
    for docs in (df, df.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, "/root/testdata/sf0.001")
            assert k == 4 or made.columns == docs.columns
            if k:
                docs = made
        assert made.columns == ["doc_id", "n_tokens", "ids", "text"]
        got = collections.Counter((r["doc_id"], r["text"]) for r in made.collect())
        if docs is not made:
            assert all(n == 1 for n in got.values())


def test_keep_one_with_repeats_and_nulls(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v u"), (None, "z y x w v u"), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from citelake.llm import partenum

    got = sorted(((r["doc_id"], r["text"]) for r in partenum.keep_one(df).collect()), key=str)
    assert got == sorted([(3, "a b c d e f"), (None, "z y x w v u"), (7, None), (8, "")], key=str)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs, encoder = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}, bpe.Encoder(bpe.vocabulary_bytes())
    assert len(rows) > 100 and {r["doc_id"] for r in rows} <= docs
    assert all(r["ids"] == encoder.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in rows)
