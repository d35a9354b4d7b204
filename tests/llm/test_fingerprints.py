import collections
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from citelake.llm import fingerprints as fp


def edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        out[key] = text[: len(text) - half] + following[:half], following
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fp.query(spark, sf).collect()}
    want, texts = edits(rows), dict(rows)
    assert len(got) == len(rows)
    by_text, prints = {}, {r["fingerprint"] for r in got.values()}
    for key, r in got.items():
        assert r["n_chars"] == len(texts[key])
        assert r["edited_sha256"] == hashlib.sha256(want[key][0].encode()).hexdigest()
        assert by_text.setdefault(texts[key], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    mean = lambda name: sum(r[name] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1
    assert len(prints) > 0.98 * len(by_text)


def test_next_across_ranges_nulls_ties(spark):
    docs = [(i * i * 1000, f"text number {i} of words") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = edits(docs)
    for rows in (2000, 30, 3, 1):
        for r in fp.fingerprints(df, rows).collect():
            assert r["edited"] == want[r["doc_id"]][0]
    crowd = [(5, f"copy {i} of id") for i in range(300)] + [(i, f"text {i} end") for i in range(10, 200)]
    many = spark.createDataFrame(crowd, "doc_id long, text string")
    found = fp.with_next(many, F.lit(1), 20).collect()
    assert len(found) == len(crowd) and len({r["next"]["text"] for r in found}) == len(crowd)  # one ring through all of them
    rings, at = {r["text"]: (r["doc_id"], r["next"]["text"]) for r in found}, "text 199 end"
    seen = []
    for _ in crowd:
        seen.append(rings[at][0])
        at = rings[at][1]
    assert seen == sorted(seen, reverse=True) and at == "text 199 end"
    odd = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (5, None), (5, "x y z"), (5, "x y z")], "doc_id long, text string")
    odd = odd.selectExpr("doc_id", "text", "1 AS made", "2 AS own")
    assert fp.fingerprints(odd).count() == 5
    alone = fp.fingerprints(odd.where("text = 'x y z'").limit(1)).collect()
    assert alone[0]["edited"] == "x yx " and alone[0]["own"] == alone[0]["of_next"]
    assert fp.fingerprints(odd.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = fp.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def chained(seed, *values):
    """The hash that Spark's xxhash64 gives texts, 64-bit and 32-bit numbers, one after the other."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_print(text, lexicon):
    terms = {signed(chained(42, w)) for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w}
    held = {}
    for t in terms & lexicon:
        held.setdefault(t >> fp.SHIFT, set()).add(t)
        if t % fp.TWICE == 0:
            other = (t >> fp.SHIFT) + 1 + (t >> 3) % (fp.SUBSETS - 1)
            other = (other + fp.SUBSETS // 2) % fp.SUBSETS - fp.SUBSETS // 2
            assert other != t >> fp.SHIFT
            held.setdefault(other, set()).add(other * (1 << fp.SHIFT) + t % (1 << fp.SHIFT))
    digest = lambda x: signed(chained(42, *((t, 8) for t in sorted(x))))
    return [j * (1 << fp.SHIFT) + digest(held[j]) % (1 << fp.SHIFT) for j in sorted(held)] or [digest(terms)]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    return len(set(a) & set(b)) / len({h >> fp.SHIFT for h in a} | {h >> fp.SHIFT for h in b})


def test_lexicon_against_brute_force(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["term"] for r in fp.lexicon(df, 0.1, 0.9).collect()}
    counts = {f"w{k}": sum(f"w{k}" in t.split() for _, t in docs) for k in range(40)}
    assert kept == {signed(chained(42, w)) for w, n in counts.items() if 6 <= n <= 54}


def test_query_against_brute_force(spark):
    """Fingerprints and likenesses of the whole query, with the lexicon counted by hand."""
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = collections.Counter(w for _, t in rows for w in {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w})
    lexicon = {signed(chained(42, w)) for w, n in counts.items() if max(2.0, fp.LOW * len(rows)) <= n <= fp.HIGH * len(rows)}
    want = edits(rows)
    prints = {key: brute_print(t, lexicon) for key, t in rows}
    used = {h >> fp.SHIFT for p in prints.values() if len(p) > 1 for h in p}
    assert len(used) == fp.SUBSETS
    after = dict(zip((k for k, _ in sorted(rows, reverse=True)), (k for k, _ in sorted(rows, reverse=True)[1:] + sorted(rows, reverse=True)[:1]), strict=True))
    written = lambda p: ".".join(f"{h & (1 << 64) - 1:X}" for h in p)
    for r in fp.query(spark, sf).collect():
        edited = brute_print(want[r["doc_id"]][0], lexicon)
        assert r["fingerprint"] == written(prints[r["doc_id"]]) and r["edited_fingerprint"] == written(edited)
        assert r["near_edited"] == brute_likeness(prints[r["doc_id"]], edited)
        assert r["near_next"] == brute_likeness(prints[r["doc_id"]], prints[after[r["doc_id"]]])
