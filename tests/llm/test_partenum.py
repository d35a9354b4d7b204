import itertools
import random

import numpy as np

from citelake.llm import partenum as pe


def brute_sets(texts):
    out = {}
    for key, text in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        out[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {p for ks in index.values() if len(ks) < 400 for p in itertools.combinations(sorted(ks), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for trial in range(3000):
        m = int(rng.integers(1, 30)) if trial % 2 else int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, m, dtype=np.uint64))
        m = len(a)
        gone = int(rng.integers(0, m // 5 + 1))
        come = int(rng.integers(0, m // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, come, dtype=np.uint64)]))
        if len(b) and pe.linked(a, b):
            assert np.intersect1d(pe.signatures(a), pe.signatures(b)).size, (m, gone, come)
            x, y = sorted((np.frombuffer(pe.sketch(s), np.uint64)[None] for s in (a, b)), key=lambda r: r.shape)
            assert y.shape[1] in (x.shape[1], 2 * x.shape[1])
            y = pe.folded(y) if y.shape[1] > x.shape[1] else y
            assert int(np.bitwise_count(x ^ y).sum()) * 180 <= 20 * (len(a) + len(b))


def test_clustered_hashes_still_share():
    rng = np.random.default_rng(1)
    for _ in range(300):  # hashes crowded in a corner of the domain make weak partitions
        a = np.unique(rng.integers(0, 1 << 58, int(rng.integers(16, 60)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 10], rng.integers(0, 1 << 58, len(a) // 12, dtype=np.uint64)]))
        if pe.linked(a, b):
            assert np.intersect1d(pe.signatures(a), pe.signatures(b)).size


def texts():
    random.seed(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = " ".join(random.choices(vocabulary, k=12))
    rows, key = [], 0
    for _ in range(60):
        base = random.choices(vocabulary, k=random.choice([3, 6, 12, 40, 120, 400]))
        for _ in range(random.choice([1, 1, 3, 8])):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(words) // 25))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((key, " ".join(words) + (" " + passage if key % 3 == 0 else "")))
            key += 7
    base = random.choices(vocabulary, k=90)
    for _ in range(120):  # a large group of near copies
        words = [w if random.random() > 0.02 else random.choice(vocabulary) for w in base]
        rows.append((key, " ".join(words)))
        key += 7
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \n\t"), (key + 4, "One"), (key + 5, "one"), (key + 6, "É one"), (key + 7, "é one")]
    return rows


def test_components_against_brute_force(spark, monkeypatch):
    rows = texts()
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block, rounds in ((1000, (2, 16, None)), (7, (1, None))):
        monkeypatch.setattr(pe, "BLOCK", block)
        monkeypatch.setattr(pe, "ROUNDS", rounds)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pe.components(df).collect()}
        assert got == want


def test_cases(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 1), (None, "only here", 1), (9, "word " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gid int")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in pe.components(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (-1, 2, 5), (-1, 1, None), (9, 1, 9)], key=str)
    assert pe.components(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pe.query(spark, sf).collect()}
    assert got == brute_components(docs)
