import numpy as np

from citelake.llm import itq


def brute(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= itq.COSINE
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = root(ids[a]), root(ids[b])
        parent[max(a, b)] = min(a, b)
    return near, {i: root(i) for i in ids}


def test_recall_and_precision(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    near, component = brute(ids, x)
    got = {r["vec_id"]: r for r in itq.query(spark, "/root/testdata/sf0.1").collect()}
    want = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert np.mean([got[i]["component_id"] == component[i] for i in ids]) > 0.99
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_pairs_are_listed_once_and_completely(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 20)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 32))
    x = (base[rng.integers(0, 30, 400)] + rng.normal(size=(400, 32)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    quantiser = itq.Quantiser(x.astype(np.float64))
    tables = itq.Tables(quantiser.bits, len(x))
    pairs = [(r["a"], r["b"]) for r in itq.candidates(df, {32: (quantiser, tables)}).collect()]
    codes = quantiser.encode(x.astype(np.float64))
    apart = (codes[:, None] != codes[None]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(apart <= tables.radius, 1)), strict=True)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 1000


def test_each_pair_within_the_radius_belongs_to_one_key_at_any_number_of_vectors():
    rng = np.random.default_rng(5)
    for bits, radius in ((64, 10), (64, 14), (32, 5), (200, 33)):
        for n in (10**3, 10**5, 10**7, 10**9, 10**11):
            t = itq.Tables(bits, n, radius)
            assert radius < len(t) * (t.flips + 1) and t.entered + t.asked == t.flips
            a = rng.integers(0, 2, (300, bits)).astype(np.uint8)
            b = a.copy()
            for k, row in enumerate(b):
                row[rng.permutation(bits)[: k % (radius + 1)]] ^= 1
            near = np.stack([(a[:, x:y] != b[:, x:y]).sum(1) <= t.flips for x, y in zip(t.edges[:-1], t.edges[1:], strict=True)])
            assert near.any(0).all()
            for k in range(len(t)):
                differ = t.keys(a, k) ^ t.keys(b, k)
                own = t.own(differ)
                met = near[k]
                assert (np.bitwise_count(own)[met] <= t.entered).all() and (np.bitwise_count(differ ^ own)[met] <= t.asked).all()


def test_lengths_are_indexed_apart(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x + 0.01]))]
    y = rng.normal(size=(150, 16))
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(np.concatenate([y, y * 1.01 + 0.001]))]
    rows += [(2000, [1.0, 0.2, 0.1]), (2001, [1.0, 0.2, 0.11]), (2002, [0.0, 1.0, 0.0]), (2003, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(df).collect()}
    assert np.mean([got[i + 150] == (1, i) for i in range(150)]) >= 0.97
    assert np.mean([got[1150 + i] == (1, 1000 + i) for i in range(150)]) >= 0.97
    assert got[2000] == got[2001] == (1, 2000) and got[2002] == (0, 2002) and got[2003] == (0, 2003)


def planted(mean, cosine, n=3000, size=64):
    """Vectors with a common mean, and a partner of each at the cosine."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, size)) + mean
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)


def test_recall_on_planted_pairs_and_wide_tables():
    for mean in (0, 1, 2):
        for cosine in (0.95, 0.97, 0.99):
            x, y = planted(mean, cosine)
            q = itq.Quantiser(x)
            differ = q.encode(x) ^ q.encode(y)
            for n in (len(x), 10**4, 10**6, 10**9):
                t = itq.Tables(q.bits, n, q.radius)
                assert t.radius < len(t) * (t.flips + 1)
                near = [differ[:, a:b].sum(1) <= t.flips for a, b in zip(t.edges[:-1], t.edges[1:], strict=True)]
                assert (np.any(near, 0) & (differ.sum(1) <= t.radius)).mean() >= 0.95, (mean, cosine, n)


def test_planted_pairs_are_found_with_a_common_mean(spark):
    for mean in (0, 1):
        x, y = planted(mean, 0.951, 400)
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r["component_id"] for r in itq.near_duplicates(df).collect()}
        assert len(got) == 800 and np.mean([got[i] == got[i + 400] for i in range(400)]) >= 0.95


def test_quantiser_learns_balanced_codes():
    x = np.random.default_rng(1).normal(size=(2000, 16)) * np.geomspace(1, 4, 16)
    share = itq.Quantiser(x).encode(x).mean(0)
    assert np.abs(share - 0.5).max() < 0.15


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS kept")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True) and len(got) == 13
    assert itq.near_duplicates(df.limit(0)).count() == 0
