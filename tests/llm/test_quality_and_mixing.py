import math

import numpy as np

from citelake.llm import mixing, quality
from citelake.llm.text_model import fit_on_labels, with_posteriors

SF = "/root/testdata/sf0.1"


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, train, keep=["doc_id"]).join(test, "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.97
    assert np.mean([r["keep"] for r in got if r["quality"] == 1]) > 0.99
    model = fit_on_labels(docs, train, ("toxic",))
    found = with_posteriors(docs, model, "p", keep=["doc_id"]).join(test, "doc_id").collect()
    right = np.array([(r["p"][1] > 0.5) == (r["toxic"] == 1) for r in found])
    toxic = np.array([r["toxic"] == 1 for r in found])
    assert right.mean() > 0.95 and right[toxic].mean() > 0.7


def test_site_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 5}", f"l{i % 3}", float(rng.beta(1 + i % 5, 3))) for i in range(700)] + [("rare", "l0", 0.99)]
    got = {(r["_site"], r["_path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "_site string, _path string, p_document double")).collect()}

    def grouped(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[2]
        return out

    mean = sum(r[2] for r in rows) / len(rows)

    def strength(groups):
        total = len(rows)
        between = sum(n * (s / n - mean) ** 2 for n, s in groups.values())
        spread = (between - (len(groups) - 1) * mean * (1 - mean)) / (total - sum(n * n for n, _ in groups.values()) / total)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    sites, paths = grouped(lambda r: r[0]), grouped(lambda r: r[:2])
    a, b = strength(sites), strength(paths)
    for (site, path), (n, s) in paths.items():
        m = (sites[site][1] + a * mean) / (sites[site][0] + a)
        assert math.isclose(got[site, path]["p_site"], m, rel_tol=1e-9)
        assert math.isclose(got[site, path]["p_path"], (s + b * m) / (n + b), rel_tol=1e-9)
    assert abs(got["rare", "l0"]["p_path"] - mean) < abs(0.99 - mean)


def test_rates_meet_targets_and_least_squares(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 500, 400)
    df = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, t, strict=True)], "posteriors array<double>, n_tokens long")
    goal = np.array([0.6, 0.3, 0.1])
    rates = mixing.fit_rates(df, goal)
    r = rates.of(p)
    assert (r >= 0).all() and np.abs((r * t) @ p / t.sum() - goal).max() < 2 * mixing.TOLERANCE and len(rates.miss) < 30
    got = np.array([x["rate"] for x in mixing.with_rates(df, rates, 3).collect()])
    assert np.allclose(np.sort(got), np.sort(r))


def test_rates_against_dense_projected_least_squares(spark):
    """Where plain dense projected steps over all rates meet the targets, so does the operator; where they can't, it comes as near."""
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 300, 300).astype(float)
    weak = np.stack([0.6 + 0.4 * p[:, 0], 0.4 * (1 - p[:, 0])], 1)  # the second domain can't have more than 0.4 of the tokens
    for x, goal in ((p, np.array([0.5, 0.3, 0.2])), (p, np.array([0.05, 0.05, 0.9])), (weak, np.array([0.3, 0.7]))):
        df = spark.createDataFrame([(v.tolist(), int(n)) for v, n in zip(x, t, strict=True)], "posteriors array<double>, n_tokens long")
        rates = mixing.fit_rates(df, goal)
        a = (t[:, None] * x).T / t.sum()
        a, aim = a / np.sqrt(a.sum(1, keepdims=True)), goal / np.sqrt(a.sum(1))  # misses relative to the domain's size
        step, r = 1 / np.linalg.norm(a, 2) ** 2, np.ones(300)
        for _ in range(20_000):
            r = np.maximum(0, r - step * a.T @ (a @ r - aim))
        best, own = np.linalg.norm(a @ r - aim), np.linalg.norm(a @ rates.of(x) - aim)
        assert own < max(1e-4, 1.1 * best), (goal, own, best)


def test_an_anchor_keeps_its_documents(spark):
    rng = np.random.default_rng(4)
    p = rng.beta(0.2, 2.0, 500)
    p, t = np.stack([1 - p, p], 1), rng.integers(1, 300, 500)
    df = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, t, strict=True)], "posteriors array<double>, n_tokens long")
    clean = p[:, 0] >= 0.5
    r = mixing.fit_rates(df, np.array([0.95, 0.05]), anchor=0).of(p)
    assert (r[clean] == 1).all() and (r <= 1).all() and (r >= 0).all() and r[~clean].mean() < 0.5
    assert (mixing.fit_rates(df, np.array([0.5, 0.5]), anchor=0).of(p) == 1).all()  # toxic ones are never raised


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in quality.query(spark, sf).collect()}
    docs, labels = tables(spark, sf)
    rows = docs.select("doc_id", "source", "lang", "text").collect()
    model = fit_on_labels(docs, labels, ("quality",))
    from citelake.llm.text_model import Words, describe

    p = {r["doc_id"]: model.posterior(*describe(r["text"], Words())[:2])[1] for r in rows}
    mean = sum(p.values()) / len(p)

    def groups(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + p[r["doc_id"]]
        return out

    def strength(found):
        spread = sum(n * (s / n - mean) ** 2 for n, s in found.values()) - (len(found) - 1) * mean * (1 - mean)
        spread /= len(rows) - sum(n * n for n, _ in found.values()) / len(rows)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    site, path = (lambda r: r["source"] or ""), (lambda r: (r["source"] or "", r["lang"] or ""))
    sites, paths = groups(site), groups(path)
    a, b = strength(sites), strength(paths)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    assert len(got) == len(rows)
    for r in rows:
        at_site = (sites[site(r)][1] + a * mean) / (sites[site(r)][0] + a)
        at_path = (paths[path(r)][1] + b * at_site) / (paths[path(r)][0] + b)
        want = 1 / (1 + math.exp(-(logit(p[r["doc_id"]]) - logit(model.share[1]) + logit(at_path))))
        assert math.isclose(got[r["doc_id"]]["p_quality"], want, rel_tol=1e-6, abs_tol=1e-9) and got[r["doc_id"]]["keep"] == (want >= quality.THRESHOLD)


def test_mixing_query_meets_the_targets(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01").collect()
    t = np.array([r["n_tokens"] for r in rows], dtype=float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.abs((rate * t) @ p / t.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 1e-4


def test_realise_expected_copies(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 1.25D ELSE 0.4D END AS rate", "'x' AS text")
    rows = mixing.realise(df, ["doc_id", "text"]).groupBy((df["doc_id"] % 2).alias("k")).count().collect()
    n = {r["k"]: r["count"] for r in rows}
    assert abs(n[0] - 12500) < 250 and abs(n[1] - 4000) < 250


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "en", "s", 1), (2, "", "en", "s", 1), (None, "word " * 50000, "en", "s", 1)], "doc_id long, text string, lang string, source string, rate int")
    none = spark.createDataFrame([(None, None, None), (9, 1, 0), (1, 7, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and all(0 <= r["p_quality"] <= 1 for r in got)
    rated = mixing.mix(docs, none, ("quality", "toxic"), np.full(4, 0.25))
    assert rated.count() == 4 and rated.columns.count("rate") == 1
    assert quality.classify(docs.limit(0), none).count() == 0
    assert mixing.mix(docs.limit(0), none, ("toxic",), np.array([0.9, 0.1])).count() == 0
