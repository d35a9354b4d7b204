import hashlib
import random
import re

import numpy as np

from citelake.llm import pii
from citelake.llm.boosting import BoostedTrees

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_on_random_texts():
    random.seed(5)
    for _ in range(6000):
        text = "".join(random.choice("0123456789012345.. --+()@@aBé_%\n") for _ in range(random.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é {card} x") == [("card", 2, 2 + len(card))]


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300000 + "1" * 300000 + "." * 1000 + "+" * 1000) == []


def test_model_adds_and_spares():
    model = pii.trained()
    found = lambda t: [(k, t[s:e]) for k, s, e in model.spans(t)]
    assert found("call me on phone (212) 555-0187, ok") == [("phone", "(212) 555-0187")]
    assert found("my ssn is 123-45-6789 thanks") == [("ssn", "123-45-6789")]
    assert found("write to jane.doe [at] example [dot] com please") == [("email", "jane.doe [at] example [dot] com")]
    assert found("the account: DE89 3704 0044 0532 0130 00 here") == [("iban", "DE89 3704 0044 0532 0130 00")]
    for clean in ("order 0810992847249405 of 2021-04-05", "pages 123 456 789 in all", "The 98079157628 thing 4736", "ratio 11:22:33:44"):
        assert found(clean) == []
    x, y = [], []
    for kind in ("phone", "ssn", "iban", "ipv6", "email"):
        a, b = pii._examples(kind, 150, random.Random(99))
        p = model.trees.predict(np.array(a)) >= model.thresholds[kind]
        x += p.tolist()
        y += b
    x, y = np.array(x), np.array(y)
    assert (x & (y == 1)).sum() / x.sum() > 0.93 and (x & (y == 1)).sum() / (y == 1).sum() > 0.75


def test_boosting_learns_a_rule():
    x = np.random.default_rng(0).random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((BoostedTrees().fit(x[:500], y[:500]).predict(x[500:]) > 0.5) == y[500:]).mean() > 0.9


def test_redaction_and_table_cases(spark):
    rows = [(2**60 + 1, "mail a@b.co now", 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, "clean", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans int")
    assert {(r["doc_id"], r["text"]) for r in pii.redact(df).collect()} == {(2**60 + 1, "mail [EMAIL] now"), (2, None), (3, ""), (None, "clean")}
    assert {r["doc_id"]: len(r["pii_spans"]) for r in pii.pii_spans(df).collect()} == {2**60 + 1: 1, 2: 0, 3: 0, None: 0}
    assert pii.pii_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    assert pii.redacted("abcdef", [("email", 1, 4), ("phone", 2, 5)]) == "a[EMAIL]f"


def test_added_spans_leave_the_base_alone(spark, tmp_path):
    text = "call me on phone (212) 555-0187, ok or write to jane.doe [at] example [dot] com please, or to a@b.co"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = pii.query(spark, str(tmp_path)).first()
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    assert (r["n_email"], r["n_phone"]) == (1, 0) and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert sorted(s.split(":")[0] for s in r["spans"].split(",")) == ["email", "email", "phone"]


def test_compressed_addresses():
    model = pii.trained()
    found = lambda t: [(k, t[s:e]) for k, s, e in model.spans(t)]
    for a in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "2001:db8:85a3:1234:5678:8a2e:370:7334"):
        assert found(f"the host address {a} answers") == [("ipv6", a)]
    for a in ("::1", "fe80::", "::8a2e:370:7334"):
        assert ("ipv6", 2, 2 + len(a)) in pii.candidates(f"x {a} y")
    for clean in ("in dead::beef we", "at 11:22:33 on", "std::vector of", "ratio 11:22:33:44", "a :: b"):
        assert found(clean) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, *_ in want)


def test_many_spans_in_one_text_are_held_against_their_neighbours():
    import random
    import time

    rng = random.Random(2)
    spans = [("ip", s, s + rng.randint(1, 30)) for s in rng.sample(range(3000), 150)]
    kept = pii._Stretches(spans)
    for _ in range(500):
        s = rng.randint(0, 3000)
        c = ("ssn", s, s + rng.randint(1, 20))
        assert kept.meets(c) == any(a < c[2] and s < b for _, a, b in spans)
    text = "call (212) 555-0187 or ip 10.0.0.1, mail a@b.co; "
    model = pii.trained()
    assert len(model.spans(text * 3)) == 9
    began = time.perf_counter()
    assert len(model.spans(text * 4000)) == 12000 and time.perf_counter() - began < 20
