import collections
import random
import time

import numpy as np

from citelake.llm import html_text
from citelake.llm.html_text import NOISE, OPEN, PROTECTED, blocks


def test_blocks_of_a_full_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
    <header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><!-- ad <p>x</p> --><div class="ad">Buy <b>now</b></div>
    <div id="cookie-notice"><p>We use</p></div><article><h1>Head &amp; shoulders</h1><p class="lead">First&nbsp; <i>line</i>
      here.<p>Second &lt;b&gt; &am x<br>third</p><aside>Side</aside><form><input><p>Name</p></form><ul><li>a<li>b</ul>
    <section class="comments"><p>Nice!</p><div><p>more</p></div></section><p>Last &#233;</p></article><p>after</p><footer>&copy; me</footer>"""
    found = blocks(page)
    assert [t for z, t in found if z == PROTECTED] == ["Head & shoulders", "First line here.", "Second <b> &am x", "third", "a", "b", "Last é"]
    assert [t for z, t in found if z == OPEN] == ["after"]
    assert "Nice!" in [t for z, t in found if z == NOISE]
    assert blocks(None) == [] and blocks("") == [] and blocks("a < b & c") == [(OPEN, "a < b & c")]
    assert blocks("<p>a<script>x") == [(OPEN, "a")] and blocks("<p " + "a" * 100000) [0][0] == OPEN


def brute_covered(streams):
    """The covered tokens of each page: those in a window of MIN_RUN tokens that another page holds."""
    seen = collections.defaultdict(set)
    windows = lambda tokens: ((i, tuple(tokens[i : i + html_text.MIN_RUN])) for i in range(len(tokens) - html_text.MIN_RUN + 1))
    for page, tokens in streams.items():
        for _, w in windows(tokens):
            seen[w].add(page)
    return {page: {k for i, w in windows(tokens) if len(seen[w]) > 1 for k in range(i, i + html_text.MIN_RUN)} for page, tokens in streams.items()}


def test_suffix_array_against_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        streams = [np.array([rng.randint(0, rng.choice([1, 3, 30])) for _ in range(rng.randint(1, 60))], dtype=np.uint64) for _ in range(rng.randint(1, 6))]
        got = html_text.shared_lengths(streams)
        for p, s in enumerate(streams):
            for i in range(len(s)):
                best = 0
                for q, other in enumerate(streams):
                    for j in range(len(other) if q != p else 0):
                        k = 0
                        while i + k < len(s) and j + k < len(other) and s[i + k] == other[j + k]:
                            k += 1
                        best = max(best, k)
                assert got[p][i] == best


def test_repeated_runs_against_brute_force(spark):
    rng = random.Random(7)
    phrases = [[f"p{j}x{k}" for k in range(rng.randint(4, 25))] for j in range(12)]
    streams = {}
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(phrases) if rng.random() < 0.6 else [f"own{i}x{k}" for k in range(rng.randint(1, 12))]
        streams[i] = words
    df = spark.createDataFrame([(i, "http://h/x", f"<p>{' '.join(w)}</p>") for i, w in streams.items()], "page_id long, url string, html string")
    parsed = html_text.parse(df)
    names = {r["page"]: r["page_id"] for r in parsed.collect()}
    want = brute_covered(streams)
    for shard_tokens in (1 << 14, 200, 1):  # one shard, several, and each page in a shard nearly alone
        got = {i: set() for i in streams}
        for r in html_text.repeated_runs(parsed, shard_tokens).collect():
            for a, b in [*zip(r["starts"] or [], r["ends"] or [], strict=True), *((m, m + html_text.MIN_RUN) for m in r["heads"] or [])]:
                got[names[r["page"]]].update(range(a, b))
        assert got == want


def test_removal_of_repeated_runs(spark):
    menu = " ".join(f"m{i}" for i in range(15))
    pages = [(i, "http://a.b/x", f"<body><p>{menu} u{i}</p><div>own words of page {i} " + " ".join(f"w{i}x{k}" for k in range(12)) + "</div></body>") for i in range(40)]
    pages += [(100, "http://c.d/", f"<p>{menu}</p>"), (101, None, None), (102, "http://a.b/", ""), (None, "http://a.b/", "<p>null id"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS page", "3 AS host")
    for shard_tokens in (1 << 14, 100):
        got = {}
        for r in html_text.extract(df, shard_tokens=shard_tokens).collect():
            got.setdefault(r["page_id"], []).append(r)
        assert sum(map(len, got.values())) == len(pages) and len(got[0]) == 2
        for i in range(40):
            own = " ".join(f"w{i}x{k}" for k in range(12))
            assert got[i][0]["text"] == f"u{i}\nown words of page {i} {own}"
        assert got[100][0]["text"] == menu  # another host
        assert got[101][0]["text"] == "" and got[102][0]["n_chars"] == 0 and got[None][0]["text"] == "null id"
    assert html_text.extract(df.limit(0)).count() == 0


def test_any_page_is_read_in_linear_time():
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        for page in ("<a " * n, "<div class=ad>" * n, "<article>" * n, "<p><b>x" * n, "<!-- " * n, "</x" * n, "<a '" * n + ">", "<script>" * n, "<li>a" * n, "&" * n, "<" * n):
            blocks(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2  # four times the length; quadratic would be sixteen


def test_without_the_safeguard_runs_decide_the_tables(spark):
    """Articles as open blocks: markup rules and repeated runs alone give nearly every article back."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    guarded = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, safeguard=False).collect()}
    assert set(got) == set(guarded)
    assert sum(got[i] == t for i, t in guarded.items()) >= 0.9 * len(got)


def test_short_blocks_in_one_order_are_one_run(spark):
    menu = "".join(f"<li>Item {k} here</li>" for k in range(5))
    pages = [(i, f"http://h/{i}", f"<body><ul>{menu}</ul><p>own {i} text {i}</p><div>Legal {i}</div><td>same foot</td></body>") for i in range(4)]
    df = spark.createDataFrame([*pages, (9, "http://other/", f"<ul>{menu}</ul>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(got[i] == f"own {i} text {i}\nLegal {i}\nsame foot" for i in range(4))  # the foot is too short for a run
    assert got[9] == "\n".join(f"Item {k} here" for k in range(5))


def test_copies_keep_their_text(spark):
    body = "<p>" + " ".join(f"c{k}" for k in range(30)) + "</p>"
    df = spark.createDataFrame([(1, "http://h/1", body), (2, "http://h/2", body)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(df).collect()} == {" ".join(f"c{k}" for k in range(30))}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        plain = article.replace("<br>", "\n").replace("</p>", "\n").replace("<p>", "\n").replace("</h1>", "\n").replace("<h1>", "").replace("<b>", "").replace("</b>", "")
        import html

        want = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in _blocks(article)) if x)
        assert r["text"] == want and r["n_chars"] == len(want), plain


def _blocks(article):
    import re

    return re.split(r"<(?:br|p|/p|h1|/h1)>", article.replace("<b>", "").replace("</b>", ""))
