"""HTML extraction by markup and a suffix array of each host.

Each page is read once into blocks. Blocks in an article (or, without one, a main element) are
protected; blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are noise; all others are open. The token streams of a host's open and noise blocks are
concatenated, each page with an end of its own and without breaks between blocks, so short repeated
blocks in one order are one run. Suffixes are sorted by prefix doubling, the longest common prefixes
of neighbours follow from the ranks, and the longest run that a suffix shares with another page is the
larger of those with its next neighbours of other pages. Runs of MIN_RUN tokens or more, of any
length, are repeated.

A host of more than SHARD_TOKENS tokens is dealt by page into shards, each with its own array. What is
repeated across shards only is found by merging their heads: a shard hands on its distinct first
MIN_RUN tokens once, and a head of two shards marks its pages. So no host is gathered in one task.

A page with protected text gives that text: the safeguard of articles, since copies of an article are
articles. Another page gives its open blocks without the runs inside them and without the blocks that
runs cover whole, that is, its unique runs; if nothing is left, it is a copy of another page rather
than boilerplate and gives its open blocks whole. Without the safeguard, articles are open blocks.

Defined cases: null html counts as empty and gives ''; a null url is the host ''; repeated rows are
one page for the runs and are all returned; broken markup is read as far as it goes, in time linear in
its length; an empty table gives an empty table; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from citelake.llm.common import materialise, read_table, slices, split_mix, task_count

MIN_RUN = 10
SHARD_TOKENS = 1 << 14
PROTECTED, OPEN, NOISE = 2, 1, 0

#: Fixed element names of HTML.
RAW = frozenset("script style textarea title noscript template svg math iframe object xmp noembed noframes".split())
NOISE_TAGS = frozenset("nav aside footer form button select datalist dialog menu head audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr area base link meta param source track input col embed".split())
#: Fixed class, id and role words of page furniture.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus respond reply replies search pagination pager toolbar "
    "contentinfo complementary dialog form hidden skip toc".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--.*?(?:--!?>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_OPEN_END = re.compile(r"<!--.*\Z|<[!?/][^>]*\Z", re.S)  # markup that the page's end leaves open
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


def _marked(tag: str, attributes: str, inside: bool) -> int:
    """The zone that an element begins: PROTECTED, NOISE or OPEN for none of its own."""
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return NOISE
    zone = PROTECTED if tag in ("article", "main") else OPEN
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return NOISE
            if name in ("class", "id", "role") and tag not in ("html", "body"):
                words = set(_WORDS.split(value)) & (NOISE_WORDS - {"header"} if inside else NOISE_WORDS)
                if value == "main":
                    zone = PROTECTED
                elif words and (tag not in ("article", "main") or words & {"comment", "comments", "reply", "ad", "advert", "sponsored", "hidden"}):
                    return NOISE
            if name == "itemprop" and value == "articlebody":
                zone = PROTECTED
    return zone


def blocks(page: str | None, safeguard: bool = True) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in page order; text has references decoded and single spaces."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # elements that change the zone, and block elements around them
    tags: Counter[str] = Counter()  # how many of them the stack holds, by tag and by zone
    zones = [0, 0, 0]
    zone, best, at, n = OPEN, OPEN, 0, page.rfind(">") + 1  # no tag ends after the last ">"
    articles = bool(re.search(r"<article[\s/>]", page, re.I))

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((best, text))
            parts = []

    def pop() -> str:
        tag, own = stack.pop()
        tags[tag] -= 1
        zones[own] -= 1
        return tag

    while at < len(page):
        m = _TAG.search(page, at) if at < n else _OPEN_END.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is _TAG else ""
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if closing:
            if tags[tag]:
                flush()
                while pop() != tag:
                    pass
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        elif tag not in VOID and not attributes.endswith("/"):
            own = _marked(tag, attributes, zone == PROTECTED)
            if own == PROTECTED and articles and tag != "article":
                own = OPEN  # the article stands for the main element around it
            if own == PROTECTED and not safeguard:
                own = OPEN
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()  # an end tag left out
            if own != OPEN or tags[tag]:
                flush()
                stack.append((tag, own))
                tags[tag] += 1
                zones[own] += 1
        zone = NOISE if zones[NOISE] else PROTECTED if zones[PROTECTED] else OPEN
        best = zone
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def stream(page: list[tuple[int, str]]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Token hashes of the blocks that aren't protected, one after the other, and (zone, first, last + 1) of each block."""
    tokens: list[int] = []
    spans = []
    for zone, text in page:
        if zone != PROTECTED:
            first = len(tokens)
            tokens += [xxhash.xxh3_64_intdigest(w) for w in text.split(" ")]
            spans.append((zone, first, len(tokens)))
    return np.array(tokens, dtype=np.uint64), spans


def heads(tokens: np.ndarray, host: str) -> np.ndarray:
    """Keys of the suffixes of MIN_RUN tokens or more, by host and first MIN_RUN tokens."""
    at = np.arange(max(0, len(tokens) - MIN_RUN + 1))
    key = np.full(len(at), xxhash.xxh3_64_intdigest(host), dtype=np.uint64)
    for k in range(MIN_RUN):
        key = split_mix(key ^ tokens[at + k])
    return key.view(np.int64)


def shared_lengths(streams: list[np.ndarray]) -> list[np.ndarray]:
    """For each token of each stream, the length of the longest run from there that another stream holds.

    A suffix array of the concatenated streams: memory and, but for a logarithm, time are linear.
    """
    sizes = np.array([len(s) for s in streams]) + 1  # each ends with a token of its own
    ends = np.cumsum(sizes) - 1
    whole = np.zeros(int(sizes.sum()), dtype=np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    inner = np.ones(len(whole), dtype=bool)
    inner[ends] = False
    rank = np.unique(np.concatenate(streams) if len(streams) else np.zeros(0, dtype=np.uint64), return_inverse=True)[1]
    whole[inner] = rank + len(streams)
    whole[ends] = np.arange(len(streams))
    n, step, levels = len(whole), 1, [whole]
    while True:  # ranks by the first 2, 4, 8... tokens, until all differ
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - step)] = levels[-1][step:]
        found, ranks = np.unique(levels[-1] * (n + len(streams) + 2) + after + 1, return_inverse=True)
        levels.append(ranks)
        step *= 2
        if len(found) == n:
            break
    order = np.argsort(levels[-1])
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < n) & (y < n)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        common[ok] += 1 << k
    owner = page[order]
    group = np.cumsum(np.append(True, owner[1:] != owner[:-1]))  # neighbours of one page
    least = lambda values, by: pd.Series(values).groupby(by).cummin().to_numpy()
    before = least(np.append(0, common), group)
    behind = least(np.append(common, 0)[::-1], group[::-1])[::-1]
    longest = np.zeros(n, dtype=np.int64)
    longest[order] = np.maximum(before, behind)
    return [longest[e - size + 1 : e] for e, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def covered(longest: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the stretches of tokens that repeated runs cover begin and end."""
    at = np.flatnonzero(longest >= MIN_RUN)
    depth = np.zeros(len(longest) + 1, dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + longest[at], -1)
    inside = np.cumsum(depth)[:-1] > 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


_RUNS = StructType([StructField("page", LongType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("key", LongType()), StructField("shard", IntegerType()), StructField("at", IntegerType())])


def _runs_of_shard(host: str, shard: int, split: bool, pages: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each page with runs; where the host has other shards, its heads besides."""
    names = list(pages)
    streams = [np.frombuffer(pages[p], dtype=np.uint64) for p in names]
    longest = shared_lengths(streams)
    made = [(p, *c) for p, c in zip(names, map(covered, longest), strict=True) if c[0]]
    empty = lambda n, t: pa.nulls(n, t)
    ints = pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], ints), pa.array([m[2] for m in made], ints), empty(len(made), pa.int64()), empty(len(made), pa.int32()), empty(len(made), pa.int32())], names=_RUNS.names
    )
    if split:
        keys = [heads(s, host) for s in streams]
        alone = [x[: len(k)] < MIN_RUN for x, k in zip(longest, keys, strict=True)]
        known = np.unique(np.concatenate([k[~f] for k, f in zip(keys, alone, strict=True)]))
        at = np.concatenate([np.flatnonzero(f) for f in alone])
        key = np.concatenate([known, *(k[f] for k, f in zip(keys, alone, strict=True))])
        own = np.repeat(np.array(names, dtype=np.int64), [int(f.sum()) for f in alone])
        none, n = len(known), len(key)
        page = pa.concat_arrays([empty(none, pa.int64()), pa.array(own, pa.int64())])
        place = pa.concat_arrays([empty(none, pa.int32()), pa.array(at, pa.int32())])
        yield pa.RecordBatch.from_arrays([page, empty(n, ints), empty(n, ints), pa.array(key, pa.int64()), pa.array(np.full(n, shard), pa.int32()), place], names=_RUNS.names)


def repeated_runs(parsed: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(page, starts, ends, heads) of the pages (page, host, tokens) with runs that another page of the host shares.

    starts and ends limit the stretches found within a shard, heads begin runs of MIN_RUN tokens found across shards.
    """
    rows = parsed.where(F.length("tokens") >= 8 * MIN_RUN).select("page", "host", "tokens")
    large = rows.groupBy("host").agg(F.sum(F.length("tokens") / 8).alias("n")).where(F.col("n") > shard_tokens)
    large = materialise(large.select("host", F.ceil(F.col("n") / shard_tokens).cast("int").alias("shards")), "hosts")  # written, so that Spark knows its size before it deals the pages
    dealt = rows.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod("page", "shards").cast("int"))
    dealt = dealt.select("host", "shard", "shards", "page", "tokens").repartition(task_count(parsed), "host", "shard").sortWithinPartitions("host", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards arrive in order; one is held at a time."""
        at: tuple | None = None
        pages: dict[int, bytes] = {}
        for batch in slices(batches):
            for host, shard, shards, page, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at[:2] != (host, shard):
                    yield from _runs_of_shard(*at, pages)
                    pages = {}
                at = (host, shard, shards > 1)
                pages[page] = tokens
        if at is not None:
            yield from _runs_of_shard(*at, pages)

    runs = materialise(dealt.mapInArrow(run, _RUNS), "runs")
    met = runs.where("key IS NOT NULL").groupBy("key").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a < b").select("key")
    across = runs.where("key IS NOT NULL AND page IS NOT NULL").join(met, "key").groupBy("page").agg(F.sort_array(F.collect_set("at")).alias("heads"))
    return runs.where("starts IS NOT NULL").select("page", "starts", "ends").join(across, "page", "full")


def unique_runs(texts: list[str], firsts: list[int], starts: list[int], ends: list[int], across: list[int]) -> str:
    """The open blocks without their repeated tokens; whole, if nothing would be left.

    A block that runs cover whole goes; of another, only stretches of MIN_RUN tokens or more go, so that
    a menu doesn't take along the first words of the text after it that other pages begin with too.
    """
    gone: set[int] = set()
    for a, b in [*zip(starts, ends, strict=True), *((m, m + MIN_RUN) for m in across)]:
        gone.update(range(a, b))
    left = []
    for text, first in zip(texts, firsts, strict=True):
        words = text.split(" ")
        flags = [first + i in gone for i in range(len(words))]
        if all(flags):
            continue
        kept: list[str] = []
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and flags[j] == flags[i]:
                j += 1
            if not flags[i] or j - i < MIN_RUN:
                kept += words[i:j]
            i = j
        if kept:
            left.append(" ".join(kept))
    return "\n".join(left or texts)


def parse(pages: DataFrame, safeguard: bool = True) -> DataFrame:
    """page_id, url, page (a hash of the row), host, text (null where runs decide), open blocks, where they begin, tokens."""
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url", "html").alias("page"))
    fields = [source.schema["page_id"], source.schema["url"], StructField("page", LongType()), StructField("host", StringType()), StructField("text", StringType())]
    fields += [StructField("open", ArrayType(StringType())), StructField("firsts", ArrayType(LongType())), StructField("tokens", BinaryType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made: list[list] = [[], [], [], [], []]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = blocks(page, safeguard)
                kept = [t for z, t in found if z == PROTECTED]
                tokens, spans = stream(found)
                row = host_of(url), "\n".join(kept) if kept else None, [] if kept else [t for z, t in found if z == OPEN], [] if kept else [a for z, a, _ in spans if z == OPEN], tokens.tobytes()
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
            arrays = [batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return source.mapInArrow(read, StructType(fields))


def extract(pages: DataFrame, safeguard: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    parsed = materialise(parse(pages, safeguard), "parsed")
    out = StructType([parsed.schema["page_id"], parsed.schema["url"], StructField("text", StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [unique_runs(*(x or [] for x in row)) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    decided = parsed.where("text IS NOT NULL").select("page_id", "url", "text")
    joined = parsed.where("text IS NULL").select("page_id", "url", "page", "open", "firsts").join(repeated_runs(parsed, shard_tokens), "page", "left")
    rest = joined.select("page_id", "url", "open", "firsts", "starts", "ends", "heads").mapInArrow(finish, out)
    return decided.unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
