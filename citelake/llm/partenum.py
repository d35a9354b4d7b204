"""N-gram Jaccard join by PartEnum signatures; near-duplicate components of texts.

A text's set holds the hashes of its distinct SHINGLE-word shingles. Two sets link when their
Jaccard similarity is at least PERCENT / 100; every link is checked exactly on the sets. Candidates
come from PartEnum signatures:

* Size bands double: band i holds sizes 2^i to 2^(i+1) - 1. A pair is found in the instance of its
  larger set's band, so a set signs for its own band and, if a partner can be that large, the next.
* In a band, linked sets differ in at most k = (sum of sizes) / 9 elements. The hash domain is cut
  into first-level partitions of PARTS second-level ones each. Of f first-level partitions, more
  than f - k/2 see at most one difference, so there some PARTS - 1 of the second-level partitions
  agree; each subset of that many is a signature (its elements' hashes, summed).
* A subset without elements says nothing. A first-level partition in which one can be empty is
  weak; a set signs as many partitions as leave k/2 + 1 that aren't weak. By the set of a pair that
  signs fewer, one of these agrees, and both sign it.
* Sets below SMALL, sets that could pair with them, and sets that run out of partitions also sign
  the first size - ceil(0.8 size) + 1 of their sorted hashes: linked sets share one of those.

So no link is lost. Signatures travel as binary blocks by hash range, 12 bytes each, and sets that
share one form a list; equal lists count once. Within lists, pairs are ruled out exactly by size
and by parity sketches (their distance never exceeds the sets' difference). What is left is checked
in ROUNDS. First each set asks, in one of its lists, for the closest two of its block and of the
list's first block, which ties a large group of near copies together by few checks. From then on a
list's largest component stands for its members: only sets outside it ask, for the closest few of
other components and last for all of them. Pairs thus grow with the sets that are still apart, not
with the square of a group. Lists of any size are dealt in cells of BLOCK by BLOCK sets. Sets are
identified by 64-bit hashes, so exact copies are one from the start. Texts are shingled once, and those of
candidates once more a round.

Defined cases: a null text counts as empty; without words a set is empty and the document alone;
with fewer words than SHINGLE the whole sequence is one shingle; a null id never becomes a
component's id unless all its ids are null; repeated rows are copies and are all returned; an empty
table gives an empty table; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from citelake.llm.common import connected_components, discard, materialise, read_table, slices, split_mix, task_count

SHINGLE, PERCENT = 5, 80
PARTS = 3
SMALL = 16
WIDEST = 1 << 16
ELEMENT_BYTES = 6
BLOCK = 1000
ROUNDS = (2, 4, None)  # candidates of a set that asks, in each round; None: all
FLUSH = 500_000  # signatures held by a task before they are handed on
FILTER_BITS = 1 << 23  # of the fixed-size filter that spares shingling texts without candidates
LISTS_AT_ONCE = 500
MOST_SEEN = 1_000_000  # sets that a task remembers not to sign again
WORDS_CACHED = 150_000
_ONE = np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(data: bytes | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split know ASCII letters and spaces only."""
    found = (data or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ w[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = split_mix(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def largest_partner(m: int) -> int:
    return m * 100 // PERCENT


def prefix(h: np.ndarray) -> np.ndarray:
    m = len(h)
    return split_mix(h[: m + (m * PERCENT // -100) + 1] ^ np.uint64(0x5EED))


def difference(m: int, limit: int) -> int:
    """The most elements in which a set of m can differ from a linked one of at most `limit`."""
    most = min(largest_partner(m), limit)
    return (m + most) * (100 - PERCENT) // (100 + PERCENT)


def signatures(h: np.ndarray) -> np.ndarray:
    """All signatures of a set, as uint64 hashes; see the module's docstring."""
    m = len(h)
    if not m:
        return h
    out = [prefix(h)] if m * PERCENT < SMALL * 100 else []
    if m >= SMALL:
        band = m.bit_length() - 1
        mixed = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(split_mix(h ^ np.uint64(0xC0DE))))
        for instance in (band, band + 1):
            top = (2 << instance) - 1
            if instance > band and largest_partner(m) <= top // 2:
                continue
            need = difference(m, top) // 2 + 1
            base = difference(top, top) // 2 + 1
            count = base + base // 4 + 2
            edges = np.arange(count * PARTS + 1, dtype=np.uint64) * np.uint64((1 << 32) // (count * PARTS))
            edges[-1] = np.uint64(1 << 32)
            at = np.searchsorted(h >> np.uint64(32), edges)
            sizes = np.diff(at).reshape(count, PARTS)
            sums = np.diff(mixed[at]).reshape(count, PARTS)
            strong = np.cumsum((sizes > 0).sum(1) >= 2)
            enough = int(np.searchsorted(strong, need)) + 1
            if enough > count:
                enough = count
                if not out:
                    out.append(prefix(h))
            sizes, sums = sizes[:enough], sums[:enough]
            total, tag = sums.sum(1), np.arange(enough, dtype=np.uint64) * np.uint64(8) + np.uint64(instance << 40)
            for left_out in range(PARTS):
                full = sizes.sum(1) > sizes[:, left_out]
                out.append(split_mix((total - sums[:, left_out])[full] ^ split_mix(tag + np.uint64(left_out))[full]))
    return np.concatenate(out)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the elements by their low bits; a bit or more an element, up to WIDEST.

    Unrelated sets of n then differ in nearly half of their bits or more, linked ones in 2n / 9 at most.
    """
    bits = min(WIDEST, max(512, 1 << (len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(rows: np.ndarray) -> np.ndarray:
    """Sketches of twice the width as sketches of half of it: the parities of both halves together."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def packed(h: np.ndarray) -> bytes:
    """The hashes' upper bytes: 48 bits tell the shingles of two texts apart."""
    return h.view(np.uint8).reshape(-1, 8)[:, 8 - ELEMENT_BYTES :].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ELEMENT_BYTES, 8), dtype=np.uint8)
    out[:, 8 - ELEMENT_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, ELEMENT_BYTES)
    return out.view(np.uint64).ravel()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


# -- distributed steps --------------------------------------------------------------------------


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, lists) of docs (_id, _hash, _data), from one reading of the texts.

    rows: _id, _hash of the text, gid (set id or null), n (set size) and, at least once for each
    set, its sketch. lists: lid, m and part, up to BLOCK of the m sets that share a signature.
    """
    tasks = task_count(docs)
    bits = max(6, (4 * tasks - 1).bit_length())
    kind = docs.schema["_id"].dataType
    row = [StructField("_id", kind), *(StructField(c, LongType()) for c in ("_hash", "gid", "n")), StructField("sketch", BinaryType())]
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, owners, counts, n = WordHashes(), [], [], [], 0
        seen: set[int] = set()

        def flush(like: pa.RecordBatch) -> pa.RecordBatch:
            s, g = np.concatenate(held), np.repeat(np.array(owners, dtype=np.int64), counts)
            bucket = (s >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            s, g, bucket = s[order].astype(np.uint32), g[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cuts[1:], len(bucket))
            blocks = [s[a:b].tobytes() + g[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            empty = [pa.nulls(len(cuts), like.schema.field(0).type), *(pa.nulls(len(cuts), pa.int64()) for _ in range(3)), pa.nulls(len(cuts), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(blocks, pa.binary()), *empty], names=names)

        last, dealt_rows = None, 0
        for batch in slices(batches):
            if last is None and batch.num_rows:
                dealt_rows = batch.column(1)[0].as_py() & 0xFFFF
            last, ids, sizes, sketches = batch, [], [], []
            for data in batch.column(2).to_pylist():
                h = shingles(data, words)
                g = set_id(h) if len(h) else None
                ids.append(g)
                sizes.append(len(h))
                if g is None or g in seen:
                    sketches.append(None)
                    continue
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(g)
                sketches.append(sketch(h))
                own = signatures(h)
                held.append(own)
                owners.append(g)
                counts.append(len(own))
                n += len(own)
            spread = (np.arange(dealt_rows, dealt_rows + len(ids)) & ((1 << bits) - 1)).astype(np.int32)  # copies too go to all tasks
            dealt_rows += len(ids)
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(ids), pa.binary()), batch.column(0), batch.column(1), *made], names=names)
            if n > FLUSH:
                yield flush(batch)
                held, owners, counts, n = [], [], [], 0
        if n:
            yield flush(last)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive in order; one is held at a time. Rows pass through."""
        at, parts, like = None, [], None
        for batch in batches:
            whole = batch.filter(pc.is_null(batch.column(1)))
            like = batch.schema.field(2).type
            if whole.num_rows:
                nothing = [pa.nulls(whole.num_rows, pa.int64()), pa.nulls(whole.num_rows, pa.int64()), pa.nulls(whole.num_rows, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*nothing, *whole.columns[2:]], names=out_names)
            blocks = batch.filter(pc.is_valid(batch.column(1)))
            for bucket, block in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist(), strict=True):
                if bucket != at:
                    if parts:
                        yield from _shared(parts, like, out_names)
                    at, parts = bucket, []
                parts.append(block)
        if parts:
            yield from _shared(parts, like, out_names)

    names = [*sent.names, *(f.name for f in row)]
    out_names = ["lid", "m", "members", *(f.name for f in row)]
    first = StructType([StructField("bucket", IntegerType()), StructField("block", BinaryType()), *row])
    second = StructType([StructField("lid", LongType()), StructField("m", LongType()), StructField("members", ArrayType(LongType())), *row])
    dealt = docs.mapInArrow(sign, first).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    both = materialise(dealt.mapInArrow(group, second), "signed")
    # lists that are equal under several signatures count once
    lists = both.where("lid IS NOT NULL").groupBy("lid", F.element_at("members", 1).alias("part")).agg(F.first("m").alias("m"), F.first("members").alias("members"))
    return both.where("lid IS NULL").select(*(f.name for f in row)), lists.drop("part")


def _shared(blocks: list[bytes], like: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The distinct lists of sets that share a signature, in one bucket; BLOCK sets a row."""
    sizes = [len(b) // 12 for b in blocks]
    s = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blocks, sizes, strict=True)])
    g = np.concatenate([np.frombuffer(b, np.int64, n, 4 * n) for b, n in zip(blocks, sizes, strict=True)])
    order = np.argsort(s, kind="stable")
    s, g = s[order], g[order]
    same = s[1:] == s[:-1]
    keep = np.append(same, False) | np.append(False, same)
    s, g = s[keep], g[keep]
    order = np.lexsort((g, s))
    s, g = s[order], g[order]
    new = np.append(True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])) if len(s) else np.zeros(0, dtype=bool)
    s, g = s[new], g[new]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(s)).astype(np.int64)[: len(starts)]
    found: dict[bytes, np.ndarray] = {}
    two = starts[ends - starts == 2]
    for a, b in np.unique(np.stack([g[two], g[two + 1]], 1), axis=0) if len(two) else ():
        found[np.array([a, b]).tobytes()] = np.array([a, b])
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 2:
            found[g[a:b].tobytes()] = g[a:b]
    rows = [(int(np.uint64(xxhash.xxh3_64_intdigest(k)).view(np.int64)), v) for k, v in found.items()]
    rows = [(lid, len(v), v[at : at + BLOCK].tolist()) for lid, v in rows for at in range(0, len(v), BLOCK)]
    for at in range(0, len(rows), LISTS_AT_ONCE):
        some = rows[at : at + LISTS_AT_ONCE]
        made = [pa.array([r[k] for r in some], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
        empty = [pa.nulls(len(some), like), *(pa.nulls(len(some), pa.int64()) for _ in range(3)), pa.nulls(len(some), pa.binary())]
        yield pa.RecordBatch.from_arrays([*made, *empty], names=names)


def _spot(*columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def _filter(spots: DataFrame) -> DataFrame:
    """(word, bits): a bit for every spot. At most FILTER_BITS / 64 rows, so it may be broadcast."""
    at = F.col("spot")
    return spots.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS INT))")).alias("bits"))


def _hits(docs: DataFrame, table: DataFrame, spot: F.Column) -> DataFrame:
    """docs with _hit: whether the filter has the row's spot. Nothing is shuffled."""
    marked = docs.withColumn("_spot", spot).withColumn("_word", F.shiftright("_spot", 6))
    joined = marked.join(F.broadcast(table), F.col("_word") == F.col("word"), "left")
    return joined.withColumn("_hit", F.coalesce(F.expr("getbit(bits, cast(_spot & 63 AS INT)) = 1"), F.lit(False))).drop("_spot", "_word", "word", "bits")


def elements_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gid, elements) of the sets in wanted (gid), and of a few others, read again from a text of each.

    A filter of fixed size lets through the chosen rows and a few others, whatever the size of
    wanted. Texts aren't shuffled. elements holds the sorted hashes' upper ELEMENT_BYTES bytes.
    """
    chosen = rows.where("gid IS NOT NULL").groupBy("gid").agg(F.min(F.struct("_id", "_hash")).alias("r")).join(wanted, "gid")
    hit = _hits(docs, _filter(chosen.select(_spot("r._id", "r._hash").alias("spot"))), _spot("_id", "_hash")).where("_hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch in slices(batches):
            found = []
            for data in batch.column(0).to_pylist():
                h = shingles(data, words)
                if len(h) and (g := set_id(h)) not in seen:
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add(g)
                    found.append((g, packed(h)))
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["gid", "elements"])

    return hit.select("_data").mapInArrow(run, "gid long, elements binary").dropDuplicates(["gid"])


def _dealt_first(lists: DataFrame, info: DataFrame) -> DataFrame:
    """Cells of the first round: blocks of a list, each with the list's first block beside it."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    each = lists.withColumn("blocks", blocks).select("lid", "blocks", F.explode("members").alias("gid"))
    by_set = each.groupBy("gid").agg(F.collect_list(F.struct("lid", "blocks")).alias("xs"))
    rows = by_set.join(info, "gid").withColumn("home", F.array_min("xs")["lid"])  # at most a list for each signature of the set
    rows = rows.select("gid", F.col("gid").alias("c"), "n", "sketch", "home", F.inline("xs"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    cells = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("cells", cells).withColumn("i", F.lit(0)).select("*", F.explode("cells").alias("j"))
    asks = (F.col("lid") == F.col("home")) & (F.col("own") == F.col("j"))
    return rows.select("lid", "i", "j", F.struct("gid", "c", "n", asks.alias("asks"), F.lit(True).alias("asked"), (F.col("own") == 0).alias("mark"), "sketch").alias("x"))


def _dealt_later(lists: DataFrame, info: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of a later round: the sets outside their list's largest component against all of it.

    Lists of one component are done. Of a list with m sets, s of them asking, a set is in s / BLOCK
    cells and one that asks in m / BLOCK more, so a large component costs a row a set.
    """
    rows = lists.select("lid", "m", F.explode("members").alias("gid")).join(labels.select(F.col("node").alias("gid"), "component"), "gid", "left")
    rows = rows.withColumn("c", F.coalesce("component", "gid")).drop("component")
    counts = rows.groupBy("lid", "c").agg(F.count("*").alias("k"))
    tops = counts.groupBy("lid").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all")).where("top.k < all")
    tops = tops.select("lid", F.col("top.c").alias("top"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("across"))
    rows = rows.join(tops, "lid").join(info, "gid").withColumn("stray", F.col("c") != F.col("top")).withColumn("down", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("i0", F.pmod(F.xxhash64("gid"), F.col("across")).cast("int")).withColumn("j0", F.pmod(F.xxhash64("gid"), F.col("down")).cast("int"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))
    as_asker = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j")))
    cells = F.when(F.col("stray"), F.array_union(as_member, as_asker)).otherwise(as_member)
    rows = rows.withColumn("cells", cells).select("*", F.inline("cells"))
    asks, asked = F.col("stray") & (F.col("i") == F.col("i0")), F.col("j") == F.col("j0")
    return rows.select("lid", "i", "j", F.struct("gid", "c", "n", asks.alias("asks"), asked.alias("asked"), F.col("stray").alias("mark"), "sketch").alias("x"))


def candidate_pairs(lists: DataFrame, info: DataFrame, labels: DataFrame | None, few: int | None) -> DataFrame:
    """(a, b): pairs of a list in different components that size and sketch allow; see ROUNDS.

    In a later round, a row (list, null) names a list in which `few` left pairs out.
    """
    dealt = _dealt_first(lists, info) if labels is None else _dealt_later(lists, info, labels)
    grouped = dealt.groupBy("lid", "i", "j").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    first = labels is None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LISTS_AT_ONCE):
                pairs = _choose_in(batch.slice(at, LISTS_AT_ONCE), few, first)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return grouped.select("lid", "j", "xs").mapInArrow(choose, "a long, b long").distinct()


def _choose_in(batch: pa.RecordBatch, few: int | None, first: bool) -> list[tuple[int, int | None]]:
    out: set[tuple[int, int]] = set()
    more: set[int] = set()
    xs = batch.column(2)
    flat, offsets = xs.flatten(), xs.offsets.to_numpy() - xs.offsets[0].as_py()
    g, c, n = (flat.field(k).to_numpy() for k in range(3))
    asks, asked, mark = (flat.field(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
    sketches = flat.field(6).to_pylist()
    for lid, j, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = slice(lo, hi)
        anchors = mark[own] if first and j else None
        if _choose(g[own], c[own], n[own], asks[own] | (first and hi - lo == 2), asked[own], mark[own] if few is None else None, anchors, sketches[lo:hi], few, out) and not first:
            more.add(lid)
    return [*sorted(out), *((lid, None) for lid in more)]


def _choose(g, c, n, asks, asked, stray, anchors, sketches, few, out: set[tuple[int, int]]) -> bool:
    """Adds the allowed pairs of one cell to out: of each set that asks, with the closest `few` asked.

    Returns whether some were left out.

    Row by row over sets sorted by size, so memory is linear in the cell. A partner is as wide as
    the set, or half or twice as wide; each width has a matrix of its own rows and the next, folded.
    Where all pairs are wanted, one of two strays meets in two cells and is taken in one. The
    closest of the anchors is taken besides.
    """
    order = np.argsort(n, kind="stable")
    g, c, n, asks, asked = g[order], c[order], n[order], asks[order], asked[order]
    stray, anchors = (x[order] if x is not None else None for x in (stray, anchors))
    sketches = [sketches[k] for k in order]
    last = np.searchsorted(n, n * 100 // PERCENT, side="right")
    width = np.array([len(x) for x in sketches])
    by_width: dict[int, tuple[int, np.ndarray]] = {}
    for w in np.unique(width).tolist():
        lo, mid, hi = (int(np.searchsorted(width, x)) for x in (w, w + 1, 2 * w + 1))
        rows = np.frombuffer(b"".join(sketches[lo:mid]), np.uint64).reshape(mid - lo, -1)
        if hi > mid:
            rows = np.vstack([rows, folded(np.frombuffer(b"".join(sketches[mid:hi]), np.uint64).reshape(hi - mid, -1))])
        by_width[w] = lo, rows
    more = False
    for i in np.flatnonzero(asks).tolist():
        lo, hi = int(np.searchsorted(last, i, side="right")), int(last[i])
        right = asked[lo:hi] & (c[lo:hi] != c[i])
        if stray is not None:
            right &= ~stray[lo:hi] | (g[lo:hi] > g[i])
        at = np.flatnonzero(right) + lo
        if not len(at):
            continue
        w = int(width[i])
        narrow = width[at] < w
        apart = np.zeros(len(at), dtype=np.int64)
        for part, of in ((narrow, w // 2), (~narrow, w)):
            if part.any():
                base, rows = by_width[of]
                apart[part] = np.bitwise_count(rows[at[part] - base] ^ (rows[i - base])).sum(1, dtype=np.int64)
        allowed = apart * (100 + PERCENT) <= (100 - PERCENT) * (n[at] + n[i])
        at, apart = at[allowed], apart[allowed]
        if few is not None and len(at) > few:
            more, near = True, np.argsort(apart, kind="stable")
            taken = near[:few]
            if anchors is not None and (far := near[few:][anchors[at[near[few:]]]]).size and not anchors[at[taken]].any():
                taken = np.append(taken, far[0])
            at = at[taken]
        for j in at.tolist():
            out.add((int(min(g[i], g[j])), int(max(g[i], g[j]))))
    return more


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("gid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("gid").alias("b"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch.column(2), batch.column(3)
            good = [linked(unpacked(x[i].as_py()), unpacked(y[i].as_py())) for i in range(batch.num_rows)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, text_hash, n_shingles, set_id, component_id) for every row of docs."""
    docs = docs.select(docs[id_column].alias("_id"), F.xxhash64(docs[text_column].cast("string")).alias("_hash"), docs[text_column].cast("string").cast("binary").alias("_data"))
    rows, lists = _signed(docs)
    lists = materialise(lists, "lists")
    listed = lists.select(F.explode("members").alias("gid")).distinct()
    known = rows.where("sketch IS NOT NULL").groupBy("gid").agg(F.first(F.struct("n", "sketch")).alias("s"))
    info = materialise(known.join(listed, "gid").select("gid", "s.*"), "info")
    edges: DataFrame | None = None
    labels: DataFrame | None = None
    spent = [lists, info]
    for few in ROUNDS:
        chosen = materialise(candidate_pairs(lists, info, labels, few), "pairs")
        pairs = chosen.where("b IS NOT NULL")
        spent.append(chosen)
        if labels is not None and pairs.isEmpty():
            break
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
        sets = materialise(elements_of(docs, rows, wanted), "elements")
        found = verify(pairs, sets)
        edges = materialise(found if edges is None else found.unionByName(edges), "links")
        labels = materialise(connected_components(edges), "labels")
        spent += [sets, edges, labels]
        # two sets of a list have met in the first round, and all that may link where a later one left none out
        unfinished = lists.where("m > 2") if few == ROUNDS[0] else lists.join(chosen.where("b IS NULL").select(F.col("a").alias("lid")), "lid", "left_semi")
        if unfinished.isEmpty():
            break
        lists = unfinished
    for table in spent:
        if table is not labels:
            discard(table)
    return _named(rows, labels).withColumnRenamed("_id", id_column)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component; sets first, so that copies count once."""
    own = rows.where("gid IS NOT NULL").groupBy("gid").agg(F.min("_id").alias("low"))
    own = own.join(labels.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    lows = own.groupBy("component").agg(F.min("low").alias("component_id"))
    by_set = own.join(lows, "component").select("gid", "component_id")
    joined = rows.join(by_set, "gid", "left")
    return joined.select("_id", F.col("_hash").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("gid").alias("set_id"), F.when(F.col("gid").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest doc_id's (null last), then by text hash.

    A document without words is a component of its own, but its copies under one id count once.
    A filter of fixed size passes most documents that stay without a join; the others are joined to
    the keys that go, and kept documents that occur more than once under one id and text are reduced
    to one. A doc_id that occurs with several texts counts as several documents.
    """
    found = components(docs)
    group = F.when(F.col("set_id").isNull(), F.struct(F.lit(1).alias("k"), F.xxhash64("doc_id").alias("g"))).otherwise(F.struct(F.lit(0).alias("k"), F.coalesce("component_id", "set_id").alias("g")))
    keys = found.withColumn("_group", group).groupBy("_group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = materialise(keys.withColumn("_rank", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))), "keys")
    best = keys.groupBy("_group").agg(F.min("_rank").alias("_best"))
    judged = keys.join(best, "_group").withColumn("_kept", F.col("_rank") == F.col("_best")).where("NOT _kept OR n > 1")
    odd = materialise(judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "_kept"), "odd")
    marked = docs.withColumn("_text_hash", F.xxhash64(docs["text"].cast("string")))
    marked = _hits(marked, _filter(odd.select(_spot("_id", "_th").alias("spot"))), _spot("doc_id", "_text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th"))
    sure = marked.where("NOT _hit").select(*docs.columns)
    once = marked.where("_hit").join(odd, same, "left_anti").select(*docs.columns)
    repeated = marked.where("_hit").join(odd.where("_kept"), same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
    return sure.unionByName(once).unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
