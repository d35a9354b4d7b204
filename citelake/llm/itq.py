"""Embedding near-dedup by iterative quantisation, multi-index Hamming tables and exact reranking.

* Iterative quantisation: on at most SAMPLE vectors (those with the smallest hashes), principal
  directions are found, and a rotation of them is learned by turns of signs and orthogonal
  Procrustes steps, so that the sign bits of the rotated vector are balanced and lose little.
  CODES such rotations, from different starts, give a vector its code of CODES x dimension bits.
* Radius: codes are of centred vectors, and taking off a common mean widens angles. So the radius is
  measured: partners at COSINE are planted beside the sample's vectors, in any direction and towards
  other vectors of the sample, and the radius holds the share RECALL of each kind.
* Multi-index Hamming tables: a code is cut into tables, and codes within the radius differ by at most
  radius / tables bits in some table. Of these bits a vector is entered under its keys with up to
  half flipped, and looked up with the other half, so no pair within the radius is missed. How many
  tables there are is what costs least for the number of vectors: more of them mean narrower keys,
  which are cheap to enter and crowded, fewer mean wider keys with more flips. There is no cap on
  either, so look-ups grow more slowly than the square of the vectors at any number of them. A pair
  belongs to the first table in which it meets and to one key there, so no pair is listed twice;
  its whole codes must be within the radius.
* Rerank: cosine of the original vectors in double precision; a pair links at COSINE or more.

Vectors that are equal component by component are one class from the start: it meets others
once, and its copies link with each other and with all that it links with, by counts. Crowded table
keys are cut into blocks of BLOCK entries, and every pair of blocks is a task of its own, so none
is capped. Each length of vectors has its own index; lengths with at most PLAIN vectors are
compared whole. What the index finds is checked exactly; recall is measured in the tests on planted pairs,
with and without a common mean, and must be 0.9 or more.

Defined cases: a null or zero vector, or one with null or non-finite components or none, links with
nothing; vectors of different lengths don't link; rows that
repeat an id are separate vectors with that id in the links and one row in the result; a null id is
left out of components and returned alone; an empty table gives an empty table; columns other than
vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm.common import connected_components, materialise, read_table

COSINE = 0.95
SAMPLE = 4096
CODES = 1
TURNS = 30
#: Share of the pairs at COSINE, the hardest that link, whose codes the radius must hold.
RECALL = 0.98
#: Share of the bits that the radius is where there is no sample to measure it on.
RADIUS_SHARE = 0.17
WIDEST = 60  # bits of a key
PLAIN = 64  # vectors of a length that need no index
MEETING = 0.05  # what comparing two codes costs, in entries
BLOCK = 512
ENTRIES = 200_000  # handed on at once


class Quantiser:
    """Sign codes of a learned rotation; deterministic for a sample and seed."""

    def __init__(self, sample: np.ndarray, codes: int = CODES, seed: int = 2):
        self.dimension = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
        self.mean = unit.mean(0) if len(sample) else np.zeros(self.dimension)
        rng = np.random.default_rng(seed)
        directions = np.linalg.eigh((unit - self.mean).T @ (unit - self.mean))[1] if len(sample) else np.eye(self.dimension)
        parts = []
        for _ in range(codes):
            rotation = np.linalg.qr(rng.normal(size=(self.dimension, self.dimension)))[0]
            v = (unit - self.mean) @ directions
            for _ in range(TURNS if len(sample) > self.dimension else 0):
                left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
                rotation = (left @ right).T
            parts.append(directions @ rotation)
        self.rotation = np.hstack(parts)
        self.bits = self.rotation.shape[1]
        self.radius = self._radius(unit, rng) if len(sample) else int(RADIUS_SHARE * self.bits)

    def _radius(self, unit: np.ndarray, rng: np.random.Generator) -> int:
        """Bits in which the codes of RECALL of the planted pairs at COSINE differ at most."""
        a = np.tile(unit, (-(-SAMPLE // len(unit)), 1))[:SAMPLE]
        found = [0]
        for towards in (rng.normal(size=a.shape), a[rng.permutation(len(a))]):
            aside = towards - (towards * a).sum(1, keepdims=True) * a
            size = np.linalg.norm(aside, axis=1)
            some = size > 1e-6
            if some.any():
                b = COSINE * a[some] + np.sqrt(1 - COSINE**2) * aside[some] / size[some, None]
                apart = (self.encode(a[some]) != self.encode(b)).sum(1)
                found.append(int(np.quantile(apart, RECALL, method="higher")))
        return max(found)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bits (0 or 1)."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return ((unit - self.mean) @ self.rotation >= 0).astype(np.uint8)


class Tables:
    """How codes are cut into tables, and under which keys near a code's own it is entered and looked up."""

    def __init__(self, bits: int, n: int, radius: int | None = None):
        self.bits, self.radius = bits, int(RADIUS_SHARE * bits) if radius is None else radius
        count = min(range(-(-bits // WIDEST), bits + 1), key=lambda c: self.cost(c, n))
        self.edges = np.linspace(0, bits, count + 1).astype(int)
        # with radius < count x (flips + 1), a pair within the radius is near in one table at least
        self.flips = self.radius // count
        self.entered, self.asked = (self.flips + 1) // 2, self.flips // 2

    def cost(self, count: int, n: int) -> float:
        """Entries, look-ups and meetings of a vector with so many tables."""
        width, flips = -(-self.bits // count), self.radius // count
        ball = lambda f: sum(comb(width, k) for k in range(f + 1))
        entered, asked = ball((flips + 1) // 2), ball(flips // 2)
        return count * (entered + asked + MEETING * entered * asked * n / 2 ** (self.bits / count))

    def __len__(self) -> int:
        return len(self.edges) - 1

    def keys(self, codes: np.ndarray, t: int) -> np.ndarray:
        part = codes[:, self.edges[t] : self.edges[t + 1]].astype(np.int64)
        return part @ (1 << np.arange(part.shape[1], dtype=np.int64))

    def masks(self, t: int, flips: int) -> np.ndarray:
        """The bits to flip in a key of table t, at most `flips` of them."""
        width = int(self.edges[t + 1] - self.edges[t])
        return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(width), k)], dtype=np.int64)

    def own(self, differ: np.ndarray) -> np.ndarray:
        """Of the bits in which two keys differ, those that the entry flips where the pair belongs: the lowest."""
        left, out = differ.copy(), np.zeros_like(differ)
        for _ in range(self.entered):
            low = left & -left
            out |= low
            left ^= low
        return out


def parsed_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): v the vector; null if it can't link."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    good = F.size(v) > 0
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return table.select("vec_id", F.when(good & finite & nonzero, v).alias("v"))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        part = column if len(rows) == len(sizes) else column.take(pa.array(rows))
        yield size, rows, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


Index = dict[int, tuple[Quantiser, Tables]]


def candidates(classes: DataFrame, index: Index) -> DataFrame:
    """(a, b), a < b: classes whose codes meet in a table of their length and lie within the radius; each pair once."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for size, rows, matrix in _by_size(batch.column(1)):
                ids = every[rows]
                if size not in shared.value:
                    yield _entries(size, 0, np.zeros(2 * len(ids), dtype=np.int64), np.repeat([0, 1], len(ids)), np.tile(ids, 2), np.full(2 * len(ids), b"", dtype=object))
                    continue
                q, t_ = shared.value[size]
                codes = q.encode(matrix)
                blobs = np.array([r.tobytes() for r in np.packbits(codes, axis=1)], dtype=object)
                for t in range(len(t_)):
                    key = t_.keys(codes, t)
                    for role, flips in ((0, t_.entered), (1, t_.asked)):
                        masks = t_.masks(t, flips)
                        for at in range(0, len(ids), step := max(1, ENTRIES // len(masks))):
                            who = np.repeat(np.arange(at, min(at + step, len(ids))), len(masks))
                            keys = (key[at : at + step, None] ^ masks[None]).ravel()
                            yield _entries(size, t, keys, np.full(len(keys), role), ids[who], blobs[who])

    entries = classes.select("id", "v").mapInArrow(enter, "size int, t int, key long, role int, id long, code binary")
    # look-ups without an entry, and entries without a look-up of another class, end here
    sizes = entries.groupBy("size", "t", "key").agg(F.min("id").alias("_a"), F.max("id").alias("_b"), F.count("*").alias("_n")).where("_a < _b")
    sizes = sizes.select("size", "t", "key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    met = entries.join(sizes, ["size", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left, right = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))
    items = met.select("size", "t", "key", left.alias("i"), right.alias("j"), F.struct("role", "id", "code").alias("x"))
    grouped = items.groupBy("size", "t", "key", "i", "j").agg(F.collect_list("x").alias("xs"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
                out += _meet_all(part, *shared.value.get(size, (None, None)))
            pairs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return grouped.select("size", "t", "key", "xs").mapInArrow(meet, "a long, b long")


def _entries(size: int, t: int, keys: np.ndarray, roles: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    ints = [np.full(n, size, dtype=np.int32), np.full(n, t, dtype=np.int32), keys, roles.astype(np.int32), ids]
    return pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array(codes, pa.binary())], names=["size", "t", "key", "role", "id", "code"])


def _meet_all(batch: pa.RecordBatch, _: Quantiser | None, tables: Tables | None) -> list[np.ndarray]:
    """The pairs of the blocks of one length; without tables, all."""
    out = []
    ts, keys, xs = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
    flat, offsets = xs.flatten(), xs.offsets.to_numpy() - xs.offsets[0].as_py()
    role, ids = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    if tables:
        raw = np.frombuffer(b"".join(flat.field(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        codes = np.unpackbits(raw, axis=1)[:, : tables.bits]
        parts = np.stack([tables.keys(codes, t) for t in range(len(tables))], 1)
        words = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)
    for t, key, lo, hi in zip(ts.tolist(), keys.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        entered, asked = np.flatnonzero(role[lo:hi] == 0) + lo, np.flatnonzero(role[lo:hi] == 1) + lo
        if not len(entered) or not len(asked):
            continue
        if tables:
            found = _meet(ids, words, parts, key, entered, asked, t, tables)
        else:
            i, j = np.nonzero(ids[entered][:, None] < ids[asked][None])
            found = np.stack([ids[entered[i]], ids[asked[j]]], 1)
        if found is not None:
            out.append(found)
    return out


def _meet(ids: np.ndarray, words: np.ndarray, parts: np.ndarray, key: int, e: np.ndarray, q: np.ndarray, t: int, tables: Tables) -> np.ndarray | None:
    """Pairs (entry id < look-up id) of one block that belong to this table and key."""
    apart = np.bitwise_count(words[e][:, None] ^ words[q][None]).sum(2, dtype=np.int32)
    i, j = np.nonzero((apart <= tables.radius) & (ids[e][:, None] < ids[q][None]))
    if not len(i):
        return None
    i, j = e[i], q[j]
    differ = parts[i] ^ parts[j]  # by table
    mine = (parts[i, t] ^ key) == tables.own(differ[:, t])
    mine &= (np.bitwise_count(differ[:, :t]) > tables.flips).all(1)  # and no earlier table owns the pair
    return np.stack([ids[i[mine]], ids[j[mine]]], 1)


def links(pairs: DataFrame, classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The pairs whose vectors have the cosine, in double precision."""
    a, b = (classes.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for (_, rows, x), (_, _, y) in zip(_by_size(batch.column(2)), _by_size(batch.column(3)), strict=True):
                good[rows] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def built_index(classes: DataFrame, sample: int = SAMPLE) -> Index:
    """Quantiser and tables of every length with more than PLAIN vectors."""
    index: Index = {}
    for shape in classes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > PLAIN).collect():
        drawn = classes.where(F.size("v") == shape["size"]).orderBy("id").limit(sample).select("v").collect()
        quantiser = Quantiser(np.array([r["v"] for r in drawn], dtype=np.float64))
        index[shape["size"]] = quantiser, Tables(quantiser.bits, shape["n"], quantiser.radius)
    return index


def near_duplicates(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vec_id."""
    vectors = materialise(parsed_vectors(table).withColumn("cls", F.md5(F.to_json(F.struct("v")))), "vectors")
    good = vectors.where("v IS NOT NULL AND vec_id IS NOT NULL")
    # a class is named by its smallest vec_id; an id that repeats with other vectors names each by a hash
    grouped = good.groupBy("cls").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialise(grouped.select(F.xxhash64("cls").alias("id"), "low", "copies", "v"), "classes")
    found = materialise(links(candidates(classes, built_index(classes)), classes), "links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    labels = connected_components(found)
    named = classes.join(counts, classes["id"] == counts["a"], "left").join(labels, F.col("id") == F.col("node"), "left")
    named = named.select("id", "low", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "id").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = named.join(lows, "component").select(F.col("id").alias("_cls"), (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("cls")).alias("_cls"))
    joined = rows.join(by_class, "_cls", "left")
    once = joined.groupBy("vec_id").agg(F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"), F.coalesce(F.min("component_id"), F.col("vec_id")).alias("component_id"))
    return once.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
