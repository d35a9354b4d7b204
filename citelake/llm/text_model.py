"""A small text classifier: softmax regression on word presence and style, fitted on labelled rows.

Features of a whole text: which hashed words occur (ASCII white space separates words, letters are
lowered) and a few style shares from its byte histogram. Fitting takes at most SAMPLE labelled
documents, those with the smallest hashes of their ids, so the driver's share is bounded; scoring
takes every document, in one pass and without a shuffle. Words in fewer than LEAST_DOCUMENTS of
the sample get no weight, nor do words whose counts in no class are LEAST_DEVIATIONS standard
deviations from what chance gives. Of the sample, every fifth document is held out, to scale the scores to
probabilities by one temperature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from citelake.llm.common import slices

SAMPLE = 4000
HASH_BITS = 18
LEAST_DOCUMENTS = 8
LEAST_DEVIATIONS = 3.5
WORDS_CACHED = 150_000
STYLE = 14


class Words(dict):
    """word -> hashed index, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        self[word] = at = xxhash.xxh3_64_intdigest(word) & ((1 << HASH_BITS) - 1)
        return at


_CLASSES = np.zeros((8, 256), dtype=np.float64)
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"*&%$#@^~", b"|<>{}[]\\/=+_", b".,;:?", b" ", b"\n")):
    _CLASSES[_row, list(_bytes)] = 1


def describe(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct word indices, style features and the number of words of a whole text."""
    data = (text or "").encode("utf-8")
    found = data.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(STYLE), 0
    kinds = set(found)
    index = np.unique(np.fromiter(map(words.__getitem__, kinds), dtype=np.int64, count=len(kinds)))
    shares = _CLASSES @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / len(data)
    repeats = sum(map(bytes.__eq__, found, found[1:])) / n
    style = [*np.sqrt(shares), len(kinds) / n, repeats, np.log1p(n), np.log(len(data) / n), float(n < 5), 1.0]
    return index, np.array(style), n


class TextModel:
    def __init__(self, classes: int):
        self.classes = classes

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 300) -> TextModel:
        """Full-batch AdaGrad on L2-penalised cross-entropy; deterministic."""
        held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
        counts = np.bincount(np.concatenate([r[0] for r in rows] or [np.zeros(0, dtype=np.int64)]), minlength=1 << HASH_BITS)
        self.kept = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        telling = np.zeros(1 << HASH_BITS)
        for c in range(self.classes):
            share = (y == c).mean() if len(y) else 0.0
            own = np.bincount(np.concatenate([r[0] for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, dtype=np.int64)]), minlength=1 << HASH_BITS)
            telling = np.maximum(telling, np.abs(own - counts * share) / np.sqrt(counts * share * (1 - share) + 1e-9))
        chosen = np.flatnonzero((counts >= LEAST_DOCUMENTS) & (telling >= LEAST_DEVIATIONS))
        self.kept[chosen] = np.arange(len(chosen))
        style = np.array([r[1] for r in rows]).reshape(len(rows), STYLE)
        self.mean, self.scale = (style.mean(0), style.std(0) + 1e-6) if len(rows) else (np.zeros(STYLE), np.ones(STYLE))
        self.scale[-1], self.mean[-1] = 1.0, 0.0  # the constant
        style = (style - self.mean) / self.scale
        self.style_weights = np.zeros((STYLE, self.classes))
        self.word_weights = np.zeros((len(chosen), self.classes))
        own = [k[k >= 0] for k in (self.kept[r[0]] for r in rows)]
        use = np.flatnonzero(~held)
        at_row = np.repeat(np.arange(len(use)), [len(own[i]) for i in use])
        at_word = np.concatenate([own[i] for i in use]) if len(use) else np.zeros(0, dtype=np.int32)
        target = np.eye(self.classes)[y[use]]
        sums = [np.full_like(self.style_weights, 1e-8), np.full_like(self.word_weights, 1e-8)]
        for _ in range(rounds if len(use) else 0):
            z = style[use] @ self.style_weights
            for c in range(self.classes):
                z[:, c] += np.bincount(at_row, self.word_weights[at_word, c], len(use))
            d = _softmax(z) - target
            grads = [style[use].T @ d / len(use) + 1e-4 * self.style_weights]
            words = np.stack([np.bincount(at_word, d[at_row, c], len(chosen)) for c in range(self.classes)], 1)
            grads.append(words / len(use) + 1e-4 * self.word_weights)
            for w, g, s in zip((self.style_weights, self.word_weights), grads, sums, strict=True):
                s += g * g
                w -= 0.2 * g / np.sqrt(s)
        self.share = (target.sum(0) + 0.5) / (len(use) + 0.5 * self.classes)
        self.temperature = 1.0
        check = np.flatnonzero(held)
        if len(check):
            z = np.stack([self.scores(*rows[i]) for i in check])
            loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
            self.temperature = min(np.geomspace(0.5, 8, 33), key=loss)
        return self

    def scores(self, index: np.ndarray, style: np.ndarray) -> np.ndarray:
        own = self.kept[index]
        return ((style - self.mean) / self.scale) @ self.style_weights + self.word_weights[own[own >= 0]].sum(0)

    def posterior(self, index: np.ndarray, style: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(index, style)[None] / self.temperature)[0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_on_labels(docs: DataFrame, labels: DataFrame, label_columns: tuple[str, ...], sample: int = SAMPLE) -> TextModel:
    """The classifier of the combined 0/1 label columns: class number = their bits, first column highest.

    Labels that are null or not 0/1, or whose doc_id is null or not in docs, are left out. Without
    any labelled document all classes are equally likely.
    """
    classes = 1 << len(label_columns)
    code = sum((F.col(c).cast("int") * (1 << (len(label_columns) - 1 - i)) for i, c in enumerate(label_columns)), F.lit(0))
    valid = labels.where(" AND ".join(["doc_id IS NOT NULL", *(f"{c} IN (0, 1)" for c in label_columns)]))
    keyed = valid.select(F.col("doc_id").alias("_id"), code.alias("_class"))
    drawn = F.broadcast(keyed.orderBy(F.xxhash64("_id"), "_id", "_class").limit(2 * sample))  # bounded by the parameter
    rows = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text")).join(drawn, "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            made = [describe(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int64()), pa.array([m[0].tolist() for m in made], type=pa.list_(pa.int64())), pa.array([m[1].tolist() for m in made], type=pa.list_(pa.float64()))],
                names=["id", "y", "index", "style"],
            )

    schema = StructType([StructField("id", docs.schema["doc_id"].dataType), StructField("y", LongType()), StructField("index", ArrayType(LongType())), StructField("style", ArrayType(DoubleType()))])
    found = rows.select("_id", "_text", "_class").mapInArrow(features, schema)
    table = found.orderBy(F.xxhash64("id"), "id", "y").limit(sample).toPandas()
    pairs = [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.float64)) for a, b in zip(table["index"], table["style"], strict=True)]
    return TextModel(classes).fit(pairs, table["y"].to_numpy(dtype=np.int64))


def with_posteriors(
    docs: DataFrame, model: TextModel, posterior: str, tokens: str | None = None, keep: list[str] | None = None, derived: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None
) -> DataFrame:
    """docs (or its columns `keep`) with an array column of class posteriors and, if named, word counts.

    derived: the name of a column of doubles, and what makes it of the posteriors' matrix.
    Columns of docs that bear these names are replaced. No shuffle; the model (bounded) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (posterior, tokens, derived and derived[0])]
    fields = [docs.schema[c] for c in kept] + [StructField(posterior, ArrayType(DoubleType()))] + ([StructField(tokens, LongType())] if tokens else []) + ([StructField(derived[0], DoubleType())] if derived else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), shared.value
        for batch in slices(batches):
            made, counts = [], []
            for text in batch.column(0).to_pylist():
                index, style, n = describe(text, words)
                made.append(known.posterior(index, style).tolist())
                counts.append(n)
            arrays = [*batch.columns[1:], pa.array(made, type=pa.list_(pa.float64()))] + ([pa.array(counts, type=pa.int64())] if tokens else [])
            if derived:
                arrays.append(pa.array(derived[1](np.array(made).reshape(-1, known.classes)), type=pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    source = docs.select(docs["text"].alias("_scored"), *(docs[c] for c in kept))
    return source.mapInArrow(run, StructType(fields))
