"""Document fingerprints: I-Match over randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band of the corpus, LOW to HIGH of
all documents (an inverse-document-frequency band of ln(1/HIGH) to ln(1/LOW)). Frequencies are
counted exactly over all documents. As each document adds its distinct terms once, at most (mean
distinct terms a document) / LOW terms can reach the band, however large the corpus; so the lexicon
has a proven bound and travels as one literal, bucketed by hash for a constant-time look-up.

The SUBSETS randomised lexicon subsets overlap and together hold the whole lexicon: the upper bits of a
term's hash deal it to one of them, and one term in TWICE is in a second one. Subsets are many and small,
as one changed term changes the hash of each subset that holds it. A document's distinct terms in a subset
are sorted and hashed, and the fingerprint is the list of those hashes, each with its subset in the upper bits. A
document with no term in the lexicon is fingerprinted on all of its distinct terms, so equal texts always
have equal fingerprints. The likeness of two fingerprints is the share of subsets, not empty in both,
whose hashes agree; equal fingerprints have likeness 1.

Terms are hashed to 64 bits. Each document meets the next one (descending doc_id) in a window over a
quantile range of doc_id of about RANGE_ROWS documents (more where that would take over MOST_RANGES
ranges); an id with many rows is spread over ranges of its own by a hash of the text. The last of a
range gets the first of the following range from a table of a row a range. Texts are shuffled once.

Defined cases: a null text counts as empty; equal ids are ordered by a hash of their texts; null
ids come last, spread by that hash; a lone document is its own next; an empty table gives an empty
table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.llm.common import read_table

LOW, HIGH = 0.002, 0.15
SUBSETS, TWICE = 64, 8
SHIFT = 58  # the bits below a subset's number
RANGE_ROWS, MOST_RANGES = 500, 20_000
SPREAD = 64  # ranges of an id with many rows, and of null ids
LOOKUP = 1 << 12
SEPARATORS = r"[\s\p{Punct}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased terms of a text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATORS)), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def keys(known: Column) -> Column:
    """The lexicon terms of a document by subset, sorted: a term's own hash, and its copies for a second subset."""
    low = F.lit((1 << SHIFT) - 1)

    def second(term: Column) -> Column:
        other = F.shiftright(term, SHIFT) + 1 + F.pmod(F.shiftright(term, 3), F.lit(SUBSETS - 1))
        return F.shiftleft(other.cast("long"), SHIFT).bitwiseOR(term.bitwiseAND(low))

    twice = F.transform(F.filter(known, lambda t: t.bitwiseAND(F.lit(TWICE - 1)) == 0), second)
    return F.sort_array(F.concat(known, twice))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, df) of the terms in the band, by hash; df counts documents."""
    total = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= max(2.0, low * total)) & (F.col("df") <= high * total))


def lookup(found: DataFrame) -> Column:
    """The lexicon as one constant: an array of LOOKUP small arrays."""
    cells: list[list[int]] = [[] for _ in range(LOOKUP)]
    for row in found.select("term", F.pmod("term", F.lit(LOOKUP)).alias("at")).collect():  # bounded: see the module's docstring
        cells[row["at"]].append(row["term"])
    text = "[" + ",".join("[" + ",".join(map(str, sorted(c))) + "]" for c in cells) + "]"
    return F.from_json(F.lit(text), "array<array<bigint>>")


def fingerprint(text: Column, table: Column) -> Column:
    """Array of the hashes of the subsets that aren't empty, or of one where no term is in the lexicon."""

    def known(term: Column) -> Column:
        return F.array_contains(F.element_at(table, (F.pmod(term, F.lit(LOOKUP)) + 1).cast("int")), term)

    def of_keys(every: Column) -> Column:
        found = _bound(keys(F.filter(every, known)), _subsets)
        return _bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.xxhash64(F.sort_array(every)))))

    return _bound(terms(text), of_keys)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a transform over the array that holds it alone."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _subset(key: Column) -> Column:
    return F.shiftright(key, SHIFT)


def _subsets(found: Column) -> Column:
    """The hash of each subset's keys, which are one stretch of the sorted ones."""
    places = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: ~_subset(F.get(found, i - 1)).eqNullSafe(_subset(F.get(found, i - 2))))

    def hashes(first: Column) -> Column:
        def stretch(at: Column, k: Column) -> Column:
            following = F.coalesce(F.get(first, k + 1), F.size(found) + 1)
            digest = F.xxhash64(F.slice(found, at, following - at)).bitwiseAND(F.lit((1 << SHIFT) - 1))
            return F.shiftleft(_subset(F.get(found, at - 1)), SHIFT).bitwiseOR(digest)

        return F.transform(first, stretch)

    return _bound(begins, hashes)


def likeness(a: Column, b: Column) -> Column:
    full = F.size(F.array_union(F.transform(a, _subset), F.transform(b, _subset)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / full)


# -- the next document and the edited text ---------------------------------------------------


def _spread(value: Column) -> Column:
    return F.pmod(F.shiftright(value, 58), F.lit(SPREAD))


def _above(cuts: list[int]) -> Column:
    """How many of the sorted distinct cuts are above doc_id, by looking in one of about sqrt(n) groups of them."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    last = F.from_json(F.lit(str([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    below = F.size(F.filter(last, lambda c: c <= F.col("doc_id")))  # groups that are not above at all
    inside = F.coalesce(F.size(F.filter(F.get(inner, below), lambda c: c > F.col("doc_id"))), F.lit(0))
    rest = F.greatest(F.lit(0), F.lit(len(cuts)) - (below + 1) * width)
    return F.when(below >= len(groups), F.lit(0)).otherwise(inside + rest)


def _ranges(docs: DataFrame, rows: int) -> Column:
    """A document's range: 0 for the largest ids, ascending as ids descend; null ids come last."""
    total = docs.count()
    n = max(1, min(MOST_RANGES, -(-total // rows)))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("c")).first()["c"] or []
    cuts, spread = sorted(set(found)), SPREAD - 1 - _spread(F.col("_h"))
    many = sorted(c for c, k in Counter(found).items() if k > 1)  # ids with the rows of two ranges or more
    crowded = F.array_contains(F.from_json(F.lit(str(many)), "array<bigint>"), F.col("doc_id").cast("long")) if many else F.lit(False)
    known = _above(cuts) * SPREAD + F.when(crowded, spread).otherwise(F.lit(0))
    return F.when(F.col("doc_id").isNotNull(), known).otherwise(F.lit((len(cuts) + 1) * SPREAD) + spread).cast("long")


def with_next(docs: DataFrame, made: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, made (a column expression over text) and next, the same of the next document."""
    spark = docs.sparkSession
    keyed = docs.withColumn("_h", F.xxhash64("text")).withColumn("_range", _ranges(docs, rows))
    order = F.struct("doc_id", _spread(F.col("_h")).alias("s"), "_h")  # nulls are smallest, so they come last
    # The first document of each range, found by its id and hash; a row a range.
    heads = keyed.groupBy("_range").agg(F.max(order).alias("k")).select("_range", "k.doc_id", "k._h").collect()
    heads = sorted(heads, key=lambda r: r["_range"])
    kinds = f"_before long, _id {docs.schema['doc_id'].dataType.simpleString()}, _hash long"
    follow = spark.createDataFrame([(heads[i - 1]["_range"], h["doc_id"], h["_h"]) for i, h in enumerate(heads)], kinds)
    found = keyed.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    edges = found.groupBy("_before").agg(F.first(F.struct("text", made.alias("made"))).alias("_edge"))  # copies are alike
    window = Window.partitionBy("_range").orderBy(order.desc())
    each = keyed.withColumn("made", made).withColumn("_next", F.lead(F.struct("text", "made")).over(window))
    joined = each.join(edges, F.col("_range") == F.col("_before"), "left")
    return joined.select("doc_id", "text", "made", F.coalesce("_next", "_edge").alias("next"))


def written(made: Column) -> Column:
    return F.array_join(F.transform(made, lambda h: F.hex(h)), ".")


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, edited, and the fingerprints of text, edited and the next text, as arrays."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = lookup(lexicon(docs))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = with_next(docs, fingerprint(F.col("text"), table), range_rows)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    return rows.select("doc_id", "text", "edited", F.col("made").alias("own"), fingerprint(F.col("edited"), table).alias("of_edited"), F.col("next.made").alias("of_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )
