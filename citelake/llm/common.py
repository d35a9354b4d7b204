"""What the operators of this subpackage share: tables, shared storage, batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Rows of whole texts are long: Arrow batches of the default 10,000 rows would take tens of MB on both sides.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Lowers the session's Arrow batch size, if it is higher than whole texts allow."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= MOST_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(MOST_ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a temporary folder is used in local mode only; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="citelake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_written: list[list[str]] = []  # folders of materialise() in each open scratch(), innermost last


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage.

    lasting: the table outlives the scratch() around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citelake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written and not lasting:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that materialise() wrote inside; none may be read later."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            _remove(spark, path)


def discard(df: DataFrame) -> None:
    """Remove a table of materialise() that no later step reads."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/citelake/" in folder:
            _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame, per_partition: int = 1) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per_partition


def released() -> None:
    """Give a worker's free memory back, as it may stay idle beside the next stage's workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of a batch is in Python objects at a time."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        released()


def map_texts(docs: DataFrame, id_column: str, text_column: str, schema: str, make: Callable[[], Callable[[list], dict[str, list]]], rows: int = 500) -> DataFrame:
    """id_column and the columns that make()'s function gives for each list of texts.

    make() runs once in each Python task; its function sees at most `rows` texts (str or None) at a
    time and returns a list for each column of schema. The id column passes through as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(StructType.fromDDL(schema))
    key = docs.schema[id_column]
    whole = StructType([StructField("i", key.dataType), *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in slices(batches, rows):
            out = function(part.column(1).to_pylist())
            arrays = [pa.array(out[f.name], type=f.type) for f in made]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["i", *made.names])

    source = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    return source.mapInArrow(run, whole).withColumnRenamed("i", id_column)


# -- connected components ------------------------------------------------------------------


#: Edges that one task can finish in bounded memory (some 100 MB); beyond it, star steps run over all tasks.
ONE_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as a forest of stars, which has the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:  # bounded memory: hand the stars on and start afresh
            yield _stars(parent, root)
            parent.clear()
    yield _stars(parent, root)


def _stars(parent: dict[int, int], root: Callable[[int], int]) -> pa.RecordBatch:
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reached.

    Alternating large-star and small-star steps on a distributed edge table. Each step takes the
    smallest neighbour by a grouped minimum and joins it back, so a hub is never gathered in one
    row; the driver sees two numbers a step. Each task first replaces its edges by stars; a table of
    ONE_TASK edges or fewer, by its count, is finished by one task in the same way. Edges
    with a null end and loops are ignored; an empty table gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_forest, "a long, b long")
    current = materialise(edges.distinct(), "edges")
    state = _state(current)
    if state[0] <= ONE_TASK:
        return _roots(current.coalesce(1).mapInArrow(_forest, "a long, b long"))
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        following = materialise(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(current)
        current, before = following, state
        state = _state(current)
        if state == before:
            break
    return _roots(current)


def _roots(stars: DataFrame) -> DataFrame:
    low = stars.groupBy("a").agg(F.min("b").alias("component"))
    return low.select(F.col("a").alias("node"), "component").unionByName(low.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def split_mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (public SplitMix64 finaliser) over a uint64 array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
