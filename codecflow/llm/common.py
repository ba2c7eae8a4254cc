"""Helpers shared by the training-data operators: reading, checkpoints, numbering, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import discard, kept  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch that carries whole texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Columns that numbering within tasks adds: the task, and a row's number there.
TASK, LOCAL = "__task", "__local"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches that cross into Python hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that run inside go as soon as each job ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read from there: lineage ends, and a lost executor loses nothing."""
    with tidy(df.sparkSession):
        return kept(df)


def documents(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever other columns docs has."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def crc32_of_id(doc_id) -> F.Column:
    """crc32 of the decimal text of an id; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def gapless(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds `out`: numbers from 0 without gaps within each value of the non-null long column `key`.

    Rows are numbered inside the task that made them and checkpointed; only the counts of each (task, key) are then
    summed, so no key is ever sorted or gathered in one place, whatever share of the rows it has.
    """
    tagged = df.withColumn(TASK, F.spark_partition_id().cast("long"))
    schema = tagged.withColumn(LOCAL, F.lit(0).cast("long")).schema
    return gapless_over_tasks(tagged.mapInArrow(functools.partial(numbered, key=key), schema), key, out)


def numbered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The batches of one task with LOCAL: numbers from 0 without gaps within each value of `key` in that task."""
    seen: dict[int, int] = {}
    for b in batches:
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        local = np.empty(len(keys), np.int64)
        at = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else []
        for lo, hi in zip(at, [*at[1:], len(keys)]):
            k = int(keys[order[lo]])
            first = seen.get(k, 0)
            local[order[lo:hi]] = np.arange(first, first + hi - lo)
            seen[k] = first + int(hi - lo)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], [*b.schema.names, LOCAL])


def gapless_over_tasks(df: DataFrame, key: str, out: str) -> DataFrame:
    """gapless() of rows that have TASK and LOCAL already, from the worker that made them: a task then needs no second one."""
    tagged = checkpointed(df)
    w = Window.partitionBy(key).orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)
    first = tagged.groupBy(key, TASK).agg(F.count("*").alias("n")).select(key, TASK, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__first"))
    return tagged.join(first, [key, TASK]).withColumn(out, F.col("__first") + F.col(LOCAL)).drop("__first", LOCAL, TASK)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn until the edges are stars. All edges stay distributed; each round is
    checkpointed, so that lineage stays short and a lost executor costs one round at most.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    before = None
    while True:
        # minima are summed up before they are shuffled, and joined again: no node, however many neighbours, is one window
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, old = checkpointed(small), e
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFFFF)))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())
        before = now


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i]): pairs (member, smallest member), each member once."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def tokenizer_path(name: str, path: str | None = None) -> str:
    """path, or else the place of a public vocabulary file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """A Python worker has one core; numeric libraries are not to start more threads."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def release() -> None:
    """Gives a Python worker's freed memory back: workers live on between tasks, and their allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its worker holds no memory that it does not use: the next one may need it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
