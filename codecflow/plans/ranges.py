"""Indexes of bzip2 objects and byte ranges read through them: only the blocks that a range touches are decoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadIndex
from ..functions.checksums import source_identity
from ..operators import bzip2
from ..operators.relational import index_violations
from .dealing import deal
from .layout import _per_object

INDEX = "path string, container long, number long, compressed_start_bit long, compressed_end_bit long, decoded_start long, decoded_bytes long, expected_crc long, level int"


def build_index(objects: DataFrame, column: str = "content") -> DataFrame:
    """Blocks with the level of their stream and the identity (length and SHA-256) of their object, from a full decode."""
    identity = objects.select("path", F.octet_length(F.col(column)).cast("long").alias("source_len"), source_identity(F.col(column)).alias("source_sha256"))
    return _per_object(objects, column, INDEX, _leveled).join(identity, "path")


def _leveled(data: bytes) -> Iterator[dict]:
    streams, found = bzip2.layout(data)
    levels = {s["number"]: s["block_size_100k"] for s in streams}
    for b in found:
        yield b | {"container": b["stream"], "level": levels[b["stream"]]}


def save_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    index.write.mode(mode).partitionBy("path").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check_index(index: DataFrame, objects: DataFrame, column: str = "content") -> DataFrame:
    """(path, rule) of everything that makes the index unfit for the objects; empty when it fits."""
    seen = objects.select("path", F.octet_length(F.col(column)).cast("long").alias("len"), source_identity(F.col(column)).alias("sha"))
    of = index.select("path", "source_len", "source_sha256").distinct().join(seen, "path", "left")
    wrong = of.where(F.col("len").isNull() | (F.col("len") != F.col("source_len")) | (F.col("sha") != F.col("source_sha256"))).select("path", F.lit("another source").alias("rule"))
    beyond = index.where(F.col("compressed_end_bit") > 8 * F.col("source_len")).select("path", F.lit("beyond the source").alias("rule"))
    return wrong.unionByName(beyond).unionByName(index_violations(index).select("path", "rule")).distinct()


def require_index(index: DataFrame, objects: DataFrame, column: str = "content") -> None:
    bad = check_index(index, objects, column).take(1)
    if bad:
        raise BadIndex(f"{bad[0]['path']}: {bad[0]['rule']}")


def place(offset: Column, size: Column, whence: int = 0, position: Column | None = None) -> Column:
    """The place that a seek goes to, from the start (0), the position (1) or the end (2); null outside [0, size]."""
    at = {0: offset, 1: (position if position is not None else F.lit(0)) + offset, 2: size + offset}[whence]
    return F.when((at >= 0) & (at <= size), at)


def touched(requests: DataFrame, index: DataFrame) -> DataFrame:
    """requests(request, path, start, length) with the blocks that hold a part of each: a range join within a path."""
    r, b = requests.alias("r"), index.alias("b")
    end = F.col("r.start") + F.col("r.length")
    on = (F.col("r.path") == F.col("b.path")) & (F.col("b.decoded_start") < end) & (F.col("b.decoded_start") + F.col("b.decoded_bytes") > F.col("r.start"))
    return r.join(b, on).select("r.request", "r.path", "r.start", "r.length", "b.number", "b.compressed_start_bit", "b.compressed_end_bit", "b.decoded_start", "b.decoded_bytes", "b.expected_crc", "b.level")


def read_ranges(requests: DataFrame, index: DataFrame, objects: DataFrame, column: str = "content") -> DataFrame:
    """(request, content) of requests(request, path, start, length): every touched block is cut out and decoded once,
    however many requests share it; ranges reach to the end of an object at most, and an empty one gives no bytes."""
    parts = touched(requests, index)
    wanted = parts.select("path", "number", "compressed_start_bit", "compressed_end_bit", "decoded_bytes", "expected_crc", "level").distinct()
    first = F.floor(F.col("compressed_start_bit") / 8)
    cut = wanted.join(objects.select("path", F.col(column).alias("__content")), "path").select("path", "number", (F.col("compressed_start_bit") - 8 * first).alias("lo"), (F.col("compressed_end_bit") - 8 * first).alias("hi"), "decoded_bytes", "expected_crc", "level", F.col("__content").substr((first + 1).cast("int"), (F.ceil(F.col("compressed_end_bit") / 8) - first).cast("int")).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo, hi, n, crc, level, piece in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "decoded_bytes", "expected_crc", "level", "piece"))):
                plain = bzip2.decode_block(piece, lo, hi, level, crc)
                if len(plain) != n:
                    raise BadIndex("a block's length is not that of the index")
                out.append(plain)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("number"), pa.array(out, pa.binary())], ["path", "number", "plain"])

    decoded = deal(cut, "path", "number").mapInArrow(run, "path string, number long, plain binary")
    lo = F.greatest(F.col("start") - F.col("decoded_start"), F.lit(0))
    hi = F.least(F.col("start") + F.col("length") - F.col("decoded_start"), F.col("decoded_bytes"))
    pieces = parts.join(decoded, ["path", "number"]).select("request", "number", F.col("plain").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    hexed = pieces.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.hex("part").alias("h")))), lambda x: x["h"]), "").alias("h"))
    return requests.select("request").join(hexed, "request", "left").select("request", F.unhex(F.coalesce("h", F.lit(""))).alias("content"))
