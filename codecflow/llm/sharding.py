"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and an added shard takes rows only into itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless, small_batches, table

SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
_MULTIPLIER = np.uint64(2862933555777941757)  # of the 64-bit linear congruential generator in the paper


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, in 0 .. shards - 1; all keys jump together until none is left inside."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = np.ascontiguousarray(keys).astype(np.int64, copy=False).view(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            key[live] = key[live] * _MULTIPLIER + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump = np.floor((at[live] + 1) * step).astype(np.int64)
            inside = jump < shards
            live = live[inside]
            at[live] = jump[inside]
    return at


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is `key`: doc_id and the number of shards decide alone, so rows never move but into an appended shard.
    A null doc_id is a key of its own, a null text counts as no bytes, repeated rows each get their slot, and an empty
    table gives an empty result. Slots are numbered from 0 without gaps in each shard.
    """
    rows = documents(docs)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64("doc_id").alias("key"))
    schema = "doc_id long, size long, text_crc32 long, shard long, grown_shard long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(jump_hash(keys, shards)), pa.array(jump_hash(keys, shards + 1))], ["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    placed = gapless(rows.mapInArrow(place, schema), "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return shard(table(spark, sf_dir, "documents"))
