"""Checksums as columns: Catalyst where it has them, Arrow batches elsewhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import checksums as C


def gzip_crc32(x: Column) -> Column:
    return F.crc32(x)


def source_identity(x: Column) -> Column:
    return F.sha2(x, 256)


def fold_stream_crc(crcs: Column) -> Column:
    """A bzip2 stream's checksum from the array of its blocks' checksums in order."""
    low = F.lit(0xFFFFFFFF)
    turn = lambda a: F.shiftleft(a, 1).bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(a, 31))
    return F.aggregate(crcs, F.lit(0).cast("long"), lambda a, c: turn(a).bitwiseXOR(c.cast("long")))


def _by_batch(fn):
    @F.pandas_udf("long")
    def out(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else fn(bytes(v))).astype("Int64")

    return out


def bz2_crc32(x: Column) -> Column:
    return _by_batch(C.bz2_crc32)(x)


def xxh32(x: Column) -> Column:
    return _by_batch(C.xxh32)(x)


def crc32_combine(a: Column, b: Column, b_length: Column) -> Column:
    """crc32 of two values joined, from theirs and the second one's length."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([C.crc32_combine(int(p), int(q), int(k)) for p, q, k in zip(x, y, n)], dtype="int64")

    return run(a, b, b_length)
