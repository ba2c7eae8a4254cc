"""Compressed objects as rows, and byte ranges of large ones as partitions of a Python data source."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ConfigError
from ..operators import bzip2

RANGE = 1 << 20
#: Bytes behind a range that a mark beginning in it may reach into.
OVERLAP = 18
RANGES = "path string, first long, length long, content binary"


def read_objects(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of every object; filters on the first three spare reading contents.

    Spark's reader passes over files without bytes; their names are listed here, so that none is lost unnoticed.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    empty = [(p, t / 1000) for p, t in _empty_files(spark, [path] if isinstance(path, str) else path, glob, recursive)]
    if not empty:
        return found
    rows = spark.createDataFrame(empty, "path string, t double")
    return found.unionByName(rows.select("path", F.timestamp_seconds("t").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def _empty_files(spark: SparkSession, paths: list[str], glob: str | None, recursive: bool) -> list[tuple[str, int]]:
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = p.getFileSystem(conf)
        todo = list(system.globStatus(p) or [])
        top = set(map(id, todo))
        while todo:
            s = todo.pop()
            name = s.getPath().getName()
            if s.isDirectory():
                if id(s) in top or recursive and not name.startswith(("_", ".")):
                    todo += list(system.listStatus(s.getPath()))
            elif not s.getLen() and not name.startswith(("_", ".")) and (glob is None or fnmatch(name, glob)):
                found.append((s.getPath().toString(), s.getModificationTime()))
    return found


def objects(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Objects from columns of any table."""
    return df.select(path.cast("string").alias("path"), content.cast("binary").alias("content"))


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").option("range", n).load(uri): one partition for each range of each file, with the
    bytes behind it that a mark may reach into. It takes files of any size on any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, length: int):
        self.path, self.first, self.length = path, first, length


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else (fs.LocalFileSystem(), uri)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ConfigError("a path is needed")
        self.path, self.size = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        return [_Range(f.path, k, min(self.size, f.size - k)) for f in files for k in range(0, max(f.size, 1), self.size)]

    def read(self, p: _Range) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(p.path) as f:
            f.seek(p.first)
            yield p.path, p.first, p.length, f.read(p.length + OVERLAP)


def register(spark: SparkSession) -> None:
    from .sinks import EncodedFiles

    spark.dataSource.register(ByteRanges)
    spark.dataSource.register(EncodedFiles)


def marks_of_ranges(ranges: DataFrame) -> DataFrame:
    """Block and end marks (path, kind, bit_offset, crc) of bzip2 files read as byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, length, content in zip(*(c.to_pylist() for c in b.columns)):
                got = bzip2.scan(b"BZh9" + content, 0, length + 4)
                rows = [("block", x["bit_offset"], x["expected_crc"]) for x in got["blocks"]] + [("end", x["bit_offset"], x["expected_stream_crc"]) for x in got["stream_ends"]]
                kinds, bits, crcs = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(kinds, pa.string()), pa.array([x - 32 + 8 * first for x in bits], pa.int64()), pa.array(crcs, pa.int64())], ["path", "kind", "bit_offset", "crc"])

    return ranges.select("path", "first", "length", "content").mapInArrow(run, "path string, kind string, bit_offset long, crc long")


def not_existing(objects: DataFrame, existing: DataFrame, target: Column) -> DataFrame:
    """Objects whose target is not among existing(path): what remains when existing outputs are to be skipped."""
    return objects.withColumn("__t", target).join(existing.select(F.col("path").alias("__t")).distinct(), "__t", "left_anti").drop("__t")
