"""Layouts of compressed objects as DataFrames, one schema for all formats, and as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadMagic, UnsupportedFormat
from ..operators import archives, bzip2, codecs, gzipfmt, lz4fmt
from .dealing import deal

CONTAINERS = "path string, format string, number long, compressed_start long, compressed_end long, decoded_start long, decoded_bytes long, expected_crc long, first_block long, block_count long, level int, mtime long, extra_flags int, operating_system int, name binary, comment binary, block_max_size long, block_mode string, block_checksums boolean, content_checksum boolean, declared_content_size long, eos_bit long"
BLOCKS = "path string, format string, container long, number long, kind string, compressed_start_bit long, compressed_end_bit long, decoded_start long, decoded_bytes long, expected_crc long, stored boolean, is_final boolean"
MARKS = "path string, kind string, bit_offset long, block_size_100k int, crc long, randomized boolean, orig_ptr long, trusted boolean"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


def _per_object(objects: DataFrame, column: str, ddl: str, rows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is not None:
                    yield _batch([r | {"path": path} for r in rows(data)], ddl)

    return objects.select(F.col("path").cast("string"), F.col(column).cast("binary")).mapInArrow(run, ddl)


def _containers(data: bytes) -> Iterator[dict]:
    kind = codecs.format_of(data)
    if kind == "bzip2":
        for s in bzip2.layout(data)[0]:
            yield s | {"format": kind, "compressed_start": s["header_byte"], "compressed_end": (s["eos_bit"] + 87) // 8, "level": s["block_size_100k"]}
    elif kind == "gzip":
        for m in gzipfmt.members(data):
            yield m | {"format": kind}
    elif kind == "lz4":
        for f in lz4fmt.layout(data)[0]:
            yield f | {"format": kind}
    elif kind == "zip":
        for e in archives.zip_entries(data):
            yield {"format": kind, "number": e["number"], "compressed_start": e["data_start"], "compressed_end": e["data_start"] + e["compressed_bytes"], "decoded_bytes": e["decoded_bytes"], "expected_crc": e["expected_crc"], "mtime": e["mtime"], "name": e["path"].encode()}
    else:
        raise UnsupportedFormat("the format is not known")


def _blocks(data: bytes) -> Iterator[dict]:
    kind = codecs.format_of(data)
    if kind == "bzip2":
        for b in bzip2.layout(data)[1]:
            yield b | {"format": kind, "container": b["stream"]}
    elif kind == "gzip":
        for i, b in enumerate(gzipfmt.member_blocks(data)):
            yield b | {"format": kind, "container": b["member"], "number": i, "compressed_start_bit": b["start_bit"], "compressed_end_bit": b["end_bit"], "stored": b["kind"] == "stored"}
    elif kind == "lz4":
        for b in lz4fmt.layout(data)[1]:
            yield b | {"format": kind, "container": b["frame"], "compressed_start_bit": 8 * b["compressed_start"], "compressed_end_bit": 8 * b["compressed_end"]}


def _marks(data: bytes) -> Iterator[dict]:
    got = bzip2.scan(data)
    for s in got["streams"]:
        yield {"kind": "stream", "bit_offset": 8 * s["byte_offset"], "block_size_100k": s["block_size_100k"], "trusted": False}
    for b in got["blocks"]:
        yield {"kind": "block", "bit_offset": b["bit_offset"], "crc": b["expected_crc"], "randomized": b["randomized"], "orig_ptr": b["orig_ptr"], "trusted": False}
    for e in got["stream_ends"]:
        yield {"kind": "end", "bit_offset": e["bit_offset"], "crc": e["expected_stream_crc"], "trusted": False}


def containers(objects: DataFrame, column: str = "content") -> DataFrame:
    """Streams, members, frames or entries of objects(path, content), from a full, checked decode."""
    return _per_object(objects, column, CONTAINERS, _containers)


def blocks(objects: DataFrame, column: str = "content") -> DataFrame:
    """Blocks of every container; for gzip its DEFLATE blocks are walked bit by bit, so it is meant for listing."""
    return _per_object(objects, column, BLOCKS, _blocks)


def marks(objects: DataFrame, column: str = "content") -> DataFrame:
    """Candidates of a structural scan of bzip2 objects; none is trusted."""
    return _per_object(objects, column, MARKS, _marks)


def marks_in_chunks(objects: DataFrame, column: str = "content", chunk: int = bzip2.SCAN_CHUNK) -> DataFrame:
    """The same, every chunk of an object by itself: it reads the few bytes behind its end that a mark may reach into."""
    n = F.octet_length(F.col(column))
    parts = objects.select("path", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("k"), F.col(column).alias("content"))
    parts = parts.select("path", (F.col("k").cast("long") * chunk).alias("first"), F.col("content").substr(F.col("k") * chunk + 1, F.lit(chunk + 18)).alias("piece"), (F.octet_length("content") - F.col("k") * chunk).alias("rest"))
    parts = deal(parts, "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, piece, rest in zip(*(c.to_pylist() for c in b.columns)):
                if not first and not (piece[:3] == b"BZh" and piece[3:4].isdigit() and piece[3:4] != b"0"):
                    raise BadMagic("the input begins with no bzip2 stream", 0)
                padded = piece if first == 0 else b"BZh9" + piece
                lead = 0 if first == 0 else 4
                rows = []
                got = bzip2.scan(padded, 0, min(chunk, rest) + lead)
                for r in got["blocks"]:
                    rows.append({"kind": "block", "bit_offset": r["bit_offset"] - 8 * lead + 8 * first, "crc": r["expected_crc"], "randomized": r["randomized"], "orig_ptr": r["orig_ptr"]})
                for r in got["stream_ends"]:
                    rows.append({"kind": "end", "bit_offset": r["bit_offset"] - 8 * lead + 8 * first, "crc": r["expected_stream_crc"]})
                for r in got["streams"]:
                    if r["byte_offset"] >= lead:
                        rows.append({"kind": "stream", "bit_offset": 8 * (r["byte_offset"] - lead + first), "block_size_100k": r["block_size_100k"]})
                yield _batch([r | {"path": path, "trusted": False} for r in rows], MARKS)

    return parts.mapInArrow(run, MARKS)


def as_json(objects: DataFrame, column: str = "content") -> DataFrame:
    """(path, json): the layout of each object; names that are no UTF-8 are read with replacements."""
    c = containers(objects, column).withColumns({"name": F.col("name").cast("string"), "comment": F.col("comment").cast("string")})
    fields = [f.split()[0] for f in CONTAINERS.split(", ") if f.split()[0] not in ("path", "format")]
    listed = c.groupBy("path", "format").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("containers"), F.sum("decoded_bytes").alias("decoded_bytes"))
    return listed.select("path", F.to_json(F.struct("path", "format", "decoded_bytes", "containers")).alias("json"))


def json_of_all(objects: DataFrame, column: str = "content") -> DataFrame:
    """One row: an object's JSON if there is one object, else an array of them by path."""
    listed = as_json(objects, column).agg(F.array_sort(F.collect_list(F.struct("path", "json"))).alias("x"))
    return listed.select(F.when(F.size("x") == 1, F.col("x")[0]["json"]).otherwise(F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["json"]), ","), F.lit("]"))).alias("json"))


def blocks_per_container(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path", "container").agg(F.count("*").alias("blocks"))
