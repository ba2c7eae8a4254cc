"""Large objects in parallel: bzip2 blocks decoded apart and chained, gzip and LZ4 encoded in segments."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadChecksum, BadCompressedFile, ConfigError
from ..operators import bzip2, gzipfmt, lz4fmt
from ..operators.checksums import fold_stream_crc, xxh32
from ..operators.relational import decoded_offsets, with_dictionary
from ..tables import kept
from .dealing import deal
from .layout import marks_in_chunks

CANDIDATES = "path string, start_bit long, end_bit long, crc long, plain binary"


def candidate_pairs(marks: DataFrame) -> DataFrame:
    """(path, start_bit, stops): block marks with the marks that may end them, the first of which nearly always does."""
    w = Window.partitionBy("path").orderBy("bit_offset").rangeBetween(1, bzip2.MOST_BITS_IN_BLOCK)
    m = marks.where("kind in ('block', 'end')").dropDuplicates(["path", "bit_offset"])
    return m.withColumn("stops", F.collect_list("bit_offset").over(w)).where("kind = 'block' and not randomized and size(stops) > 0").select("path", F.col("bit_offset").alias("start_bit"), "stops", "crc")


def decode_candidates(pairs: DataFrame, objects: DataFrame, column: str = "content") -> DataFrame:
    """(path, start_bit, end_bit, crc, plain) of the candidates that are blocks; each task gets the bytes of its block only."""
    first = F.floor(F.col("start_bit") / 8)
    last = F.ceil(F.element_at("stops", -1) / 8)
    cut = pairs.join(objects.select("path", F.col(column).alias("__c")), "path").select("path", "start_bit", "stops", "crc", (8 * first).alias("base"), F.col("__c").substr((first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    cut = deal(cut, "path", "start_bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stops, crc, base, piece in zip(*(c.to_pylist() for c in b.columns)):
                got = bzip2.candidate(piece, start - base, [s - base for s in stops])
                if got:
                    row = (path, start, got[0] + base, crc, got[1])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [x.split()[0] for x in CANDIDATES.split(", ")])

    return cut.mapInArrow(run, CANDIDATES)


def accepted(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, stream, number, start_bit, end_bit, crc) of the candidates that the chain reaches.

    The chain is walked over the marks of each object alone, no payload among them: a block must begin where the one
    before ended, the stream's checksum is folded from its blocks', and a stream's header follows at the next byte.
    """
    m = marks.select("path", "kind", F.col("bit_offset").alias("at"), F.lit(None).cast("long").alias("end"), F.col("block_size_100k").cast("long").alias("level"), "crc", F.lit(None).cast("long").alias("n"))
    c = candidates.select("path", F.lit("candidate").alias("kind"), F.col("start_bit").alias("at"), F.col("end_bit").alias("end"), F.lit(None).cast("long").alias("level"), "crc", F.octet_length("plain").cast("long").alias("n"))

    def walk(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        path = rows[0]["path"]
        by = {k: {r["at"]: r for r in rows if r["kind"] == k} for k in ("stream", "end", "candidate")}
        out, at, stream, number = [], 0, 0, 0
        while at in by["stream"]:
            level, bit, crcs = by["stream"][at]["level"], at + 32, []
            while bit not in by["end"]:
                r = by["candidate"].get(bit)
                if r is None:
                    raise BadCompressedFile(f"{path}: neither a block nor an end begins here", bit)
                if r["n"] > level * 100_000 // 5 * 259 + 4:
                    raise BadCompressedFile(f"{path}: a block is larger than its level allows", bit)
                crcs.append(r["crc"])
                out.append((path, stream, number, bit, r["end"], r["crc"]))
                number, bit = number + 1, r["end"]
            if fold_stream_crc(crcs) != by["end"][bit]["crc"]:
                raise BadChecksum(f"{path}: the stream's checksum differs", bit)
            stream, at = stream + 1, (bit + 87) // 8 * 8
        return pa.table([pa.array(v, t_) for v, t_ in zip(zip(*out) if out else [[]] * 6, (pa.string(), *[pa.int64()] * 5))], names=["path", "stream", "number", "start_bit", "end_bit", "crc"])

    return m.unionByName(c).groupBy("path").applyInArrow(walk, "path string, stream long, number long, start_bit long, end_bit long, crc long")


def decode_bzip2(objects: DataFrame, column: str = "content") -> DataFrame:
    """(path, number, decoded_start, decoded_bytes, plain): blocks of bzip2 objects, decoded in parallel within each object."""
    marks = kept(marks_in_chunks(objects, column))
    pairs = candidate_pairs(marks)
    likely = kept(decode_candidates(pairs.withColumn("stops", F.slice("stops", 1, 1)), objects, column))
    # a mark in the middle of a block's data: the further marks are tried, for these few only
    open_ = pairs.where("size(stops) > 1").join(likely.select("path", "start_bit"), ["path", "start_bit"], "left_anti")
    blocks = likely.unionByName(decode_candidates(open_.withColumn("stops", F.slice("stops", 2, 1 << 30)), objects, column))
    chained = accepted(blocks, marks).join(blocks.select("path", "start_bit", "plain"), ["path", "start_bit"])
    chained = chained.withColumn("decoded_bytes", F.octet_length("plain").cast("long"))
    return decoded_offsets(chained, ["path"], ["number"], "decoded_bytes").select("path", "number", "decoded_start", "decoded_bytes", "plain")


def pieces(values: DataFrame, column: str, size: int) -> DataFrame:
    """(path, segment, piece) of values(path, column) cut into pieces of a fixed size; an empty value is one empty piece."""
    n = F.octet_length(F.col(column))
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))))
    return values.select("path", k.alias("segment"), F.col(column).alias("__v")).select("path", "segment", F.col("__v").substr(F.col("segment") * size + 1, F.lit(size)).alias("piece"))


def _encode_pieces(df: DataFrame, ddl: str, fn) -> DataFrame:
    """fn(piece, dictionary) -> values of the columns in ddl, for each row of df(path, segment, piece, dictionary)."""
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [{"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(p, d) for p, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types))], ["path", "segment", *names])

    return deal(df.select("path", "segment", "piece", "dictionary"), "path", "segment").mapInArrow(run, "path string, segment int, " + ddl)


def encode_gzip(values: DataFrame, column: str = "plain", level: int | None = None, segment: int = gzipfmt.SEGMENT) -> DataFrame:
    """(path, content): one member for each value, whose segments are encoded in parallel, each with the one before it as
    dictionary; checksums are combined."""
    level = gzipfmt.check_level(level, gzipfmt.DEFAULT_LEVEL)
    if segment < gzipfmt.LEAST_SEGMENT:
        raise ConfigError("segments are of 64 KiB at least")
    cut = with_dictionary(pieces(values, column, segment), "path", "segment", "piece", gzipfmt.WINDOW)
    coded = _encode_pieces(cut, "coded binary, crc long, n long", lambda p, d: (gzipfmt.encode_segment(p, d or b"", level), zlib.crc32(p), len(p)))

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        return pa.table({"path": pa.array([rows[0]["path"]], pa.string()), "content": pa.array([gzipfmt.join_segments([(r["coded"], r["crc"], r["n"]) for r in rows], level)], pa.binary())})

    return deal(coded, "path").groupBy("path").applyInArrow(join, "path string, content binary")


def encode_lz4(values: DataFrame, column: str = "plain", level: int | None = None, block_size: int = 4 << 20) -> DataFrame:
    """(path, content): one frame of independent blocks for each value, blocks encoded in parallel."""
    level = gzipfmt.check_level(level, lz4fmt.DEFAULT_LEVEL)
    if block_size not in lz4fmt.BLOCK_SIZES.values():
        raise ConfigError("blocks are of 64 KiB, 256 KiB, 1 MiB or 4 MiB")
    cut = pieces(values, column, block_size).withColumn("dictionary", F.lit(None).cast("binary"))
    coded = _encode_pieces(cut, "coded binary, stored boolean", lambda p, _: lz4fmt.encode_block(p, level))
    sums = values.select("path", F.col(column).alias("__v"))

    def join(key, t: pa.Table, v: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        plain = v.column("__v")[0].as_py()
        blocks = [(r["coded"], r["stored"]) for r in rows] if plain else []
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "content": pa.array([lz4fmt.join_blocks(blocks, block_size, xxh32(plain))], pa.binary())})

    return deal(coded, "path").groupBy("path").cogroup(deal(sums, "path").groupBy("path")).applyInArrow(join, "path string, content binary")


def encode_bzip2(values: DataFrame, column: str = "plain", level: int | None = None) -> DataFrame:
    """(path, content): one stream for each value; its blocks are encoded in parallel and their bits joined."""
    level = gzipfmt.check_level(level, bzip2.DEFAULT_LEVEL)
    limit = level * 100_000 - 19

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, plain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = bzip2.rle1_segments(plain, limit) or [(0, 0)]
                for i, (lo, hi) in enumerate(spans):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([i], pa.int32()), pa.array([plain[lo:hi]], pa.binary())], ["path", "segment", "piece"])

    blocks = values.select("path", F.col(column).cast("binary")).mapInArrow(cut, "path string, segment int, piece binary").withColumn("dictionary", F.lit(None).cast("binary"))

    def encode(piece: bytes, _) -> tuple[bytes, int, int]:
        if not piece:
            return b"", 0, 0
        bits, n, crc = bzip2.encode_piece(piece, level)
        return bits.to_bytes((n + 7) // 8, "big"), n, crc

    coded = _encode_pieces(blocks, "coded binary, bits long, crc long", encode)

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        made = [(int.from_bytes(r["coded"], "big"), r["bits"], r["crc"]) for r in rows if r["bits"]]
        return pa.table({"path": pa.array([rows[0]["path"]], pa.string()), "content": pa.array([bzip2.join_blocks(made, level)], pa.binary())})

    return deal(coded, "path").groupBy("path").applyInArrow(join, "path string, content binary")
