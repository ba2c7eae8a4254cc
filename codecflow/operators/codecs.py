"""One entrance for all stream formats: bytes to bytes, and the same as DataFrame operators on a column of objects."""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, OutputLimit, UnsupportedFormat, error_class
from . import bzip2, gzipfmt, lz4fmt

FORMATS = ("bzip2", "gzip", "lz4")
_MODULES = {"bzip2": bzip2, "gzip": gzipfmt, "lz4": lz4fmt}
MEMORY_LIMIT = 1 << 30
#: Objects in an Arrow batch: each may be large.
OBJECTS_PER_BATCH = 16


@dataclass(frozen=True)
class DecodeOptions:
    format: str | None = None
    memory_limit: int = MEMORY_LIMIT
    max_output: int | None = None

    def __post_init__(self):
        if self.format not in (None, "auto", *FORMATS):
            raise ConfigError(f"unknown format: {self.format}")
        if self.memory_limit < bzip2.MOST_IN_BLOCK:
            raise ConfigError(f"the memory limit is below {bzip2.MOST_IN_BLOCK} bytes, the largest block")


@dataclass(frozen=True)
class EncodeOptions:
    format: str
    level: int | None = None
    memory_limit: int = MEMORY_LIMIT

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ConfigError(f"unknown format: {self.format}")
        if self.level is not None and not 1 <= self.level <= 9:
            raise ConfigError("the level is from 1 to 9")
        if self.memory_limit <= 0:
            raise ConfigError("the memory limit is above 0")


def format_of(data: bytes) -> str | None:
    """The format that the first bytes tell, or None."""
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"\x04\x22\x4d\x18" or len(data) >= 4 and data[1:4] == b"\x2a\x4d\x18" and 0x50 <= data[0] <= 0x5F:
        return "lz4"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "zip"
    return None


def pieces(data: bytes, options: DecodeOptions = DecodeOptions()) -> Iterator[bytes]:
    """Decoded pieces in order; a failure comes after the pieces before it."""
    kind = options.format if options.format not in (None, "auto") else format_of(data)
    if kind not in _MODULES:
        raise UnsupportedFormat("archives are no streams" if kind == "zip" else "the format is not known")
    total = 0
    for piece in _MODULES[kind].decode(data):
        total += len(piece)
        if options.max_output is not None and total > options.max_output:
            raise OutputLimit(f"the output exceeds {options.max_output} bytes")
        yield piece


def decompress_bytes(data: bytes, options: DecodeOptions = DecodeOptions()) -> bytes:
    return b"".join(pieces(data, options))


def compress_bytes(data: bytes, options: EncodeOptions) -> bytes:
    return _MODULES[options.format].encode(data, options.level)


@dataclass
class EncodeReport:
    plain_bytes: int
    coded_bytes: int


class Encoder:
    """Encodes what is written to it into another file object, piece by piece; finish() ends the stream."""

    def __init__(self, to, options: EncodeOptions):
        self.to, self.options, self.report = to, options, EncodeReport(0, 0)
        self._done = False
        if options.format == "bzip2":
            self._stream = bz2.BZ2Compressor(gzipfmt.check_level(options.level, bzip2.DEFAULT_LEVEL))
        elif options.format == "gzip":
            level = gzipfmt.check_level(options.level, gzipfmt.DEFAULT_LEVEL)
            self._stream, self._crc = zlib.compressobj(level, zlib.DEFLATED, -15), 0
            self._put(gzipfmt.gzip_header(level))
        else:
            self._level, self._held, self._sum = gzipfmt.check_level(options.level, lz4fmt.DEFAULT_LEVEL), b"", xxhash.xxh32()
            self._size = next((n for n in sorted(lz4fmt.BLOCK_SIZES.values(), reverse=True) if 2 * n <= options.memory_limit), None)
            if self._size is None:
                raise ConfigError("the memory limit is below two of the smallest blocks")
            self._put(lz4fmt.join_blocks([], self._size, 0)[:-8])

    def _put(self, data: bytes) -> None:
        self.to.write(data)
        self.report.coded_bytes += len(data)

    def write(self, data: bytes) -> int:
        if self._done:
            raise ValueError("the stream has ended")
        self.report.plain_bytes += len(data)
        if self.options.format == "lz4":
            self._sum.update(data)
            self._held += data
            while len(self._held) >= self._size:
                self._put(lz4fmt.block_words([lz4fmt.encode_block(self._held[: self._size], self._level)]))
                self._held = self._held[self._size :]
        else:
            if self.options.format == "gzip":
                self._crc = zlib.crc32(data, self._crc)
            self._put(self._stream.compress(data))
        return len(data)

    def finish(self) -> EncodeReport:
        if not self._done:
            self._done = True
            if self.options.format == "lz4":
                if self._held:
                    self._put(lz4fmt.block_words([lz4fmt.encode_block(self._held, self._level)]))
                self._put(bytes(4) + struct.pack("<I", self._sum.intdigest()))
            else:
                self._put(self._stream.flush())
                if self.options.format == "gzip":
                    self._put(struct.pack("<II", self._crc, self.report.plain_bytes & 0xFFFFFFFF))
        return self.report


def _each(df: DataFrame, column: str, out: str, fn, *, to: str = "binary") -> DataFrame:
    """df with fn(bytes) of a binary column as another column; null stays null."""
    from pyspark.sql.types import _parse_datatype_string

    kind = {"binary": pa.binary(), VALIDATION_SQL: VALIDATION, PARTS: PARTS_ARROW}[to]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, OBJECTS_PER_BATCH):
                part = b.slice(lo, OBJECTS_PER_BATCH)
                values = [None if x is None else fn(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], [*part.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast(_parse_datatype_string(to))).schema)


VALIDATION = pa.struct([("ok", pa.bool_()), ("error_class", pa.string()), ("message", pa.string()), ("bit_offset", pa.int64()), ("decoded_bytes", pa.int64())])
VALIDATION_SQL = "struct<ok:boolean,error_class:string,message:string,bit_offset:bigint,decoded_bytes:bigint>"
PARTS = "struct<content:binary,error_class:string,message:string>"
PARTS_ARROW = pa.struct([("content", pa.binary()), ("error_class", pa.string()), ("message", pa.string())])


def decompress(df: DataFrame, column: str = "content", out: str = "plain", **options) -> DataFrame:
    """df with the decoded bytes of a column; a bad object fails the task."""
    o = DecodeOptions(**options)
    return _each(df, column, out, lambda x: decompress_bytes(x, o))


def decompress_permissive(df: DataFrame, column: str = "content", out: str = "plain", **options) -> DataFrame:
    """df with (content, error_class, message): what could be decoded before a failure, and the failure."""
    o = DecodeOptions(**options)

    def keep_prefix(x: bytes) -> dict:
        got: list[bytes] = []
        try:
            for p in pieces(x, o):
                got.append(p)
        except Exception as e:
            return {"content": b"".join(got), "error_class": error_class(e), "message": str(e)}
        return {"content": b"".join(got), "error_class": None, "message": None}

    return _each(df, column, out, keep_prefix, to=PARTS)


def validate(df: DataFrame, column: str = "content", out: str = "check", **options) -> DataFrame:
    """df with (ok, error_class, message, bit_offset, decoded_bytes): a full decode that keeps nothing."""
    o = DecodeOptions(**options)

    def one(x: bytes) -> dict:
        n = 0
        try:
            for p in pieces(x, o):
                n += len(p)
        except Exception as e:
            return {"ok": False, "error_class": error_class(e), "message": str(e), "bit_offset": getattr(e, "bit", None), "decoded_bytes": n}
        return {"ok": True, "error_class": None, "message": None, "bit_offset": None, "decoded_bytes": n}

    return _each(df, column, out, one, to=VALIDATION_SQL)


def compress(df: DataFrame, format: str, column: str = "plain", out: str = "content", level: int | None = None, memory_limit: int = MEMORY_LIMIT) -> DataFrame:
    """df with the encoded bytes of a column; options are checked before anything runs."""
    o = EncodeOptions(format, level, memory_limit)
    return _each(df, column, out, lambda x: compress_bytes(x, o))


def deflate(df: DataFrame, column: str = "plain", out: str = "content", level: int | None = None) -> DataFrame:
    """Raw DEFLATE of each value."""
    gzipfmt.check_level(level, 6)
    return _each(df, column, out, lambda x: gzipfmt.encode_deflate(x, level))


def inflate(df: DataFrame, column: str = "content", out: str = "plain") -> DataFrame:
    """Raw DEFLATE back, each value taken up whole."""
    return _each(df, column, out, gzipfmt.decode_deflate)
