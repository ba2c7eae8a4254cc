"""Objects that arrive over time, and one object read bit by bit."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFormat
from ..operators import codecs


def arriving(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """(path, modificationTime, length, content) of objects as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def decoded(objects: DataFrame) -> DataFrame:
    """(path, plain.content, error_class, message) of a stream of objects; a bad one is reported, the stream goes on."""
    got = codecs.decompress_permissive(objects.select("path", "content"))
    return got.select("path", F.col("plain.content").alias("plain"), "plain.error_class", "plain.message")


class Reader(io.RawIOBase):
    """Decoded bytes of one object as they are asked for. A failure comes with the read that reaches it, after all bytes
    before it, and with every read from then on. Archives are refused at once."""

    def __init__(self, source: str | bytes, options: codecs.DecodeOptions = codecs.DecodeOptions()):
        if isinstance(source, str):
            with open(source, "rb") as f:
                data = f.read()
        else:
            data = bytes(source)
        kind = options.format if options.format not in (None, "auto") else codecs.format_of(data)
        if kind is None and isinstance(source, str):
            suffix = source.rpartition(".")[2].lower()
            kind = {"bz2": "bzip2", "bzip2": "bzip2", "tbz": "bzip2", "tbz2": "bzip2", "gz": "gzip", "gzip": "gzip", "tgz": "gzip", "lz4": "lz4", "zip": "zip"}.get(suffix)
        if kind not in codecs.FORMATS:
            raise UnsupportedFormat("archives are no streams" if kind == "zip" else "the format is not known")
        self._pieces: Iterator[bytes] = codecs.pieces(data, codecs.DecodeOptions(kind, options.memory_limit, options.max_output))
        self._held, self._failed, self._ended = b"", None, False

    def readable(self) -> bool:
        return True

    def _fill(self) -> None:
        try:
            self._held = next(self._pieces)
        except StopIteration:
            self._ended = True
        except Exception as e:
            self._failed = e

    def readinto(self, buffer) -> int:
        while not self._held and not self._ended:
            if self._failed:
                raise self._failed
            self._fill()
        n = min(len(buffer), len(self._held), 1 << 20)
        buffer[:n], self._held = self._held[:n], self._held[n:]
        return n
