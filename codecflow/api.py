"""Functions on single objects, for use without Spark."""

from __future__ import annotations

import hashlib
import io
import json
from bisect import bisect_right
from collections import OrderedDict

from .errors import BadCompressedFile, BadIndex
from .operators import bzip2, codecs
from .operators.checksums import bz2_crc32
from .streaming.streams import Reader

__all__ = ["BadCompressedFile", "IndexedBzip2File", "Reader", "build_index", "bz2_crc32", "compress", "decompress", "open", "open_indexed", "scan", "test"]
CACHE = 64 << 20
_open_file = open


def _bytes(source: str | bytes) -> bytes:
    if isinstance(source, str):
        with _open_file(source, "rb") as f:
            return f.read()
    return bytes(source)


def scan(data: bytes) -> dict[str, list[dict]]:
    """Candidates of a bzip2 object: streams, blocks, stream_ends. None is trusted."""
    return bzip2.scan(data)


def decompress(data: bytes, format: str | None = None, *, threads: int = 0, memory_limit: int = codecs.MEMORY_LIMIT) -> bytes:
    """threads is taken for compatibility: single objects are decoded by one."""
    return codecs.decompress_bytes(data, codecs.DecodeOptions(format, memory_limit))


def compress(data: bytes, format: str, *, threads: int = 0, memory_limit: int = codecs.MEMORY_LIMIT, level: int | None = None) -> bytes:
    return codecs.compress_bytes(data, codecs.EncodeOptions(format, level, memory_limit))


def test(source: str | bytes, format: str | None = None) -> None:
    """Returns if the object is sound, raises what is wrong otherwise."""
    for _ in codecs.pieces(_bytes(source), codecs.DecodeOptions(format)):
        pass


def open(source: str | bytes, format: str | None = None) -> Reader:
    return Reader(source, codecs.DecodeOptions(format))


def build_index(source: str | bytes) -> bytes:
    """The index of a bzip2 object: its blocks, levels and identity, with a checksum over all."""
    data = _bytes(source)
    streams, blocks = bzip2.layout(data)
    levels = {s["number"]: s["block_size_100k"] for s in streams}
    body = {"version": 1, "source_len": len(data), "source_sha256": hashlib.sha256(data).hexdigest(), "blocks": [[b["compressed_start_bit"], b["compressed_end_bit"], b["decoded_start"], b["decoded_bytes"], b["expected_crc"], levels[b["stream"]]] for b in blocks]}
    text = json.dumps(body).encode()
    return hashlib.sha256(text).digest() + text


class IndexedBzip2File(io.RawIOBase):
    """A bzip2 object read at any place; decoded blocks are kept up to a number of bytes, the least used go first."""

    def __init__(self, source: str | bytes, index: bytes | None = None, cache: int = CACHE):
        self._data = _bytes(source)
        self.index_bytes = index if index is not None else build_index(self._data)
        if len(self.index_bytes) < 32 or hashlib.sha256(self.index_bytes[32:]).digest() != self.index_bytes[:32]:
            raise BadIndex("the index is damaged")
        body = json.loads(self.index_bytes[32:])
        if body["version"] != 1:
            raise BadIndex("an unknown version of the index")
        if body["source_len"] != len(self._data) or body["source_sha256"] != hashlib.sha256(self._data).hexdigest():
            raise BadIndex("the index is of another source")
        self._blocks, at, bit = body["blocks"], 0, 0
        for start, end, first, n, _, _ in self._blocks:
            if start < bit or end <= start or end > 8 * len(self._data) or first != at:
                raise BadIndex("the index leaves gaps or overlaps")
            at, bit = first + n, end
        self._starts, self._size, self._at = [b[2] for b in self._blocks], at, 0
        self._cache: OrderedDict[int, bytes] = OrderedDict()
        self._limit, self._used = cache, 0

    @property
    def size(self) -> int:
        return self._size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self._at, self._size)[whence]
        if not 0 <= at <= self._size:
            raise ValueError("a place outside the object")
        self._at = at
        return at

    def _block(self, i: int) -> bytes:
        if i in self._cache:
            self._cache.move_to_end(i)
            return self._cache[i]
        start, end, _, n, crc, level = self._blocks[i]
        plain = bzip2.decode_block(self._data, start, end, level, crc)
        if len(plain) != n:
            raise BadIndex("a block's length is not that of the index")
        if n <= self._limit:
            self._cache[i] = plain
            self._used += n
            while self._used > self._limit:
                self._used -= len(self._cache.popitem(last=False)[1])
        return plain

    def readinto(self, buffer) -> int:
        if self._at >= self._size or not len(buffer):
            return 0
        i = bisect_right(self._starts, self._at) - 1
        part = self._block(i)[self._at - self._starts[i] :][: len(buffer)]
        buffer[: len(part)] = part
        self._at += len(part)
        return len(part)


def open_indexed(source: str | bytes, index: bytes | None = None) -> IndexedBzip2File:
    return IndexedBzip2File(source, index)
