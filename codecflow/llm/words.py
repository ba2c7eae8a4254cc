"""Hashes of the words of many texts at once, straight from the bytes of an Arrow column.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D, with A-Z in lower case. Its hash is a polynomial in its
bytes, taken from running sums over a piece of the column, and mixed with its length: no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time, unless one word has more.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return (data - np.uint8(0x09) > np.uint8(0x0D - 0x09)) & (data != np.uint8(0x20))


def lower(data: np.ndarray) -> np.ndarray:
    return data + ((data - np.uint8(ord("A")) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of a string column one after another; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (column number `text`) have `most` bytes together, or are one text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends, lo = flat(b.column(text))[1], 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


class Hasher:
    """Tables of powers, grown where a single word asks for it."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, words in each text)."""
        data, offsets = flat(column)
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(data):
            hi = self.cut(data, offsets, lo)
            h, at = self.piece(data[lo:hi], offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo)
            found.append(h)
            places.append(at + lo)
            lo = hi
        at = np.concatenate(places)
        return np.concatenate(found), np.diff(np.searchsorted(at, offsets, "left"))

    def cut(self, data: np.ndarray, offsets: np.ndarray, lo: int) -> int:
        """The end of a piece from lo on: behind a space or at a text's end, so that no word is torn."""
        hi, size = lo, PIECE
        while True:
            end = min(lo + size, len(data))
            if end == len(data):
                return end
            border = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            spaces = np.flatnonzero(~solid(data[hi:end]))
            best = max(border, hi + int(spaces[-1]) + 1 if len(spaces) else 0)
            if best > lo:
                return best
            hi, size = end, 2 * size

    def piece(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.grow(len(data))
        inside = solid(data)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[borders] = inside[borders]
        ends[borders - 1] = inside[borders - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((lower(data).astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
            h = (total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(h), s


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending (a plain sort is many times faster than numpy's own way)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Index:
    """Places of keys among sorted distinct keys that are spread evenly, as hashes are: by their first bits, then step by step."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        bits = max(1, self.n.bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.r_[keys, np.uint64(0xFFFFFFFFFFFFFFFF)]
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __len__(self) -> int:
        return self.n

    def places(self, q: np.ndarray) -> np.ndarray:
        """The place of each of q, len(self) where it is no key."""
        at = self.first[q >> self.shift]
        k = self.keys[at]
        behind = np.flatnonzero(k < q)
        while len(behind):
            at[behind] += 1
            k[behind] = self.keys[at[behind]]
            behind = behind[k[behind] < q[behind]]
        at[k != q] = self.n
        return at
