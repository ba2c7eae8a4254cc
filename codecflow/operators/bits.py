"""Bits of byte strings, most significant first (bzip2) and least significant first (DEFLATE)."""

from __future__ import annotations

from ..errors import Truncated


class MsbReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.size = data, at, 8 * len(data)

    def remaining(self) -> int:
        return self.size - self.at

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def peek(self, n: int) -> int:
        if self.at + n > self.size:
            raise Truncated("the input ends within a field", self.at)
        first, last = self.at // 8, (self.at + n + 7) // 8
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise Truncated("the input ends within a field", self.at)
        self.at += n


class LsbReader:
    """Keeps up to 64 bits ahead, so that code lookups do not slice the input each time."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.size = data, 8 * len(data)
        self.seek(at)

    def seek(self, at: int) -> None:
        self.next, self.held, self.count = at // 8, 0, 0
        if at % 8:
            self.fill(8)
            self.held >>= at % 8
            self.count -= at % 8

    @property
    def at(self) -> int:
        return 8 * self.next - self.count

    def fill(self, n: int) -> None:
        while self.count < n:
            chunk = self.data[self.next : self.next + 6]
            if not chunk:
                return
            self.held |= int.from_bytes(chunk, "little") << self.count
            self.count += 8 * len(chunk)
            self.next += len(chunk)

    def peek(self, n: int) -> int:
        """n bits, zeros behind the end."""
        self.fill(n)
        return self.held & ((1 << n) - 1)

    def read(self, n: int) -> int:
        self.fill(n)
        if self.count < n:
            raise Truncated("the input ends within a field", self.at)
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.count -= n
        return out

    def skip(self, n: int) -> None:
        self.read(n)

    def align(self) -> None:
        self.read(self.count % 8)


def shifted(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The bits [start, end) of data as (number, how many)."""
    if not 0 <= start <= end <= 8 * len(data):
        raise Truncated("a bit range lies outside the input", start)
    first, last = start // 8, (end + 7) // 8
    return int.from_bytes(data[first:last], "big") >> (8 * last - end) & ((1 << (end - start)) - 1), end - start


def packed(value: int, n: int) -> bytes:
    """n bits as bytes, the last one filled up with zeros."""
    pad = -n % 8
    return (value << pad).to_bytes((n + pad) // 8, "big")
