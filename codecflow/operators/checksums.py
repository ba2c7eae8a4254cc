"""Checksums of bytes; the Catalyst forms are in codecflow.functions.checksums."""

from __future__ import annotations

import zlib

import xxhash

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def reverse32(x: int) -> int:
    return int(f"{x:032b}"[::-1], 2)


def bz2_crc32(data: bytes) -> int:
    """CRC-32 with the most significant bit first: the usual one of bit-reversed bytes, reversed."""
    return reverse32(zlib.crc32(data.translate(REVERSED)))


def fold_stream_crc(blocks) -> int:
    """A bzip2 stream's checksum from those of its blocks in order."""
    out = 0
    for b in blocks:
        out = ((out << 1 | out >> 31) & 0xFFFFFFFF) ^ b
    return out


def xxh32(data: bytes) -> int:
    return xxhash.xxh32_intdigest(data)


def crc32_combine(a: int, b: int, b_length: int) -> int:
    """crc32 of x + y from crc32(x), crc32(y) and len(y): zeros are appended to x by squaring the shift matrix."""

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    shift = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    n = 8 * b_length
    while n:
        if n & 1:
            a = times(shift, a)
        shift = [times(shift, c) for c in shift]
        n >>= 1
    return a ^ b
