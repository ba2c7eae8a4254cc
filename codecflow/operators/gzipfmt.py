"""gzip (RFC 1952) and raw DEFLATE (RFC 1951): members, block layout, decoding, segmented encoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from ..errors import BadChecksum, BadCompressedFile, BadHeader, BadMagic, ConfigError, TrailingData, Truncated
from .bits import LsbReader
from .checksums import crc32_combine

WINDOW = 32 << 10
SEGMENT = 1 << 20
LEAST_SEGMENT = 64 << 10
DEFAULT_LEVEL = 6
KINDS = ("stored", "fixed", "dynamic")


def header(data: bytes, at: int = 0) -> dict:
    """Fields of a member header and `end`, the place of its DEFLATE data."""
    if len(data) - at < 10:
        raise Truncated("the input ends in a gzip header", 8 * at)
    if data[at : at + 2] != b"\x1f\x8b":
        raise BadMagic("no gzip member", 8 * at)
    method, flags, mtime, extra_flags, system = struct.unpack_from("<BBIBB", data, at + 2)
    if method != 8:
        raise BadHeader("the method is not DEFLATE", 8 * at)
    if flags & 0xE0:
        raise BadHeader("reserved flags are set", 8 * at)
    p = at + 10
    out = {"mtime": mtime, "extra_flags": extra_flags, "operating_system": system, "name": None, "comment": None}
    if flags & 4:
        if len(data) < p + 2 or len(data) < p + 2 + struct.unpack_from("<H", data, p)[0]:
            raise Truncated("the input ends in an extra field", 8 * p)
        p += 2 + struct.unpack_from("<H", data, p)[0]
    for flag, name in ((8, "name"), (16, "comment")):
        if flags & flag:
            end = data.find(b"\0", p)
            if end < 0:
                raise Truncated(f"the {name} has no end", 8 * p)
            out[name], p = data[p:end], end + 1
    if flags & 2:
        if len(data) < p + 2:
            raise Truncated("the input ends in a header checksum", 8 * p)
        if struct.unpack_from("<H", data, p)[0] != zlib.crc32(data[at:p]) & 0xFFFF:
            raise BadChecksum("the header checksum differs", 8 * p)
        p += 2
    return out | {"end": p}


def chunks(data: bytes, size: int = 1 << 20) -> Iterator[tuple[str, object]]:
    """("member", start and fields), ("data", bytes) and ("end", fields) of a gzip file, as they are decoded and checked."""
    at = number = 0
    while True:
        if number and not data[at:].strip(b"\0"):
            return  # all-zero padding after a member
        if at >= len(data) and not number:
            raise Truncated("no gzip member", 0)
        if number and data[at : at + 2] != b"\x1f\x8b":
            raise TrailingData("bytes that are no member follow", 8 * at)
        fields = header(data, at) | {"number": number, "compressed_start": at}
        yield "member", fields
        inflate = zlib.decompressobj(-15)
        crc = n = 0
        feed = memoryview(data)[fields["end"] :]
        try:
            piece = inflate.decompress(feed, size)
            while True:
                if piece:
                    crc, n = zlib.crc32(piece, crc), n + len(piece)
                    yield "data", piece
                if inflate.eof:
                    break
                if not inflate.unconsumed_tail and not piece:
                    raise Truncated("the input ends in DEFLATE data", 8 * len(data))
                piece = inflate.decompress(inflate.unconsumed_tail, size)
        except zlib.error as e:
            raise BadCompressedFile(str(e), 8 * fields["end"]) from None
        end = len(data) - len(inflate.unused_data)
        if len(data) < end + 8:
            raise Truncated("the input ends in a trailer", 8 * end)
        want, size_ = struct.unpack_from("<II", data, end)
        if crc != want:
            raise BadChecksum("the member's checksum differs", 8 * end)
        if n & 0xFFFFFFFF != size_:
            raise BadCompressedFile("the member's size differs", 8 * end + 32)
        at = end + 8
        yield "end", fields | {"deflate_start": fields["end"], "compressed_end": at, "decoded_bytes": n, "expected_crc": want}
        number += 1


def members(data: bytes) -> list[dict]:
    """Layout of the members of a valid file, with decoded_start."""
    out, start = [], 0
    for kind, x in chunks(data):
        if kind == "end":
            x.pop("end")
            out.append(x | {"decoded_start": start})
            start += x["decoded_bytes"]
    return out


def decode(data: bytes) -> Iterator[bytes]:
    return (x for kind, x in chunks(data) if kind == "data")


def decode_deflate(data: bytes) -> bytes:
    """Raw DEFLATE that takes up the whole input."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        raise BadCompressedFile(str(e), 0) from None
    if not d.eof:
        raise Truncated("the input ends in DEFLATE data", 8 * len(data))
    if d.unused_data:
        raise TrailingData("bytes follow the DEFLATE data", 8 * (len(data) - len(d.unused_data)))
    return out


class _Codes:
    """A canonical prefix code of RFC 1951 as one table from the next 15 bits to (length, symbol)."""

    def __init__(self, lengths: list[int]):
        used = [x for x in lengths if x]
        room = sum(1 << (15 - x) for x in used)
        if room > 1 << 15:
            raise BadCompressedFile("a code is oversubscribed")
        self.bits = max(used, default=1)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.bits)
        code = 0
        for n in range(1, self.bits + 1):
            for symbol in [s for s, x in enumerate(lengths) if x == n]:
                flipped = int(f"{code:0{n}b}"[::-1], 2)
                self.table[flipped :: 1 << n] = [(n, symbol)] * len(self.table[flipped :: 1 << n])
                code += 1
            code <<= 1

    def read(self, r: LsbReader) -> int:
        hit = self.table[r.peek(self.bits)]
        if hit is None:
            raise BadCompressedFile("a code without a symbol", r.at)
        r.skip(hit[0])
        return hit[1]


def _lengths_base(extra: list[int], first: int) -> list[int]:
    out = [first]
    for e in extra[:-1]:
        out.append(out[-1] + (1 << e))
    return out


# Extra bits of length symbols 257 .. 284 and of distance symbols come in steps, from which the bases follow.
_LENGTH_EXTRA = [0] * 8 + [n for n in range(1, 6) for _ in range(4)]
_LENGTH_BASE = [*_lengths_base(_LENGTH_EXTRA, 3), 258]
_LENGTH_EXTRA = [*_LENGTH_EXTRA, 0]
_DISTANCE_EXTRA = [0, 0] + [n for n in range(14) for _ in range(2)]
_DISTANCE_BASE = _lengths_base(_DISTANCE_EXTRA, 1)
_CODE_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]  # fixed by RFC 1951


def deflate_blocks(data: bytes, start_bit: int = 0) -> list[dict]:
    """Blocks of DEFLATE data: kind, is_final, start_bit, end_bit, decoded_start, decoded_bytes. Walks codes, keeps no data."""
    r = LsbReader(data, start_bit)
    out, total, final = [], 0, 0
    while not final:
        begin, at = total, r.at
        final, kind = r.read(1), r.read(2)
        if kind == 0:
            r.align()
            n, not_n = r.read(16), r.read(16)
            if n != not_n ^ 0xFFFF:
                raise BadCompressedFile("a stored length differs from its complement", at)
            if r.at + 8 * n > r.size:
                raise Truncated("the input ends in a stored block", r.at)
            r.seek(r.at + 8 * n)
            total += n
        elif kind == 3:
            raise BadCompressedFile("a block of the reserved kind", at)
        else:
            literals, distances = (_Codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _Codes([5] * 30)) if kind == 1 else _dynamic(r)
            while (symbol := literals.read(r)) != 256:
                if symbol < 256:
                    total += 1
                    continue
                if symbol > 285:
                    raise BadCompressedFile("a length symbol out of range", r.at)
                n = _LENGTH_BASE[symbol - 257] + r.read(_LENGTH_EXTRA[symbol - 257])
                d = distances.read(r)
                if d > 29:
                    raise BadCompressedFile("a distance symbol out of range", r.at)
                if _DISTANCE_BASE[d] + r.read(_DISTANCE_EXTRA[d]) > total:
                    raise BadCompressedFile("a distance before the beginning", r.at)
                total += n
        out.append({"kind": KINDS[kind], "is_final": bool(final), "start_bit": at, "end_bit": r.at, "decoded_start": begin, "decoded_bytes": total - begin})
    return out


def _dynamic(r: LsbReader) -> tuple[_Codes, _Codes]:
    n_literals, n_distances, n_codes = r.read(5) + 257, r.read(5) + 1, r.read(4) + 4
    lengths = [0] * 19
    for i in _CODE_ORDER[:n_codes]:
        lengths[i] = r.read(3)
    codes, out = _Codes(lengths), []
    while len(out) < n_literals + n_distances:
        s = codes.read(r)
        if s < 16:
            out.append(s)
        elif s == 16:
            if not out:
                raise BadCompressedFile("a repeat of no length", r.at)
            out += [out[-1]] * (3 + r.read(2))
        else:
            out += [0] * (3 + r.read(3) if s == 17 else 11 + r.read(7))
    if len(out) > n_literals + n_distances:
        raise BadCompressedFile("code lengths run over", r.at)
    if not out[256]:
        raise BadCompressedFile("no code for the end of a block", r.at)
    return _Codes(out[:n_literals]), _Codes(out[n_literals:])


def member_blocks(data: bytes) -> list[dict]:
    """Blocks of every member, with member number and places in the file."""
    out = []
    for m in members(data):
        for b in deflate_blocks(data[: m["compressed_end"]], 8 * m["deflate_start"]):
            out.append(b | {"member": m["number"], "decoded_start": m["decoded_start"] + b["decoded_start"]})
    return out


def check_level(level: int | None, default: int) -> int:
    if level is None:
        return default
    if not 1 <= level <= 9:
        raise ConfigError("the level is from 1 to 9")
    return level


def encode_segment(segment: bytes, before: bytes, level: int) -> bytes:
    """DEFLATE of a segment that may refer to the 32 KiB before it, up to a byte boundary."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=before[-WINDOW:]) if before else zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(segment) + c.flush(zlib.Z_SYNC_FLUSH)


FINAL_BLOCK = b"\x03\x00"


def gzip_header(level: int) -> bytes:
    return struct.pack("<4BI2B", 0x1F, 0x8B, 8, 0, 0, 4 if level <= 2 else 2 if level >= 8 else 0, 255)


def join_segments(segments: list[tuple[bytes, int, int]], level: int) -> bytes:
    """One member from (encoded, crc32, length) of its segments in order."""
    crc = n = 0
    for _, c, size in segments:
        crc, n = crc32_combine(crc, c, size), n + size
    return gzip_header(level) + b"".join(x for x, _, _ in segments) + FINAL_BLOCK + struct.pack("<II", crc, n & 0xFFFFFFFF)


def encode(data: bytes, level: int | None = None) -> bytes:
    level = check_level(level, DEFAULT_LEVEL)
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return gzip_header(level) + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def encode_deflate(data: bytes, level: int | None = None) -> bytes:
    c = zlib.compressobj(check_level(level, DEFAULT_LEVEL), zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()
