"""bzip2: markers at any bit, blocks as streams of their own, the chain of accepted blocks, encoding."""

from __future__ import annotations

import bz2
import itertools
from collections.abc import Iterator

import numpy as np

from ..errors import BadChecksum, BadCompressedFile, BadHeader, BadMagic, TrailingData, Truncated
from .bits import MsbReader, packed, shifted
from .checksums import bz2_crc32, fold_stream_crc
from .gzipfmt import check_level

BLOCK_MARK, END_MARK = 0x314159265359, 0x177245385090
MARK_BITS = 48
SCAN_CHUNK = 1 << 20
DEFAULT_LEVEL = 9
#: Largest block after run expansion: 255 more copies for every five bytes.
MOST_IN_BLOCK = 900_000 // 5 * 259 + 4
#: Longest run that the library codes as one (the format allows 259).
LIBRARY_RUN = 255
#: Bits that a coded block has at most: 20 for each of 900,001 symbols, six tables and the selectors.
MOST_BITS_IN_BLOCK = 20 * 900_001 + (1 << 18)


def find_marks(data: bytes, mark: int) -> list[int]:
    """Bit offsets of a 48-bit mark in data at all eight alignments, ascending.

    For each alignment the four whole bytes inside the mark are searched as one word; hits are compared in full.
    """
    raw = np.frombuffer(data, np.uint8)
    found = []
    if len(raw) >= 6:
        for shift in range(8):
            aligned = mark << (8 - shift) if shift else mark << 8
            inner = (aligned >> 16 & 0xFFFFFFFF).to_bytes(4, "big")  # bytes 1 .. 4 of the 7 that the mark touches
            at = data.find(inner)
            while at >= 0:
                bit = 8 * (at - 1) + shift
                if bit >= 0 and bit + MARK_BITS <= 8 * len(data) and shifted(data, bit, bit + MARK_BITS)[0] == mark:
                    found.append(bit)
                at = data.find(inner, at + 1)
    return sorted(set(found))


def scan(data: bytes, first: int = 0, until: int | None = None) -> dict[str, list[dict]]:
    """Candidates, none of which is trusted: streams, blocks and stream_ends that begin in bytes [first, until)."""
    until = len(data) if until is None else until
    if first == 0 and not (data[:3] == b"BZh" and data[3:4] and 0x31 <= data[3] <= 0x39):
        raise BadMagic("the input begins with no bzip2 stream", 0)
    part = data[first : until + 18]
    blocks, ends, streams = [], [], []
    for bit in find_marks(part, BLOCK_MARK):
        if bit < 8 * (until - first) and bit + 105 <= 8 * len(part):
            crc, randomized, origin = (shifted(part, a, b)[0] for a, b in ((bit + 48, bit + 80), (bit + 80, bit + 81), (bit + 81, bit + 105)))
            blocks.append({"bit_offset": int(bit) + 8 * first, "expected_crc": crc, "randomized": bool(randomized), "orig_ptr": origin})
    for bit in find_marks(part, END_MARK):
        if bit < 8 * (until - first) and bit + 80 <= 8 * len(part):
            ends.append({"bit_offset": int(bit) + 8 * first, "expected_stream_crc": shifted(part, bit + 48, bit + 80)[0]})
    at = part.find(b"BZh")
    while 0 <= at < until - first:
        if part[at + 3 : at + 4] and 0x31 <= part[at + 3] <= 0x39:
            streams.append({"byte_offset": at + first, "block_size_100k": part[at + 3] - 0x30})
        at = part.find(b"BZh", at + 1)
    return {"streams": streams, "blocks": blocks, "stream_ends": ends}


def rewrapped(data: bytes, start_bit: int, end_bit: int, level: int) -> bytes:
    """One block as a stream of its own: header, the block's bits, end mark, the block's checksum as the stream's."""
    bits, n = shifted(data, start_bit, end_bit)
    crc = bits >> (n - 80) & 0xFFFFFFFF
    return b"BZh%d" % level + packed(bits << 80 | END_MARK << 32 | crc, n + 80)


def decode_block(data: bytes, start_bit: int, end_bit: int, level: int, expected_crc: int | None = None) -> bytes:
    """The bytes of the block in [start_bit, end_bit); it must end there, must not be randomized and fit the level."""
    if end_bit - start_bit < 105 or shifted(data, start_bit, start_bit + 48)[0] != BLOCK_MARK:
        raise BadCompressedFile("no block begins here", start_bit)
    crc, randomized, _ = (shifted(data, a, b)[0] for a, b in ((start_bit + 48, start_bit + 80), (start_bit + 80, start_bit + 81), (0, 0)))
    if randomized:
        raise BadHeader("randomized blocks are not supported", start_bit + 80)
    if expected_crc is not None and crc != expected_crc:
        raise BadChecksum("the block's checksum is another", start_bit + 48)
    d = bz2.BZ2Decompressor()
    try:
        out = d.decompress(rewrapped(data, start_bit, end_bit, level))
    except (OSError, ValueError) as e:
        raise BadCompressedFile(f"a block cannot be decoded: {e}", start_bit) from None
    if not d.eof or d.unused_data:
        raise BadCompressedFile("a block does not end at the next mark", end_bit)
    return out


def candidate(data: bytes, start_bit: int, stops: list[int], level: int = 9) -> tuple[int, bytes] | None:
    """(end_bit, bytes) of a block by the first of the following marks that ends it, or None."""
    for end in stops:
        try:
            return end, decode_block(data, start_bit, end, level)
        except BadCompressedFile:
            continue
    return None


def chunks(data: bytes) -> Iterator[tuple[str, object]]:
    """("stream", fields), ("block", (fields, bytes)) and ("end", fields) along the chain of blocks of a valid file.

    A block must begin where the one before ended; a stream's checksum is folded anew from its blocks; after a stream's
    end the next header begins at the next byte, and anything else is an error.
    """
    marks = scan(data)
    starts = {b["bit_offset"]: b for b in marks["blocks"]}
    ends = {b["bit_offset"]: b for b in marks["stream_ends"]}
    if len(starts) + len(ends) > len(data) // 16 + 64:
        raise BadCompressedFile("more marks than the input can hold blocks")
    stops = sorted([*starts, *ends])
    index = {b: i for i, b in enumerate(stops)}
    at = number = stream = start = 0
    while at < len(data):
        head = data[at : at + 4]
        if len(head) < 4:
            raise (TrailingData if stream else Truncated)("the input ends in a stream header", 8 * at)
        if head[:3] != b"BZh" or not 0x31 <= head[3] <= 0x39:
            raise (TrailingData if stream else BadMagic)("no stream begins here", 8 * at)
        level = head[3] - 0x30
        fields = {"number": stream, "header_byte": at, "block_size_100k": level, "first_block": number, "decoded_start": start}
        yield "stream", fields
        bit, crcs = 8 * at + 32, []
        while bit not in ends:
            if bit not in starts:
                raise (Truncated if bit + 80 > 8 * len(data) else BadCompressedFile)("neither a block nor an end begins here", bit)
            got = None
            for end in itertools.islice(stops, index[bit] + 1, None):
                if end - bit > MOST_BITS_IN_BLOCK and end != stops[index[bit] + 1]:
                    break
                try:
                    got = decode_block(data, bit, end, level)
                    break
                except BadHeader:
                    raise
                except BadCompressedFile as e:
                    failed = e
            if got is None:
                if index[bit] + 1 >= len(stops):
                    raise Truncated("the input ends in a block", bit)
                raise failed
            crcs.append(starts[bit]["expected_crc"])
            yield "block", ({"number": number, "stream": stream, "compressed_start_bit": bit, "compressed_end_bit": end, "decoded_start": start, "decoded_bytes": len(got), "expected_crc": crcs[-1]}, got)
            number, start, bit = number + 1, start + len(got), end
        want = ends[bit]["expected_stream_crc"]
        if fold_stream_crc(crcs) != want:
            raise BadChecksum("the stream's checksum differs", bit + 48)
        yield "end", fields | {"block_count": number - fields["first_block"], "decoded_bytes": start - fields["decoded_start"], "eos_bit": bit, "expected_crc": want}
        stream, at = stream + 1, (bit + 80 + 7) // 8
    if not stream:
        raise Truncated("no bzip2 stream", 0)


def layout(data: bytes) -> tuple[list[dict], list[dict]]:
    """(streams, blocks) of a valid file."""
    streams, blocks = [], []
    for kind, x in chunks(data):
        if kind == "end":
            streams.append(x)
        elif kind == "block":
            blocks.append(x[0])
    return streams, blocks


def decode(data: bytes) -> Iterator[bytes]:
    """Decoded pieces by the library, stream by stream; what it lets pass is refused: other bytes behind a stream, no
    stream at all, randomized blocks."""
    if not data:
        raise Truncated("no bzip2 stream", 0)
    at, first = 0, True
    while at < len(data):
        head = data[at : at + 4]
        if len(head) < 4 or head[:3] != b"BZh" or not 0x31 <= head[3] <= 0x39:
            raise (BadMagic if first else TrailingData)("no stream begins here", 8 * at)
        d = bz2.BZ2Decompressor()
        feed = data[at:] if at else data
        _refuse_randomized(feed, at)
        try:
            piece = d.decompress(feed, 1 << 20)
            while True:
                if piece:
                    yield piece
                if d.eof:
                    break
                if d.needs_input:
                    raise Truncated("the input ends in a stream", 8 * len(data))
                piece = d.decompress(b"", 1 << 20)
        except (OSError, ValueError) as e:
            raise BadCompressedFile(str(e), 8 * at) from None
        at, first = len(data) - len(d.unused_data), False


def _refuse_randomized(stream: bytes, at: int) -> None:
    r = MsbReader(stream, 32)
    if r.remaining() >= 81 and r.peek(48) == BLOCK_MARK and r.peek(81) & 1:
        raise BadHeader("randomized blocks are not supported", 8 * at + 112)


def encode(data: bytes, level: int | None = None) -> bytes:
    return bz2.compress(data, check_level(level, DEFAULT_LEVEL))


def rle1_segments(data: bytes, limit: int) -> list[tuple[int, int]]:
    """[start, end) of pieces that fit a block of `limit` bytes after run-length coding as the library does it."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    start = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
    length = np.diff(np.r_[start, len(raw)])
    out, begin, used = [], 0, 0
    for s, n in zip(start.tolist(), length.tolist()):
        while n:
            take = min(n, LIBRARY_RUN)
            cost = take if take < 4 else 5
            if used + cost > limit:
                out.append((begin, s))
                begin, used = s, 0
            used, s, n = used + cost, s + take, n - take
    out.append((begin, len(raw)))
    return out


def encode_piece(data: bytes, level: int) -> tuple[int, int, int]:
    """(bits of one block, how many, checksum) of a piece that fits one block."""
    stream = bz2.compress(data, level)
    ends = find_marks(stream, END_MARK)
    bits, n = shifted(stream, 32, int(ends[-1]))
    return bits, n, bz2_crc32(data)


def join_blocks(blocks: list[tuple[int, int, int]], level: int) -> bytes:
    """One stream from the bits of its blocks, which need not end at a byte."""
    parts, held, n = [b"BZh%d" % level], 0, 0
    tail = END_MARK << 32 | fold_stream_crc(c for _, _, c in blocks)
    for bits, size, _ in [*blocks, (tail, 80, 0)]:
        held, n = held << size | bits, n + size
        rest = n % 8
        parts.append((held >> rest).to_bytes(n // 8, "big"))
        held, n = held & ((1 << rest) - 1), rest
    return b"".join(parts) + (packed(held, n) if n else b"")
