"""LZ4 frames: parsing and checking, block layout, decoding block by block, writing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa

from ..errors import BadChecksum, BadCompressedFile, BadHeader, BadMagic, ConfigError, Truncated
from .checksums import xxh32

MAGIC, LEGACY = 0x184D2204, 0x184C2102
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: Block sizes by their code in a frame descriptor.
BLOCK_SIZES = {4: 64 << 10, 5: 256 << 10, 6: 1 << 20, 7: 4 << 20}
HISTORY = 64 << 10
DEFAULT_LEVEL = 1
_CODEC = pa.Codec("lz4_raw")


def frame_header(data: bytes, at: int) -> dict:
    """Fields of the frame descriptor behind the magic at `at`, and `end`, the place of the first block."""
    if len(data) < at + 7:
        raise Truncated("the input ends in a frame descriptor", 8 * at)
    flags, sizes = data[at + 4], data[at + 5]
    if flags >> 6 != 1:
        raise BadHeader("an unknown version", 8 * at + 32)
    if flags & 2 or sizes & 0x8F:
        raise BadHeader("reserved bits are set", 8 * at + 32)
    if flags & 1:
        raise BadHeader("dictionaries are not supported", 8 * at + 32)
    if (sizes >> 4) not in BLOCK_SIZES:
        raise BadHeader("an unknown block size", 8 * at + 40)
    p = at + 6 + (8 if flags & 8 else 0)
    if len(data) <= p:
        raise Truncated("the input ends in a frame descriptor", 8 * at)
    if xxh32(data[at + 4 : p]) >> 8 & 0xFF != data[p]:
        raise BadChecksum("the descriptor's checksum differs", 8 * p)
    return {
        "compressed_start": at, "block_max_size": BLOCK_SIZES[sizes >> 4], "block_mode": "independent" if flags & 32 else "linked",
        "block_checksums": bool(flags & 16), "content_checksum": bool(flags & 4), "declared_content_size": struct.unpack_from("<Q", data, at + 6)[0] if flags & 8 else None, "end": p + 1,
    }


def decode_block(block: bytes, history: bytes, most: int) -> bytes:
    """Literals and matches of one block; matches may reach into `history`, the output may not exceed `most` bytes."""
    out = bytearray(history)
    base, p, n = len(history), 0, len(block)
    try:
        while True:
            token = block[p]
            p += 1
            size = token >> 4
            if size == 15:
                while True:
                    more = block[p]
                    p, size = p + 1, size + more
                    if more != 255:
                        break
            if p + size > n:
                raise BadCompressedFile("literals run over the block")
            out += block[p : p + size]
            p += size
            if len(out) - base > most:
                raise BadCompressedFile("a block is larger than its frame allows")
            if p == n:
                return bytes(out[base:])
            back = block[p] | block[p + 1] << 8
            p += 2
            size = (token & 15) + 4
            if token & 15 == 15:
                while True:
                    more = block[p]
                    p, size = p + 1, size + more
                    if more != 255:
                        break
            if not 0 < back <= len(out):
                raise BadCompressedFile("a match reaches before the beginning")
            if len(out) - base + size > most:
                raise BadCompressedFile("a block is larger than its frame allows")
            if back >= size:
                at = len(out) - back
                out += out[at : at + size]
            else:
                unit = bytes(out[-back:])
                out += (unit * (size // back + 1))[:size]
    except IndexError:
        raise Truncated("a block ends within a sequence") from None


def _independent(block: bytes, most: int, code: int) -> bytes:
    """A block without history, by the C library: as the only block of a frame, whose size need not be known."""
    body = bytes([0x60, code << 4])
    frame = struct.pack("<I", MAGIC) + body + bytes([xxh32(body) >> 8 & 0xFF]) + struct.pack("<I", len(block)) + block + bytes(4)
    try:
        with pa.CompressedInputStream(pa.BufferReader(frame), "lz4") as f:
            return f.read(most + 1)
    except OSError as e:
        raise BadCompressedFile(str(e)) from None


def chunks(data: bytes) -> Iterator[tuple[str, object]]:
    """("frame", fields), ("block", (fields, bytes)) and ("end", fields) of concatenated and skippable frames."""
    at = number = start = frames = 0
    if not data:
        raise Truncated("no LZ4 frame", 0)
    while at < len(data):
        if len(data) < at + 4:
            raise Truncated("the input ends in a magic number", 8 * at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            size = struct.unpack_from("<I", data, at + 4)[0] if len(data) >= at + 8 else None
            if size is None or len(data) < at + 8 + size:
                raise Truncated("the input ends in a skippable frame", 8 * at)
            at += 8 + size
            continue
        if magic == LEGACY:
            raise BadHeader("legacy frames are not supported", 8 * at)
        if magic != MAGIC:
            raise BadMagic("no LZ4 frame begins here", 8 * at)
        f = frame_header(data, at) | {"number": frames, "first_block": number, "decoded_start": start}
        p = f.pop("end")
        yield "frame", f
        code = next(c for c, n in BLOCK_SIZES.items() if n == f["block_max_size"])
        history, content = b"", []
        while True:
            if len(data) < p + 4:
                raise Truncated("the input ends before an end mark", 8 * p)
            word = struct.unpack_from("<I", data, p)[0]
            if not word:
                p += 4
                break
            stored, size = bool(word >> 31), word & 0x7FFFFFFF
            end = p + 4 + size
            if not 0 < size <= f["block_max_size"]:
                raise BadCompressedFile("a block is empty or larger than its frame allows", 8 * p)
            if len(data) < end + 4 * f["block_checksums"]:
                raise Truncated("the input ends in a block", 8 * p)
            raw = data[p + 4 : end]
            if f["block_checksums"] and xxh32(raw) != struct.unpack_from("<I", data, end)[0]:
                raise BadChecksum("a block's checksum differs", 8 * end)
            if stored:
                out = raw
            elif f["block_mode"] == "independent":
                out = _independent(raw, f["block_max_size"], code)
            else:
                out = decode_block(raw, history, f["block_max_size"])
            if len(out) > f["block_max_size"]:
                raise BadCompressedFile("a block is larger than its frame allows", 8 * p)
            if f["block_mode"] == "linked":
                history = (history + out)[-HISTORY:]
            if f["content_checksum"]:
                content.append(out)
            yield "block", ({"number": number, "frame": frames, "compressed_start": p, "compressed_end": end + 4 * f["block_checksums"], "decoded_start": start, "decoded_bytes": len(out), "stored": stored}, out)
            number, start, p = number + 1, start + len(out), end + 4 * f["block_checksums"]
        if f["declared_content_size"] is not None and start - f["decoded_start"] != f["declared_content_size"]:
            raise BadCompressedFile("the frame's size is not the declared one", 8 * p)
        if f["content_checksum"]:
            if len(data) < p + 4:
                raise Truncated("the input ends in a content checksum", 8 * p)
            if xxh32(b"".join(content)) != struct.unpack_from("<I", data, p)[0]:
                raise BadChecksum("the content's checksum differs", 8 * p)
            p += 4
        yield "end", f | {"compressed_end": p, "decoded_bytes": start - f["decoded_start"], "block_count": number - f["first_block"]}
        at, frames = p, frames + 1
    if not frames:
        raise Truncated("no LZ4 frame", 0)


def layout(data: bytes) -> tuple[list[dict], list[dict]]:
    frames, blocks = [], []
    for kind, x in chunks(data):
        if kind == "end":
            frames.append(x)
        elif kind == "block":
            blocks.append(x[0])
    return frames, blocks


def decode(data: bytes) -> Iterator[bytes]:
    return (x[1] for kind, x in chunks(data) if kind == "block")


def encode_block(data: bytes, level: int) -> tuple[bytes, bool]:
    """(bytes, stored): the compressed block unless it is no smaller."""
    out = (_CODEC if level <= 6 else pa.Codec("lz4_raw", compression_level=level)).compress(data, asbytes=True) if data else b""
    return (data, True) if len(out) >= len(data) else (out, False)


def block_words(blocks: list[tuple[bytes, bool]]) -> bytes:
    return b"".join(struct.pack("<I", len(b) | (stored << 31)) + b for b, stored in blocks)


def join_blocks(blocks: list[tuple[bytes, bool]], block_size: int, content_xxh32: int) -> bytes:
    """A frame of independent blocks with a content checksum."""
    code = next((c for c, n in BLOCK_SIZES.items() if n == block_size), None)
    if code is None:
        raise ConfigError("blocks are of 64 KiB, 256 KiB, 1 MiB or 4 MiB")
    body = bytes([0x64, code << 4])
    return struct.pack("<I", MAGIC) + body + bytes([xxh32(body) >> 8 & 0xFF]) + block_words(blocks) + bytes(4) + struct.pack("<I", content_xxh32)


def encode(data: bytes, level: int | None = None, block_size: int = 4 << 20) -> bytes:
    from .gzipfmt import check_level

    level = check_level(level, DEFAULT_LEVEL)
    blocks = [encode_block(data[i : i + block_size], level) for i in range(0, len(data), block_size)]
    return join_blocks(blocks, block_size, xxh32(data))
