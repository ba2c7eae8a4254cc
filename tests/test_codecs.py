"""Single objects: every format against the standard library, damaged inputs, limits."""

import bz2
import gzip
import itertools
import struct
import zlib

import pyarrow as pa
import pytest
from conftest import patterned, xorshift
from hypothesis import given, settings
from hypothesis import strategies as st

from codecflow import api, errors
from codecflow.operators import bits, bzip2, checksums, codecs, gzipfmt, lz4fmt

CASES = [b"", b"a", b"hello", patterned(70_000), xorshift(20_000), b"abc" * 20_000, bytes(32_769), bytes(range(256)) * 200]


@pytest.mark.parametrize("format", codecs.FORMATS)
@pytest.mark.parametrize("level", [None, 1, 6, 9])
def test_round_trip(format, level):
    for plain in CASES:
        coded = api.compress(plain, format, level=level)
        assert codecs.format_of(coded) == format
        assert api.decompress(coded) == plain == api.decompress(coded, format)
        api.test(coded)
        if format == "gzip":
            assert gzip.decompress(coded) == plain
        if format == "bzip2":
            assert bz2.decompress(coded) == plain
        if format == "lz4" and plain:
            assert pa.CompressedInputStream(pa.BufferReader(coded), "lz4").read() == plain


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=4), st.sampled_from(codecs.FORMATS))
def test_concatenated(parts, format):
    assert api.decompress(b"".join(api.compress(p, format) for p in parts)) == b"".join(parts)


@pytest.mark.parametrize("format", codecs.FORMATS)
def test_every_prefix_fails(format):
    coded = api.compress(xorshift(300), format)
    for n in range(len(coded)):
        with pytest.raises(errors.CodecError):
            api.decompress(coded[:n], format)


@pytest.mark.parametrize("format", codecs.FORMATS)
def test_flipped_bytes_never_pass_unnoticed(format):
    plain = patterned(3000)
    coded = bytearray(api.compress(plain, format))
    for i in range(0, len(coded), 7):
        coded[i] ^= 0x20
        try:
            assert api.decompress(bytes(coded), format) == plain  # a field without meaning, such as the time
        except errors.CodecError:
            pass
        coded[i] ^= 0x20


def test_bzip2_refusals():
    coded = bz2.compress(patterned(1000))
    for bad, error in ((coded[:-2] + bytes([coded[-2] ^ 1]) + coded[-1:], errors.BadCompressedFile), (coded + b"junk", errors.TrailingData), (b"", errors.Truncated), (b"PK\3\4", errors.BadMagic)):
        for decode in (lambda x: list(bzip2.decode(x)), lambda x: list(bzip2.chunks(x))):
            with pytest.raises(error if bad or decode is None else errors.CodecError):
                decode(bad)
    number, n = bits.shifted(coded, 0, 8 * len(coded))
    randomized = bits.packed(number | 1 << (n - 1 - 112), n)
    with pytest.raises(errors.BadHeader):
        list(bzip2.decode(randomized))
    with pytest.raises(errors.BadHeader):
        list(bzip2.chunks(randomized))


@pytest.mark.parametrize("level", [1, 3])
def test_bzip2_blocks_apart(level):
    plain = patterned(350_000) + xorshift(10_000)
    coded = bz2.compress(plain, level) + bz2.compress(b"next", 9)
    streams, blocks = bzip2.layout(coded)
    assert [s["block_size_100k"] for s in streams] == [level, 9]
    assert b"".join(bzip2.decode_block(coded, b["compressed_start_bit"], b["compressed_end_bit"], level if b["stream"] == 0 else 9, b["expected_crc"]) for b in blocks) == plain + b"next"
    assert [b["bit_offset"] for b in api.scan(coded)["blocks"]] == [b["compressed_start_bit"] for b in blocks]


@pytest.mark.parametrize("pad", range(8))
def test_marks_at_every_bit(pad):

    data = b"BZh9" + bits.packed(bzip2.BLOCK_MARK << 57 | 0x89ABCDEF << 25 | 1 << 24 | 0x123456, 105 + pad) + bytes(4)
    (b,) = api.scan(data)["blocks"]
    assert (b["bit_offset"], b["expected_crc"], b["randomized"], b["orig_ptr"]) == (32 + pad, 0x89ABCDEF, True, 0x123456)


def test_rle1_segments_fit_blocks():
    plain = b"ab" * 50_000 + bytes(400_000) + xorshift(150_000)
    spans = bzip2.rle1_segments(plain, 99_981)
    assert spans[0][0] == 0 and spans[-1][1] == len(plain) and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    assert bz2.decompress(bzip2.join_blocks([bzip2.encode_piece(plain[a:b], 1) for a, b in spans], 1)) == plain


def test_gzip_header_fields():
    head = struct.pack("<4BI2B", 0x1F, 0x8B, 8, 0x1E, 123456, 0, 3) + struct.pack("<H", 3) + b"xyz" + b"name\0" + b"remark\0"
    head += struct.pack("<H", zlib.crc32(head) & 0xFFFF)
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    plain = b"plain" * 100
    coded = head + body.compress(plain) + body.flush() + struct.pack("<II", zlib.crc32(plain), len(plain))
    (m,) = gzipfmt.members(coded)
    assert (m["name"], m["comment"], m["mtime"], m["operating_system"]) == (b"name", b"remark", 123456, 3)
    assert api.decompress(coded + bytes(5)) == plain
    with pytest.raises(errors.TrailingData):
        api.decompress(coded + b"\0x")
    for at, error in ((3, errors.BadHeader), (len(head) - 1, errors.BadChecksum), (len(coded) - 8, errors.BadChecksum), (len(coded) - 4, errors.BadCompressedFile)):
        bad = bytearray(coded)
        bad[at] ^= 0x80 if at == 3 else 1
        with pytest.raises(error):
            api.decompress(bytes(bad), "gzip")


def test_deflate_blocks():
    plain = patterned(200_000) + xorshift(70_000)
    for level, kinds in ((0, {"stored"}), (6, None)):
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        raw = c.compress(plain) + c.flush()
        found = gzipfmt.deflate_blocks(raw)
        assert sum(b["decoded_bytes"] for b in found) == len(plain) and found[-1]["is_final"] and (kinds is None or {b["kind"] for b in found} == kinds)
    c = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_FIXED)
    assert {b["kind"] for b in gzipfmt.deflate_blocks(c.compress(b"abcabc" * 50) + c.flush())} == {"fixed"}
    for bad in (b"\x06", b"\x01\x01\x00\x00\x00a", b"\x01\x05\x00"):
        with pytest.raises(errors.CodecError):
            gzipfmt.deflate_blocks(bad)
    with pytest.raises(errors.TrailingData):
        gzipfmt.decode_deflate(gzipfmt.encode_deflate(b"x") + b"y")


@pytest.mark.parametrize("size, linked, block_sum, content_sum, declared", list(itertools.product([4, 5], [0, 1], [0, 1], [0, 1], [0, 1])))
def test_lz4_frames(size, linked, block_sum, content_sum, declared):
    plain = (b"the same words again and again " * 9000)[:200_000]
    n, frame = lz4fmt.BLOCK_SIZES[size], b""
    for i in range(0, len(plain), n):
        block, stored = lz4fmt.encode_block(plain[i : i + n], 1)  # blocks without references to others are valid linked ones
        frame += struct.pack("<I", len(block) | stored << 31) + block + (struct.pack("<I", checksums.xxh32(block)) if block_sum else b"")
    body = bytes([0x40 | (not linked) << 5 | block_sum << 4 | declared << 3 | content_sum << 2, size << 4]) + (struct.pack("<Q", len(plain)) if declared else b"")
    whole = struct.pack("<I", lz4fmt.MAGIC) + body + bytes([checksums.xxh32(body) >> 8 & 255]) + frame + bytes(4) + (struct.pack("<I", checksums.xxh32(plain)) if content_sum else b"")
    assert api.decompress(struct.pack("<II", 0x184D2A51, 2) + b"zz" + whole + whole) == plain + plain
    frames, blocks = lz4fmt.layout(whole)
    assert frames[0]["block_mode"] == ("linked" if linked else "independent") and len(blocks) == -(-len(plain) // n)
    bad = bytearray(whole)
    bad[len(bad) // 2] ^= 0x55
    try:
        assert api.decompress(bytes(bad)) != plain or not (block_sum or content_sum)
        assert not (block_sum or content_sum)
    except errors.CodecError:
        pass


def test_lz4_matches_reach_into_history():
    # five literals, a match 11 bytes back into the block before, and final literals
    block = bytes([0x50]) + b"01234" + struct.pack("<H", 11) + bytes([0x50]) + b"tail."
    assert lz4fmt.decode_block(block, b"abcdefghij", 1000) == b"01234" + b"efgh" + b"tail."
    with pytest.raises(errors.BadCompressedFile):
        lz4fmt.decode_block(block, b"", 1000)
    with pytest.raises(errors.BadCompressedFile):
        lz4fmt.decode_block(block, b"abcdefghij", 8)
    with pytest.raises(errors.BadHeader):
        api.decompress(struct.pack("<I", lz4fmt.LEGACY) + bytes(20), "lz4")


def test_checksums():
    assert checksums.bz2_crc32(b"123456789") == 0xFC891918 == api.bz2_crc32(b"123456789")
    assert checksums.fold_stream_crc([0x12345678, 1]) == 0x2468ACF1
    a, b = xorshift(1000), patterned(777)
    assert checksums.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.binary(min_size=1, max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_bit_readers(data, draw):
    text = "".join(f"{b:08b}" for b in data)
    start = draw.draw(st.integers(0, len(text) - 1))
    n = draw.draw(st.integers(1, min(40, len(text) - start)))
    assert bits.MsbReader(data, start).read(n) == int(text[start : start + n], 2)
    assert bits.LsbReader(data, start).read(n) == int.from_bytes(data, "little") >> start & (1 << n) - 1


def test_options_and_limits():
    for make in (lambda: codecs.EncodeOptions("gzip", 10), lambda: codecs.EncodeOptions("gzip", 0), lambda: codecs.EncodeOptions("rar"), lambda: codecs.EncodeOptions("gzip", memory_limit=0), lambda: codecs.DecodeOptions("zip"), lambda: codecs.DecodeOptions(memory_limit=1)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(errors.OutputLimit):
        codecs.decompress_bytes(api.compress(bytes(5000), "gzip"), codecs.DecodeOptions(max_output=4999))
    assert errors.error_class(errors.BadChecksum("x")) == "bad_checksum" and errors.EXIT_CODES["bad_checksum"] == 3 and errors.EXIT_CODES["config"] == 2


def test_reader_gives_the_prefix_then_fails_and_keeps_failing(tmp_path):
    plain = patterned(50_000)
    coded = bytearray(api.compress(plain, "gzip"))
    coded[-6] ^= 1
    r, got = api.open(bytes(coded)), b""
    with pytest.raises(errors.BadChecksum):
        while True:
            got += r.read(1000)
    assert got == plain
    with pytest.raises(errors.BadChecksum):
        r.read(1)
    with pytest.raises(errors.UnsupportedFormat):
        api.open(b"PK\3\4" + bytes(30))
    p = tmp_path / "misnamed.bz2"
    p.write_bytes(api.compress(b"magic first", "gzip"))
    assert api.open(str(p)).read() == b"magic first"


def test_indexed_reader():
    plain = patterned(350_000)
    coded = bz2.compress(plain, 1)
    f = api.open_indexed(coded)
    for start, n in ((0, 17), (99_990, 40), (170_123, 8_192), (349_990, 20)):
        f.seek(start)
        assert f.read(n) == plain[start : start + n]
    assert f.seek(-10, 2) == 349_990 and f.read() == plain[-10:] and f.tell() == f.size == len(plain)
    for bad in (-1, len(plain) + 1):
        with pytest.raises(ValueError):
            f.seek(bad)
    again = api.open_indexed(coded, f.index_bytes)
    again.seek(5)
    assert again.read(5) == plain[5:10]
    for data, index in ((coded, b"x" + f.index_bytes[1:]), (bz2.compress(plain, 2), f.index_bytes), (coded, f.index_bytes[:20])):
        with pytest.raises(errors.BadIndex):
            api.open_indexed(data, index)
