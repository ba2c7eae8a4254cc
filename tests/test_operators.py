"""DataFrame operators, data source, sinks and streaming against plain Python."""

import bz2
import gzip
import io
import os
import tarfile
import zipfile

import pytest
from conftest import patterned, xorshift
from pyspark.sql import functions as F

from codecflow import errors
from codecflow.functions import checksums, detect
from codecflow.operators import archives, bzip2, codecs, relational
from codecflow.plans import distributed, layout, queries, ranges
from codecflow.sources import objects, sinks
from codecflow.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, values, column="content"):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"path string, {column} binary")


PLAIN = [b"", b"a", patterned(350_000), xorshift(120_000), b"words and words " * 9000]


@pytest.mark.parametrize("format", codecs.FORMATS)
def test_columns_round_trip(spark, format):
    df = frame(spark, [*PLAIN, None], "plain")
    got = codecs.decompress(codecs.compress(df, format).drop("plain"))
    assert {r["path"]: r["plain"] for r in got.collect()} == {str(i): v for i, v in enumerate([*PLAIN, None])}


def test_segments_and_blocks(spark):
    df = frame(spark, PLAIN, "plain")
    for coded in (distributed.encode_gzip(df, segment=64 << 10), distributed.encode_lz4(df, block_size=64 << 10), distributed.encode_bzip2(df, level=1)):
        got = {r["path"]: bytes(r["plain"]) for r in codecs.decompress(coded).collect()}
        assert got == {str(i): v for i, v in enumerate(PLAIN)}
    for make in (lambda: distributed.encode_gzip(df, level=10), lambda: distributed.encode_gzip(df, segment=5), lambda: distributed.encode_lz4(df, block_size=5)):
        with pytest.raises(errors.ConfigError):
            make()


def test_parallel_bzip2(spark):
    plain = [patterned(350_000), xorshift(250_000), b"x"]
    coded = frame(spark, [bz2.compress(plain[0], 1) + bz2.compress(plain[1], 1), bz2.compress(plain[2])])
    got = {}
    for r in sorted(distributed.decode_bzip2(coded).collect(), key=lambda r: (r["path"], r["number"])):
        assert r["decoded_start"] == len(got.get(r["path"], b""))
        got[r["path"]] = got.get(r["path"], b"") + bytes(r["plain"])
    assert got == {"0": plain[0] + plain[1], "1": b"x"}
    bad = bytearray(bz2.compress(plain[0], 1))
    bad[-2] ^= 1
    with pytest.raises(Exception, match="checksum"):
        distributed.decode_bzip2(frame(spark, [bytes(bad)])).collect()
    assert rows(layout.marks(coded)) == rows(layout.marks_in_chunks(coded, chunk=10_000))


def test_chance_headers_are_no_streams(spark, tmp_path):
    text = "caaccaccacaacacacaaaacccccaccacaaaaaaaaaaaaaaaaa"  # its checksum is the four bytes of a stream header
    coded = bz2.compress(text.encode(), 1)
    assert coded.find(b"BZh5") == 10
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(queries.queries()["scan_marks"](spark, str(tmp_path))) == [("0", 0, 32, 1, 1, True, True)]
    twice = frame(spark, [coded + bz2.compress(b""), bz2.compress(b"")])
    got = relational.with_sound_streams(layout.marks(twice)).where("kind = 'stream'")
    assert rows(got.select("path", "bit_offset")) == [("0", 0), ("0", 8 * len(coded)), ("1", 0)]


def test_index_and_ranges(spark):
    plain = patterned(350_000)
    coded = frame(spark, [bz2.compress(plain, 1)])
    index = ranges.build_index(coded)
    assert ranges.check_index(index, coded).isEmpty()
    asked = [("a", "0", 0, 17), ("b", "0", 99_990, 40), ("c", "0", 170_123, 8_192), ("d", "0", 349_990, 20), ("e", "0", 350_000, 5), ("f", "0", 5, 0)]
    got = ranges.read_ranges(spark.createDataFrame(asked, "request string, path string, start long, length long"), index, coded)
    assert {r["request"]: bytes(r["content"]) for r in got.collect()} == {a: plain[s : s + n] for a, _, s, n in asked}
    assert {r["rule"] for r in ranges.check_index(index, frame(spark, [bz2.compress(plain, 2)])).collect()} >= {"another source"}
    shifted = index.withColumn("decoded_start", F.col("decoded_start") + F.col("number"))
    assert {r["rule"] for r in ranges.check_index(shifted, coded).collect()} == {"decoded gap"}
    with pytest.raises(errors.BadIndex):
        ranges.require_index(shifted, coded)
    places = spark.range(1).select(ranges.place(F.lit(-10), F.lit(100), 2), ranges.place(F.lit(101), F.lit(100)), ranges.place(F.lit(5), F.lit(100), 1, F.lit(7))).first()
    assert tuple(places) == (90, None, 12)


def test_saved_index(spark, tmp_path):
    coded = frame(spark, [bz2.compress(patterned(250_000), 1)])
    ranges.save_index(ranges.build_index(coded), str(tmp_path / "index"))
    again = ranges.load_index(spark, str(tmp_path / "index")).withColumn("path", F.col("path").cast("string"))
    assert ranges.check_index(again, coded).isEmpty()


def test_validation_and_prefix(spark):
    good = gzip.compress(patterned(3000))
    bad = good[:-6] + bytes([good[-6] ^ 1]) + good[-5:]
    df = frame(spark, [good, bad, b"no format", None])
    checks = {r["path"]: r["check"] for r in codecs.validate(df).collect()}
    assert checks["0"]["ok"] and checks["3"] is None
    assert [checks[k]["error_class"] for k in "12"] == ["bad_checksum", "unsupported_format"]
    parts = {r["path"]: r["plain"] for r in codecs.decompress_permissive(df).collect()}
    assert bytes(parts["1"]["content"]) == patterned(3000) and parts["1"]["error_class"] == "bad_checksum"


def test_names(spark):
    names = ["a.tar.gz", "b.TBZ2", "c.tgz", "d.lz4", "e.zip", "f.txt", "dir.gz/g", "h.tar.lz4"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    p = F.col("p")
    got = {r["p"]: tuple(r)[1:] for r in df.select("p", detect.from_name(p), detect.output_format(p), detect.decoded_name(p), detect.is_tar_archive(p), detect.is_archive(p)).collect()}
    assert got == {
        "a.tar.gz": ("gzip", "tar.gzip", "a.tar", True, True), "b.TBZ2": ("bzip2", "tar.bzip2", "b.tar", True, True), "c.tgz": ("gzip", "tar.gzip", "c.tar", True, True), "d.lz4": ("lz4", "lz4", "d", False, False),
        "e.zip": ("zip", "zip", "e.zip.out", False, True), "f.txt": (None, None, "f.txt.out", False, False), "dir.gz/g": (None, None, "dir.gz/g.out", False, False), "h.tar.lz4": ("lz4", "tar.lz4", "h.tar", True, True),
    }
    sizes = spark.createDataFrame([(x,) for x in ("7", "1k", "2KiB", "3mb", "x", "9999999999999t", "5ib", "5bb", "5bib", " 5", "5 ", "8b", "kb")], "s string").select(detect.parse_size(F.col("s"))).collect()
    assert [r[0] for r in sizes] == [7, 1024, 2048, 3 << 20, *[None] * 7, 8, None]
    shown = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 40,)], "n long").select(detect.format_bytes(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["0 B", "1023 B", "1.5 KiB", "5.0 TiB"]
    lasted = spark.createDataFrame([(1.6,), (61.0,), (125.0,), (7500.0,), (-3.0,)], "s double").select(detect.format_duration(F.col("s"))).collect()
    assert [r[0] for r in lasted] == ["2s", "1m01s", "2m05s", "2h05m", "0s"]
    assert detect.format_argument("auto") is None and detect.chosen_format("gzip", None) == "gzip"
    for wrong in (lambda: detect.format_argument("zip"), lambda: detect.chosen_format("gzip", "lz4"), lambda: detect.chosen_format(None, None)):
        with pytest.raises(ValueError):
            wrong()
    found = frame(spark, [gzip.compress(b""), bz2.compress(b""), b"\x50\x2a\x4d\x18", b"PK\5\6", b"?"]).select(detect.from_magic(F.col("content"))).collect()
    assert [r[0] for r in found] == ["gzip", "bzip2", "lz4", "zip", None]


def test_checksum_columns(spark):
    r = frame(spark, [b"123456789", None]).select(checksums.bz2_crc32(F.col("content")), checksums.xxh32(F.col("content")), checksums.gzip_crc32(F.col("content"))).collect()
    assert tuple(r[0]) == (0xFC891918, 0x937BAD67, 0xCBF43926) and tuple(r[1]) == (None, None, None)
    assert spark.sql("select array(305419896L, 1L) c").select(checksums.fold_stream_crc(F.col("c"))).first()[0] == 0x2468ACF1


def entries(spark):
    data = [("z", "nested/", "directory", 0o750, 1_700_000_123, b""), ("z", "nested/root.txt", "file", 0o640, 1_700_000_123, b"root " * 500), ("z", "nested/link", "symlink", 0o777, None, b"root.txt"), ("z", "tiny", "file", None, None, b"x")]
    return spark.createDataFrame(data, "archive string, path string, kind string, mode int, mtime long, content binary")


def test_zip(spark):
    (made,) = archives.create_zip(entries(spark)).collect()
    with zipfile.ZipFile(io.BytesIO(made["content"])) as z:
        assert z.testzip() is None and z.read("nested/root.txt") == b"root " * 500
        assert [i.filename for i in z.infolist()] == ["nested/", "nested/link", "nested/root.txt", "tiny"]
        assert {i.filename: i.compress_type for i in z.infolist()} == {"nested/": 0, "nested/link": 0, "nested/root.txt": 8, "tiny": 0}
    whole = frame(spark, [bytes(made["content"])])
    got = {r["path"]: r for r in archives.read_zip(whole).collect()}
    assert got["nested/link"]["kind"] == "symlink" and got["nested/"]["kind"] == "directory" and got["nested/root.txt"]["mtime"] == 1_700_000_123 and got["nested/root.txt"]["mode"] == 0o640
    assert archives.violations(archives.list_zip(whole)).isEmpty()
    with pytest.raises(Exception, match="exceed"):
        archives.read_zip(whole, max_output=100).collect()
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_BZIP2) as z:
        for name in ("same.txt", "same.txt", "../x", "file", "file/under"):
            z.writestr(name, "text " * 10)
    bad = frame(spark, [other.getvalue()])
    assert {r["rule"] for r in archives.violations(archives.list_zip(bad)).collect()} == {"duplicate", "unsafe path", "file as directory", "method"}
    assert {r["error_class"] for r in archives.read_zip(bad).collect()} == {"bad_header"}
    for broken in (b"", other.getvalue()[:-30]):
        with pytest.raises(Exception, match="directory"):
            archives.list_zip(frame(spark, [broken])).collect()


def test_tar(spark):
    for format in (None, *codecs.FORMATS):
        (made,) = archives.create_tar(entries(spark).where("path <> 'nested/'"), format).collect()
        got = {r["path"]: bytes(r["content"]) for r in archives.read_tar(frame(spark, [bytes(made["content"])])).collect()}
        assert got == {"nested/root.txt": b"root " * 500, "nested/link": b"root.txt", "tiny": b"x"}
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name in ("../outside.txt", "in.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    assert [r["path"] for r in archives.read_tar(frame(spark, [buffer.getvalue()])).collect()] == ["in.txt"]


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    df = entries(spark).drop("archive")
    sinks.write_files(df, out)
    assert os.readlink(f"{out}/nested/link") == "root.txt" and os.stat(f"{out}/nested/root.txt").st_mode & 0o777 == 0o640 and os.stat(f"{out}/nested/root.txt").st_mtime == 1_700_000_123
    with pytest.raises(Exception, match="nested"):
        sinks.write_files(df, out)
    assert not [x for x in os.listdir(out) if x.startswith(".staging")]
    sinks.write_files(df.where("path = 'tiny'").withColumn("content", F.lit(b"new")), out, existing="skip")
    assert open(f"{out}/tiny", "rb").read() == b"x"
    sinks.write_files(df.where("path = 'tiny'").withColumn("content", F.lit(b"new")), out, "gzip", existing="overwrite")
    assert gzip.open(f"{out}/tiny").read() == b"new"
    for path, kind, content in (("../x", "file", b""), ("a/l", "symlink", b"../../x")):
        with pytest.raises(Exception, match="leads out"):
            sinks.write_files(spark.createDataFrame([(path, kind, content)], "path string, kind string, content binary"), out)


def test_byte_ranges(spark, tmp_path):
    coded = bz2.compress(patterned(400_000), 1)
    (tmp_path / "x.bz2").write_bytes(coded)
    objects.register(spark)
    parts = spark.read.format("byte_ranges").option("range", "1000").load(str(tmp_path / "x.bz2"))
    assert parts.rdd.getNumPartitions() == -(-len(coded) // 1000)
    want = layout.marks(frame(spark, [coded])).where("kind <> 'stream'").select("kind", "bit_offset", "crc")
    assert rows(objects.marks_of_ranges(parts).select("kind", "bit_offset", "crc")) == rows(want)
    whole = objects.read_objects(spark, str(tmp_path), "*.bz2").select("path", "content")
    assert codecs.validate(whole).select("check.ok").first()[0]
    skipped = objects.not_existing(whole, spark.createDataFrame([("done",)], "path string"), F.lit("done"))
    assert skipped.isEmpty()


def test_stream_of_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(b"first"))
    (tmp_path / "in" / "b.gz").write_bytes(gzip.compress(b"second")[:-3])
    q = streams.decoded(streams.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {os.path.basename(r["path"]): (bytes(r["plain"]), r["error_class"]) for r in spark.sql("select * from arrived").collect()}
    assert got == {"a.gz": (b"first", None), "b.gz": (b"second", "truncated")}


def test_transforms(spark):
    text = ["", "banana", "mississippi", "aaaa" + "b" * 600]
    df = spark.createDataFrame(list(enumerate(text)), "k long, t string")
    got = {r["k"]: (r["last"], r["origin"]) for r in relational.bwt_last_column(df, "k", "t").collect()}
    assert got[1][0] == "nnbaaa" and got[2][0] == "pssmipissii" and got[1][1] == 3
    runs = [tuple(r) for r in relational.runs(df.where("k = 3"), "k", "t").orderBy("start").select("start", "b", "n").collect()]
    assert runs == [(0, 97, 4), (4, 98, 259), (263, 98, 259), (522, 98, 82)]
    for r in relational.mtf_symbols(df, "k", "t").collect():
        order, out = list(range(256)), []
        for b in text[r["k"]].encode():
            out.append(order.index(b))
            order.insert(0, order.pop(out[-1]))
        assert r["symbols"] == out
    chain = spark.createDataFrame([("p", 0, 10), ("p", 10, 25), ("p", 12, 30), ("p", 25, 40)], "path string, start_bit int, end_bit int")
    starts = spark.createDataFrame([("p", 0)], "path string, start_bit int")
    assert [r["start_bit"] for r in relational.chain(chain, starts).orderBy("number").collect()] == [0, 10, 25]
    long = spark.range(5000).select(F.lit("l").alias("path"), (7 * F.col("id")).alias("start_bit"), (7 * F.col("id") + 7).alias("end_bit"))
    first = spark.createDataFrame([("l", 0)], "path string, start_bit long")
    walked = relational.chain(long.where("start_bit <> 7 * 4000"), first).agg(F.count("*"), F.max("number"), F.max("end_bit")).first()
    assert tuple(walked) == (4000, 3999, 28000)
    assert [r["start_bit"] for r in relational.chain_by_lag(chain.where("start_bit <> 12")).orderBy("start_bit").collect()] == [0, 10, 25]


def test_json(spark):
    import json

    one = frame(spark, [gzip.compress(b"x", mtime=0)])
    assert json.loads(layout.json_of_all(one).first()[0])["containers"][0]["decoded_bytes"] == 1
    two = json.loads(layout.json_of_all(frame(spark, [gzip.compress(b"x"), bzip2.encode(b"yy")])).first()[0])
    assert [o["format"] for o in two] == ["gzip", "bzip2"]
