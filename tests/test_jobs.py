"""Jobs over files: names, existing outputs, removal, archives, and the encoder that takes pieces."""

import bz2
import gzip
import io
import json
import os

import pytest
from conftest import patterned

from codecflow import api, errors
from codecflow.operators import codecs
from codecflow.plans import jobs


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return sorted(str(folder / name.replace("__", ".")) for name in files)


def test_encoder_in_pieces():
    plain = patterned(300_000)
    for format in codecs.FORMATS:
        to = io.BytesIO()
        e = codecs.Encoder(to, codecs.EncodeOptions(format, memory_limit=1 << 18))
        for i in range(0, len(plain), 7777):
            e.write(plain[i : i + 7777])
        report = e.finish()
        assert api.decompress(to.getvalue(), format) == plain and (report.plain_bytes, report.coded_bytes) == (len(plain), len(to.getvalue()))
        with pytest.raises(ValueError):
            e.write(b"more")
    with pytest.raises(errors.ConfigError):
        codecs.Encoder(io.BytesIO(), codecs.EncodeOptions("lz4", memory_limit=1000))


def test_decode_and_compress(spark, tmp_path):
    paths = put(tmp_path / "in", a__gz=gzip.compress(b"first"), b__tbz2=bz2.compress(b"second"), c__dat=api.compress(b"third", "lz4"))
    out = str(tmp_path / "out")
    os.utime(paths[0], (1_600_000_000, 1_600_000_000))
    assert jobs.decode_files(spark, paths, out) == {"objects": 3, "bytes": 16}
    assert {x: open(f"{out}/{x}", "rb").read() for x in os.listdir(out)} == {"a": b"first", "b.tar": b"second", "c.dat.out": b"third"}
    assert os.stat(f"{out}/a").st_mtime == 1_600_000_000
    with pytest.raises(Exception, match="out/a"):
        jobs.decode_files(spark, paths, out)
    assert all(os.path.exists(p) for p in paths)
    plain = [f"{out}/{x}" for x in sorted(os.listdir(out))]
    packed = str(tmp_path / "packed")
    assert jobs.compress_files(spark, plain[:1], packed, "gzip", level=9)["objects"] == 1
    assert jobs.compress_files(spark, plain, packed, "gzip", skip_existing=True)["objects"] == 2
    assert jobs.compress_files(spark, plain, packed, "gzip", force=True, remove=True)["objects"] == 3
    assert not any(os.path.exists(p) for p in plain) and gzip.open(f"{packed}/a.gz").read() == b"first"
    found = {os.path.basename(r["path"]): json.loads(r["json"])["decoded_bytes"] for r in jobs.list_files(spark, [f"{packed}/a.gz", f"{packed}/b.tar.gz"]).collect()}
    assert found == {"a.gz": 5, "b.tar.gz": 6}
    with pytest.raises(Exception, match="exceeds"):
        jobs.decode_files(spark, [f"{packed}/a.gz"], str(tmp_path / "no"), max_output=4)
    assert not os.path.exists(tmp_path / "no" / "a")


def test_index_and_validate(spark, tmp_path):
    paths = put(tmp_path / "in", a__bz2=bz2.compress(patterned(200_000), 1), b__gz=gzip.compress(b"x")[:-1], c__gz=b"")
    jobs.index_files(spark, paths[:1], str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() > 1
    assert {os.path.basename(r["path"]): (r["ok"], r["error_class"]) for r in jobs.validate_files(spark, paths).collect()} == {"a.bz2": (True, None), "b.gz": (False, "truncated"), "c.gz": (False, "unsupported_format")}


@pytest.mark.parametrize("name", ["x.zip", "x.tar.gz", "x.tar.lz4"])
def test_archives(spark, tmp_path, name):
    put(tmp_path / "in", one=b"1" * 1000, two=b"")
    put(tmp_path / "in" / "deep", three=b"3")
    jobs.make_archive(spark, str(tmp_path / "in"), name, str(tmp_path / "made"))
    jobs.unpack(spark, [str(tmp_path / "made" / name)], str(tmp_path / "out"))
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs) == ["deep/three", "one", "two"]
    assert (tmp_path / "out" / "one").read_bytes() == b"1" * 1000
    assert jobs.validate_files(spark, [str(tmp_path / "made" / name)]).select("ok").first()[0]
    with pytest.raises(Exception, match="out"):
        jobs.unpack(spark, [str(tmp_path / "made" / name)], str(tmp_path / "out"))


def test_options_that_do_not_go_together():
    for wrong in (dict(mode="x"), dict(mode="decode"), dict(mode="decode", output="o", force=True, skip_existing=True), dict(mode="list", remove=True), dict(mode="decode", output="o", level=3), dict(mode="compress", output="o", max_output=5)):
        with pytest.raises(errors.ConfigError):
            jobs.check_options(**wrong)
    jobs.check_options("compress", output="o", level=3)
