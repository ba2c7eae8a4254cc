"""ZIP and tar archives as rows of entries: parsing, policy as DataFrame operations, decoding, creation."""

from __future__ import annotations

import io
import stat
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadChecksum, BadCompressedFile, BadHeader, OutputLimit, Truncated, UnsafeArchive, error_class
from . import codecs, gzipfmt

LOCAL, CENTRAL, EOCD, DESCRIPTOR, EOCD64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x08074B50, 0x06064B50, 0x07064B50
STORED, DEFLATED = 0, 8
#: From here on sizes and places take their 64-bit fields.
ZIP64_FROM = 0xFF000000
ZIP_FLAGS = 0x0808  # UTF-8 names, sizes in a descriptor
TARGET_LIMIT = 64 << 10
#: An entry from this size on is encoded in parallel segments, alone in its archive or among others.
LARGE_SOLE, LARGE_AMONG = 16 << 20, 64 << 20
_NTFS_EPOCH = 11_644_473_600

ENTRY = "number long, path string, kind string, method int, compressed_bytes long, decoded_bytes long, expected_crc long, data_start long, mode int, mtime long, encrypted boolean"
ENTRY_ARROW = pa.struct([("number", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("method", pa.int32()), ("compressed_bytes", pa.int64()), ("decoded_bytes", pa.int64()), ("expected_crc", pa.int64()), ("data_start", pa.int64()), ("mode", pa.int32()), ("mtime", pa.int64()), ("encrypted", pa.bool_())])


def _extra(data: bytes) -> dict[int, bytes]:
    out, p = {}, 0
    while p + 4 <= len(data):
        tag, n = struct.unpack_from("<HH", data, p)
        out[tag], p = data[p + 4 : p + 4 + n], p + 4 + n
    return out


def zip_entries(data: bytes) -> list[dict]:
    """Entries of a ZIP's central directory; nothing is checked here but that the directory is whole."""
    at = data.rfind(struct.pack("<I", EOCD))
    if at < 0 or len(data) < at + 22:
        raise Truncated("no end of the central directory")
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        where = data.rfind(struct.pack("<I", LOCATOR64), 0, at)
        if where < 0:
            raise BadHeader("the 64-bit directory is missing")
        far = struct.unpack_from("<Q", data, where + 8)[0]
        if far + 56 > len(data) or struct.unpack_from("<I", data, far)[0] != EOCD64:
            raise BadHeader("the 64-bit directory is missing")
        count, size, start = struct.unpack_from("<QQQ", data, far + 32)
    out, p = [], start
    for number in range(count):
        if p + 46 > len(data) or struct.unpack_from("<I", data, p)[0] != CENTRAL:
            raise BadHeader("an entry of the central directory is missing", 8 * p)
        made, flags, method, crc, packed, plain, n, m, k, attributes, local = (struct.unpack_from(f, data, p + o)[0] for f, o in (("<H", 4), ("<H", 8), ("<H", 10), ("<I", 16), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 38), ("<I", 42)))
        raw, extra = data[p + 46 : p + 46 + n], _extra(data[p + 46 + n : p + 46 + n + m])
        wide = io.BytesIO(extra.get(1, b""))
        plain, packed, local = (struct.unpack("<Q", wide.read(8).ljust(8, b"\0"))[0] if v == 0xFFFFFFFF else v for v in (plain, packed, local))
        if local + 30 > start or struct.unpack_from("<I", data, local)[0] != LOCAL:
            raise BadHeader("an entry's range lies outside the archive", 8 * p)
        a, b = struct.unpack_from("<HH", data, local + 26)
        if local + 30 + a + b + packed > start:
            raise BadHeader("an entry's range lies outside the archive", 8 * p)
        mode = attributes >> 16 if made >> 8 == 3 and attributes >> 16 else None
        path = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        kind = "symlink" if mode and stat.S_ISLNK(mode) else "directory" if path.endswith("/") else "file"
        mtime = None
        if len(extra.get(0x5455, b"")) >= 5 and extra[0x5455][0] & 1:
            mtime = struct.unpack_from("<i", extra[0x5455], 1)[0]
        elif len(extra.get(0x000A, b"")) >= 16:
            mtime = struct.unpack_from("<Q", extra[0x000A], 8)[0] // 10_000_000 - _NTFS_EPOCH
        out.append({"number": number, "path": path, "kind": kind, "method": method, "compressed_bytes": packed, "decoded_bytes": plain, "expected_crc": crc, "data_start": local + 30 + a + b, "mode": None if mode is None else mode & 0o7777, "mtime": mtime, "encrypted": bool(flags & 1)})
        p += 46 + n + m + k
    return out


def zip_entry_bytes(data: bytes, e: dict) -> bytes:
    """An entry's content, checked against its size and checksum, never decoded beyond its declared size."""
    if e["encrypted"]:
        raise BadHeader("encrypted entries are not supported")
    raw = data[e["data_start"] : e["data_start"] + e["compressed_bytes"]]
    if e["method"] == STORED:
        out = raw
    elif e["method"] == DEFLATED:
        d = zlib.decompressobj(-15)
        try:
            out = d.decompress(raw, e["decoded_bytes"] + 1)
        except zlib.error as err:
            raise BadCompressedFile(str(err)) from None
        if len(out) > e["decoded_bytes"]:
            raise BadCompressedFile("an entry is larger than declared")
        if not d.eof:
            d.decompress(d.unconsumed_tail, 1)
        if not d.eof or d.unused_data:
            raise BadCompressedFile("an entry's data do not end where they should")
    else:
        raise BadHeader(f"method {e['method']} is not supported")
    if len(out) != e["decoded_bytes"]:
        raise BadCompressedFile("an entry's size differs")
    if zlib.crc32(out) != e["expected_crc"]:
        raise BadChecksum("an entry's checksum differs")
    return out


def tar_entries(data: bytes) -> Iterator[dict]:
    """Entries of a tar, compressed in any stream format or not; the compressed stream is decoded and checked to its end.

    Names that lead out of the archive are passed over, as extraction does.
    """
    plain = data if codecs.format_of(data) is None else codecs.decompress_bytes(data)
    try:
        with tarfile.open(fileobj=io.BytesIO(plain), mode="r:") as t:
            for number, m in enumerate(t):
                if safe_path(m.name) is None:
                    continue
                kind = "directory" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isfile() else "other"
                content = t.extractfile(m).read() if m.isfile() else m.linkname.encode() if kind in ("symlink", "hardlink") else b""
                yield {"number": number, "path": m.name, "kind": kind, "mode": m.mode, "mtime": int(m.mtime), "content": content}
    except tarfile.TarError as e:
        raise BadCompressedFile(str(e)) from None


def safe_path(path: str) -> str | None:
    """path if it has normal components only (a directory's may end with a slash), else None."""
    parts = path.removesuffix("/").split("/")
    return None if not path or path.startswith("/") or "\0" in path or "\\" in path or any(p in ("", ".", "..") for p in parts) else path


# -- entries as DataFrames -------------------------------------------------------------------------------------------


def list_zip(objects: DataFrame, column: str = "content") -> DataFrame:
    """(archive, entry fields) of every archive in objects(path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [] if data is None else zip_entries(data)
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), *(pa.array([r[f.name] for r in rows], f.type) for f in ENTRY_ARROW)], ["archive", *(f.name for f in ENTRY_ARROW)])

    return objects.select(F.col("path").cast("string"), F.col(column).cast("binary")).mapInArrow(run, "archive string, " + ENTRY)


def read_zip(objects: DataFrame, column: str = "content", max_output: int | None = None) -> DataFrame:
    """(archive, number, path, kind, mode, mtime, content, error_class, message) of every entry; archives larger than
    `max_output` altogether fail before anything is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                entries = [] if data is None else zip_entries(data)
                if max_output is not None and sum(e["decoded_bytes"] for e in entries) > max_output:
                    raise OutputLimit(f"{archive}: the entries exceed {max_output} bytes")
                for e in entries:
                    content = failed = None
                    try:
                        content = zip_entry_bytes(data, e)
                    except Exception as err:
                        failed = err
                    row = (archive, e["number"], e["path"], e["kind"], e["mode"], e["mtime"], content, failed and error_class(failed), failed and str(failed))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string()))], [x.split()[0] for x in READ.split(", ")])

    return objects.select(F.col("path").cast("string"), F.col(column).cast("binary")).mapInArrow(run, READ)


READ = "archive string, number long, path string, kind string, mode int, mtime long, content binary, error_class string, message string"


def read_tar(objects: DataFrame, column: str = "content") -> DataFrame:
    """Entries with contents of every tar in objects(path, content); a bad archive fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string())
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e in tar_entries(data) if data is not None else ():
                    row = (archive, e["number"], e["path"], e["kind"], e["mode"], e["mtime"], e["content"], None, None)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in READ.split(", ")])

    return objects.select(F.col("path").cast("string"), F.col(column).cast("binary")).mapInArrow(run, READ)


# -- policy ------------------------------------------------------------------------------------------------------------


def is_safe(path: Column) -> Column:
    """Whether a name has normal components only."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("\0") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def symlink_stays(path: Column, target: Column) -> Column:
    """Whether a link at `path` leads to no place outside: the depth along its target never falls below the top."""
    depth = F.size(F.split(path, "/")) - 1
    steps = F.split(target, "/")
    walk = F.aggregate(steps, F.struct(depth.alias("d"), F.lit(True).alias("ok")), lambda a, s: F.struct(F.when(s == "..", a["d"] - 1).when(s.isin("", "."), a["d"]).otherwise(a["d"] + 1).alias("d"), (a["ok"] & (F.when(s == "..", a["d"] - 1).otherwise(a["d"]) >= 0)).alias("ok")))
    return ~target.startswith("/") & (F.octet_length(target) <= TARGET_LIMIT) & walk["ok"]


def duplicates(entries: DataFrame) -> DataFrame:
    """(archive, path, n) of names that an archive has more than once."""
    return entries.groupBy("archive", F.regexp_replace("path", "/$", "").alias("path")).agg(F.count("*").alias("n")).where("n > 1")


def bad_ancestors(entries: DataFrame) -> DataFrame:
    """(archive, path, ancestor) where a name lies under an entry that is no directory; an equi-join on the prefixes."""
    e = entries.select("archive", F.regexp_replace("path", "/$", "").alias("path"), "kind")
    parts = F.split("path", "/")
    above = e.select("archive", "path", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))).alias("ancestor"))
    files = e.where("kind <> 'directory'").select(F.col("archive").alias("a"), F.col("path").alias("p")).distinct()
    return above.join(files, (above["archive"] == files["a"]) & (above["ancestor"] == files["p"])).select("archive", "path", "ancestor")


def overlaps(entries: DataFrame) -> DataFrame:
    """(archive, number, next) of entries whose data reach into those of the one that follows."""
    w = Window.partitionBy("archive").orderBy("data_start", "number")
    e = entries.where("compressed_bytes > 0").withColumn("next", F.lead("number").over(w)).withColumn("next_start", F.lead("data_start").over(w))
    return e.where(F.col("next_start") < F.col("data_start") + F.col("compressed_bytes")).select("archive", "number", "next")


def violations(entries: DataFrame) -> DataFrame:
    """(archive, path, rule) of everything that makes an archive unsafe to extract."""
    rule = lambda df, name, path="path": df.select("archive", F.col(path).cast("string").alias("path"), F.lit(name).alias("rule"))
    out = rule(entries.where(~is_safe(F.col("path"))), "unsafe path")
    out = out.unionByName(rule(duplicates(entries), "duplicate")).unionByName(rule(bad_ancestors(entries), "file as directory"))
    if "encrypted" in entries.columns:
        out = out.unionByName(rule(entries.where("encrypted"), "encrypted")).unionByName(rule(entries.where(~F.col("method").isin(STORED, DEFLATED)), "method"))
        out = out.unionByName(rule(overlaps(entries), "overlap", "number"))
    return out


# -- creation ------------------------------------------------------------------------------------------------------------


def prepare_entries(entries: DataFrame, level: int = 6) -> DataFrame:
    """entries(archive, path, kind, mode, mtime, content) with method, packed bytes, crc and size: DEFLATE unless no smaller."""
    gzipfmt.check_level(level, 6)
    schema = entries.drop("content").withColumns({"method": F.lit(0), "decoded_bytes": F.lit(0).cast("long"), "expected_crc": F.lit(0).cast("long"), "packed": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for kind, content in zip(b.column("kind").to_pylist(), b.column("content").to_pylist()):
                content = content or b""
                packed = gzipfmt.encode_deflate(content, level) if kind == "file" else content
                method, packed = (DEFLATED, packed) if len(packed) < len(content) else (STORED, content)
                for x, v in zip(out, (method, len(content), zlib.crc32(content), packed)):
                    x.append(v)
            rest = [c for c in b.schema.names if c != "content"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary())))], [*rest, "method", "decoded_bytes", "expected_crc", "packed"])

    return entries.mapInArrow(run, schema)


def _utime(mtime: int | None) -> bytes:
    return b"" if mtime is None else struct.pack("<HHBi", 0x5455, 5, 1, mtime)


def write_zip(rows: list[dict]) -> bytes:
    """An archive of prepared entries, by name; sizes follow in descriptors, wide fields are taken where they are needed."""
    rows = sorted(rows, key=lambda r: r["path"])
    names = [r["path"].rstrip("/") for r in rows]
    if len(set(names)) < len(names):
        raise UnsafeArchive("a name comes twice")
    out, central = bytearray(), bytearray()
    for r in rows:
        if safe_path(r["path"]) is None:
            raise UnsafeArchive("a name has other than normal components: " + r["path"])
        name = (r["path"].rstrip("/") + "/" if r["kind"] == "directory" else r["path"]).encode()
        at, packed, size = len(out), r["packed"], r["decoded_bytes"]
        wide = max(at, len(packed), size) >= ZIP64_FROM
        version = 45 if wide else 20
        extra = _utime(r["mtime"])
        local_extra = extra + (struct.pack("<HHQQ", 1, 16, 0, 0) if wide else b"")
        size_field = 0xFFFFFFFF if wide else 0
        out += struct.pack("<IHHHHHIIIHH", LOCAL, version, ZIP_FLAGS, r["method"], 0, 33, 0, size_field, size_field, len(name), len(local_extra)) + name + local_extra + packed
        out += struct.pack("<IIQQ" if wide else "<IIII", DESCRIPTOR, r["expected_crc"], len(packed), size)
        central_extra = extra + (struct.pack("<HHQQQ", 1, 24, size, len(packed), at) if wide else b"")
        kind = {"directory": stat.S_IFDIR, "symlink": stat.S_IFLNK}.get(r["kind"], stat.S_IFREG)
        mode = r["mode"] if r["mode"] is not None else 0o755 if r["kind"] == "directory" else 0o644
        fields = [0xFFFFFFFF] * 3 if wide else [len(packed), size, at]
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 3 << 8 | version, version, ZIP_FLAGS, r["method"], 0, 33, r["expected_crc"], fields[0], fields[1], len(name), len(central_extra), 0, 0, 0, (kind | mode) << 16, fields[2]) + name + central_extra
    start, n = len(out), len(rows)
    out += central
    if n >= 0xFFFF or start >= ZIP64_FROM or len(central) >= ZIP64_FROM:
        far = len(out)
        out += struct.pack("<IQHHIIQQQQ", EOCD64, 44, 45, 45, 0, 0, n, n, len(central), start) + struct.pack("<IIQI", LOCATOR64, 0, far, 1)
    out += struct.pack("<IHHHHIIH", EOCD, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(central), 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0)
    return bytes(out)


def create_zip(entries: DataFrame, level: int = 6) -> DataFrame:
    """(archive, content): entries are encoded in parallel, each archive is put together in one task."""
    prepared = prepare_entries(entries.select("archive", "path", "kind", "mode", "mtime", "content"), level)

    def join(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        return pa.table({"archive": pa.array([rows[0]["archive"]], pa.string()), "content": pa.array([write_zip(rows)], pa.binary())})

    return prepared.groupBy("archive").applyInArrow(join, "archive string, content binary")


def create_tar(entries: DataFrame, format: str | None = None, level: int | None = None) -> DataFrame:
    """(archive, content): tar of entries in the order of their names, compressed in a stream format if one is given."""
    o = codecs.EncodeOptions(format, level) if format else None

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["path"])
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w", format=tarfile.GNU_FORMAT) as tar:
            seen = set()
            for r in rows:
                if safe_path(r["path"]) is None or r["path"].rstrip("/") in seen:
                    raise UnsafeArchive("a name comes twice or has other than normal components: " + r["path"])
                seen.add(r["path"].rstrip("/"))
                info, content = tarfile.TarInfo(r["path"]), r["content"] or b""
                info.mode = r["mode"] if r["mode"] is not None else 0o755 if r["kind"] == "directory" else 0o644
                info.mtime = r["mtime"] or 0
                info.type = {"directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}.get(r["kind"], tarfile.REGTYPE)
                if r["kind"] in ("symlink", "hardlink"):
                    info.linkname = content.decode()
                elif r["kind"] == "file":
                    info.size = len(content)
                tar.addfile(info, io.BytesIO(content) if r["kind"] == "file" else None)
        plain = buffer.getvalue()
        return pa.table({"archive": pa.array([rows[0]["archive"]], pa.string()), "content": pa.array([codecs.compress_bytes(plain, o) if o else plain], pa.binary())})

    return entries.select("archive", "path", "kind", "mode", "mtime", "content").groupBy("archive").applyInArrow(join, "archive string, content binary")


def archive_name(path: Column, base: str | None = None) -> Column:
    """The name of an input in an archive: relative to a base folder, else its last component."""
    if base is not None:
        prefix = base.rstrip("/") + "/"
        return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(F.regexp_extract(path, "([^/]+)/*$", 1))
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def is_large(size: Column) -> Column:
    """Whether an entry is worth segments of its own: larger alone in its archive (columns archive), or very large."""
    alone = F.count("*").over(Window.partitionBy("archive")) == 1
    return F.when(alone, size >= LARGE_SOLE).otherwise(size >= LARGE_AMONG)
