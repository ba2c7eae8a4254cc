"""Files out of rows: written aside, checked for conflicts, and moved into place when the whole job has succeeded."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import ConfigError, UnsafeArchive
from ..operators import codecs
from ..operators.archives import safe_path

MODES = ("fail", "overwrite", "skip")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple]


class EncodedFiles(DataSource):
    """df(path, content[, kind, mode, mtime]).write.format("encoded_files").option("encode", "gzip").save(folder).

    Options: encode (none, bzip2, gzip, lz4), level, existing (fail, overwrite, skip). The folder is one that driver and
    executors share. Files appear only when all tasks have succeeded; a failed job leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "encoded_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.fieldNames(), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if "path" not in options:
            raise ConfigError("a folder is needed")
        self.folder = options["path"].removeprefix("file://")
        self.names = names
        kind = options.get("encode", "none")
        level = options.get("level")
        self.encode = None if kind == "none" else codecs.EncodeOptions(kind, int(level) if level else None)
        self.existing = options.get("existing", "overwrite" if overwrite else "fail")
        if self.existing not in MODES:
            raise ConfigError(f"existing is one of {', '.join(MODES)}")
        self.staging = os.path.join(self.folder, f".staging-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> _Written:
        files = []
        for row in rows:
            r = dict(zip(self.names, row))
            path, kind = r["path"], r.get("kind") or "file"
            if safe_path(path) is None:
                raise UnsafeArchive("a name leads out of the folder: " + path)
            content = bytes(r["content"] or b"")
            aside = os.path.join(self.staging, uuid.uuid4().hex)
            if kind == "file":
                os.makedirs(self.staging, exist_ok=True)
                with open(aside, "wb") as f:
                    f.write(codecs.compress_bytes(content, self.encode) if self.encode else content)
            elif kind == "symlink":
                target = content.decode()
                if target.startswith("/") or os.path.normpath(os.path.join(os.path.dirname(path), target)).split("/")[0] == "..":
                    raise UnsafeArchive("a link leads out of the folder: " + path)
                aside = target
            files.append((path.rstrip("/"), kind, aside, r.get("mode"), r.get("mtime")))
        return _Written(files)

    def commit(self, messages) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        names = [f[0] for f in files]
        try:
            if len(set(names)) < len(names):
                raise UnsafeArchive("a name comes twice")
            todo = []
            for f in files:
                at = os.path.join(self.folder, f[0])
                if os.path.lexists(at) and not (f[1] == "directory" and os.path.isdir(at)):
                    if self.existing == "skip":
                        continue
                    if self.existing == "fail" or os.path.isdir(at):
                        raise FileExistsError(at)
                todo.append((at, *f[1:]))
            for at, kind, aside, _, _ in todo:
                if kind == "directory":
                    os.makedirs(at, exist_ok=True)
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                if kind == "symlink":
                    if os.path.lexists(at):
                        os.unlink(at)
                    os.symlink(aside, at)
                else:
                    os.replace(aside, at)
            for at, kind, _, mode, mtime in sorted(todo, key=lambda x: (x[1] == "directory", -len(x[0]))):  # folders last, deepest first
                if kind != "symlink":
                    if mode is not None:
                        os.chmod(at, mode & 0o7777)
                    if mtime is not None:
                        os.utime(at, (mtime, mtime))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def write_files(df: DataFrame, folder: str, encode: str = "none", level: int | None = None, existing: str = "fail") -> None:
    """Writes rows as files by the data source above."""
    from .objects import register

    register(df.sparkSession)
    w = df.write.format("encoded_files").mode("append").option("encode", encode).option("existing", existing)
    (w.option("level", str(level)) if level else w).save(folder)


def existing_names(folder: str) -> list[str]:
    """Names, relative to the folder, of the files that it holds already."""
    top = folder.removeprefix("file://")
    return [os.path.relpath(os.path.join(d, f), top) for d, _, files in os.walk(top) for f in files]


def remove_sources(paths: list[str], done: bool) -> None:
    """Deletes inputs once their outputs are in place, and only then."""
    if done:
        for p in paths:
            os.unlink(p.removeprefix("file:"))
