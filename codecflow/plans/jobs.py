"""Whole jobs over files: decode, compress, validate, list, index, make and unpack archives.

Options are checked before anything runs; outputs appear when a job has succeeded; sources are removed only after that.
Progress can be watched through Spark's observed metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, UnsafeArchive
from ..functions import detect
from ..operators import archives, codecs
from ..sources import sinks
from ..sources.objects import not_existing, read_objects
from . import layout, ranges

MODES = ("decode", "compress", "validate", "list", "index")


def check_options(mode: str, *, output: str | None = None, force: bool = False, skip_existing: bool = False, remove: bool = False, max_output: int | None = None, level: int | None = None) -> None:
    """Refuses what does not go together."""
    if mode not in MODES:
        raise ConfigError(f"unknown mode: {mode}")
    if force and skip_existing:
        raise ConfigError("existing outputs are either overwritten or skipped")
    if mode in ("validate", "list", "index") and (remove or force or skip_existing):
        raise ConfigError(f"{mode} replaces and removes nothing")
    if mode in ("decode", "compress") and not output:
        raise ConfigError("an output folder is needed")
    if level is not None and mode != "compress":
        raise ConfigError("a level is for compressing")
    if max_output is not None and (mode == "compress" or max_output < 0):
        raise ConfigError("an output limit is for decoding and not negative")


def existing_mode(force: bool, skip_existing: bool) -> str:
    return "overwrite" if force else "skip" if skip_existing else "fail"


def progress(df: DataFrame, column: str) -> tuple[DataFrame, Observation]:
    """df and an observation of objects and bytes that have passed, filled when an action has run."""
    seen = Observation("progress")
    return df.observe(seen, F.count("*").alias("objects"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")), seen


def _inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_objects(spark, paths).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


def decode_files(spark: SparkSession, paths: list[str], output: str, *, format: str | None = None, force: bool = False, skip_existing: bool = False, remove: bool = False, max_output: int | None = None) -> dict:
    """Decodes files into a folder under their names without suffix, with their modification times; returns what passed."""
    check_options("decode", output=output, force=force, skip_existing=skip_existing, remove=remove, max_output=max_output)
    named = _inputs(spark, paths).withColumn("target", detect.decoded_name(F.col("name")))
    plain = codecs.decompress(named.select("target", "modificationTime", "content"), format=format, max_output=max_output)
    rows, seen = progress(plain.select(F.col("target").alias("path"), F.col("plain").alias("content"), F.unix_timestamp("modificationTime").alias("mtime")), "content")
    sinks.write_files(rows, output, existing=existing_mode(force, skip_existing))
    sinks.remove_sources([r["path"] for r in named.select("path").toLocalIterator()] if remove else [], remove)
    return seen.get


def compress_files(spark: SparkSession, paths: list[str], output: str, format: str, *, level: int | None = None, force: bool = False, skip_existing: bool = False, remove: bool = False) -> dict:
    """Compresses files into a folder; outputs that exist are left out before anything is encoded when they are skipped."""
    check_options("compress", output=output, force=force, skip_existing=skip_existing, remove=remove, level=level)
    codecs.EncodeOptions(format, level)
    named = _inputs(spark, paths).withColumn("target", detect.compressed_name(F.col("name"), format))
    if skip_existing:
        here = spark.createDataFrame([(x,) for x in sinks.existing_names(output)], "path string")
        named = not_existing(named, here, F.col("target"))
    coded = codecs.compress(named.select("target", "modificationTime", "content"), format, "content", "coded", level)
    rows, seen = progress(coded.select(F.col("target").alias("path"), F.col("coded").alias("content"), F.unix_timestamp("modificationTime").alias("mtime")), "content")
    sinks.write_files(rows, output, existing=existing_mode(force, skip_existing))
    sinks.remove_sources([r["path"] for r in named.select("path").toLocalIterator()] if remove else [], remove)
    return seen.get


def validate_files(spark: SparkSession, paths: list[str], format: str | None = None) -> DataFrame:
    """path, ok, error_class, message, bit_offset, decoded_bytes of every file; archives are checked entry by entry."""
    o = read_objects(spark, paths).select("path", "content")
    streams = codecs.validate(o.where(~F.coalesce(detect.from_magic(F.col("content")) == "zip", F.lit(False))), format=format).select("path", "check.*")
    entries = archives.read_zip(o.where(detect.from_magic(F.col("content")) == "zip"))
    checked = entries.groupBy(F.col("archive").alias("path")).agg((F.count_if(F.col("error_class").isNotNull()) == 0).alias("ok"), F.max("error_class").alias("error_class"), F.max("message").alias("message"), F.lit(None).cast("long").alias("bit_offset"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("decoded_bytes"))
    return streams.unionByName(checked)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return layout.as_json(read_objects(spark, paths).select("path", "content"))


def index_files(spark: SparkSession, paths: list[str], output: str, mode: str = "errorifexists") -> None:
    ranges.save_index(ranges.build_index(read_objects(spark, paths).select("path", "content")), output, mode)


def make_archive(spark: SparkSession, folder: str, archive: str, output: str, *, format: str | None = None, level: int | None = None, force: bool = False) -> None:
    """One archive of all files below a folder; its suffix or an explicit format tells the kind."""
    inferred = spark.range(1).select(detect.output_format(F.lit(archive))).first()[0]
    kind = detect.chosen_format(format, inferred)
    if kind != "zip" and not kind.startswith("tar."):
        raise ConfigError("an archive is a zip or a tar")
    files = read_objects(spark, folder, recursive=True)
    plain_path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    entries = files.select(F.lit(archive).alias("archive"), archives.archive_name(plain_path, folder).alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("int").alias("mode"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    made = archives.create_zip(entries, level or 6) if kind == "zip" else archives.create_tar(entries, kind.removeprefix("tar."), level)
    sinks.write_files(made.select(F.col("archive").alias("path"), "content"), output, existing=existing_mode(force, False))


def unpack(spark: SparkSession, paths: list[str], output: str, *, force: bool = False, max_output: int | None = None) -> None:
    """Unpacks archives into a folder: nothing is written if any of them breaks a rule, entries that are bad fail the job."""
    o = read_objects(spark, paths).select("path", "content")
    is_zip = F.coalesce(detect.from_magic(F.col("content")) == "zip", F.lit(False))
    bad = archives.violations(archives.list_zip(o.where(is_zip))).take(1)
    if bad:
        raise UnsafeArchive(f"{bad[0]['archive']}: {bad[0]['path']}: {bad[0]['rule']}")
    rows = archives.read_zip(o.where(is_zip), max_output=max_output).unionByName(archives.read_tar(o.where(~is_zip)))
    content = F.when(F.col("error_class").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "message")).cast("binary")).otherwise(F.col("content"))
    sinks.write_files(rows.withColumn("content", content).select("path", "kind", "mode", "mtime", "content"), output, existing=existing_mode(force, False))
