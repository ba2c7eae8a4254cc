"""Formats by content and by name, output names, sizes and durations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, UnsupportedFormat

SUFFIXES = {"bzip2": ["bz2", "bzip2", "tbz", "tbz2"], "gzip": ["gz", "gzip", "tgz"], "lz4": ["lz4"], "zip": ["zip"]}
#: Output suffix to encoder: those of tars come before plain ones.
OUTPUT_FORMATS = [("tar.bzip2", r"\.(tar\.(bz2|bzip2)|tbz2?)$"), ("tar.gzip", r"\.(tar\.(gz|gzip)|tgz)$"), ("tar.lz4", r"\.tar\.lz4$"), ("zip", r"\.zip$"), ("bzip2", r"\.(bz2|bzip2)$"), ("gzip", r"\.(gz|gzip)$"), ("lz4", r"\.lz4$")]
TAR_SUFFIXES = r"(?i)\.(tar\.(bz2|bzip2|gz|gzip|lz4)|tbz2?|tgz)$"
NEW_SUFFIX = {"bzip2": ".bz2", "gzip": ".gz", "lz4": ".lz4", "zip": ".zip", "tar.bzip2": ".tar.bz2", "tar.gzip": ".tar.gz", "tar.lz4": ".tar.lz4"}


def from_magic(content: Column) -> Column:
    """The format that the first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("425A68"), "bzip2")
        .when(head.startswith("1F8B"), "gzip")
        .when((head == "04224D18") | head.rlike("^5[0-9A-F]2A4D18$"), "lz4")
        .when(head.isin("504B0304", "504B0506", "504B0708"), "zip")
    )


def from_name(path: Column) -> Column:
    """The format that the last suffix tells, whatever its case, or null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in SUFFIXES.items():
        out = F.when(suffix.isin(suffixes), name).otherwise(out)
    return out


def detect(content: Column, path: Column | None = None, explicit: str | None = None, strict: bool = True) -> Column:
    """An explicit format, else what the content tells, else what the name tells; null or, if strict, an error."""
    if format_argument(explicit) is not None:
        return F.lit(explicit)
    found = F.coalesce(from_magic(content), from_name(path)) if path is not None else from_magic(content)
    return F.coalesce(found, F.raise_error(F.lit("unsupported_format")).cast("string")) if strict else found


def format_argument(name: str | None) -> str | None:
    """None and auto mean detection; bzip2, gzip and lz4 stand for themselves."""
    if name in (None, "auto"):
        return None
    if name not in ("bzip2", "gzip", "lz4"):
        raise UnsupportedFormat(f"unknown format: {name}")
    return name


def output_format(path: Column) -> Column:
    """The encoder that an output's suffix asks for, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(OUTPUT_FORMATS):
        out = F.when(path.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def chosen_format(explicit: str | None, inferred: str | None) -> str:
    """The encoder to use; a conflict or nothing at all is an error."""
    if explicit and inferred and explicit != inferred:
        raise ConfigError(f"the format {explicit} conflicts with the output's name, which asks for {inferred}")
    if not explicit and not inferred:
        raise ConfigError("neither a format nor a suffix tells the encoder")
    return explicit or inferred


def compressed_name(path: Column, format: str, directory: str | None = None) -> Column:
    name = F.concat(path if directory is None else F.regexp_extract(path, "([^/]+)$", 1), F.lit(NEW_SUFFIX[format]))
    return name if directory is None else F.concat(F.lit(directory.rstrip("/") + "/"), name)


def decoded_name(path: Column) -> Column:
    """The name without its suffix: a short tar suffix becomes .tar, an unknown one gets .out."""
    return (
        F.when(path.rlike(r"(?i)\.(tbz2?|tgz)$"), F.regexp_replace(path, r"(?i)\.(tbz2?|tgz)$", ".tar"))
        .when(path.rlike(r"(?i)\.(bz2|bzip2|gz|gzip|lz4)$"), F.regexp_replace(path, r"(?i)\.(bz2|bzip2|gz|gzip|lz4)$", ""))
        .otherwise(F.concat(path, F.lit(".out")))
    )


def is_tar_archive(path: Column) -> Column:
    return path.rlike(TAR_SUFFIXES)


def is_zip_archive(path: Column) -> Column:
    return path.rlike(r"(?i)\.zip$")


def is_archive(path: Column) -> Column:
    return is_tar_archive(path) | is_zip_archive(path)


def parse_size(text: Column) -> Column:
    """Bytes of digits with an optional unit b or k, m, g, t (also kb, kib, ...); null where it is none or too large."""
    pattern = r"^([0-9]+)(?:b|(?:([kmgt])(?:i?b)?))?$"
    low = F.lower(text)
    number, unit = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return F.when(low.rlike(pattern), F.try_multiply(number.try_cast("long"), F.pow(F.lit(1024), power).cast("long")))


def format_bytes(n: Column) -> Column:
    """B as it is, KiB to TiB with one decimal, halves rounded to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(" " + unit))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """Rounded to seconds, none below 0: 59s, 2m05s, 1h05m."""
    s = F.round(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.format_string("%dm%02ds", m, s - 60 * m)).otherwise(F.format_string("%dh%02dm", h, m - 60 * h))


def hex_lower(x: Column) -> Column:
    return F.lower(F.hex(x))
