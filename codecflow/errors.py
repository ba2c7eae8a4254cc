"""Failures by class, as exceptions on the driver and as columns in permissive results."""

from __future__ import annotations


class CodecError(Exception):
    """A failure with the bit of the input it was found at, where one is known."""

    kind = "other"
    exit_code = 4

    def __init__(self, message: str, bit: int | None = None):
        super().__init__(message)
        self.bit = bit


class ConfigError(CodecError, ValueError):
    kind, exit_code = "config", 2


class UnsupportedFormat(ConfigError):
    kind = "unsupported_format"


class BadCompressedFile(CodecError):
    kind, exit_code = "bad_data", 3


class BadMagic(BadCompressedFile):
    kind = "bad_magic"


class Truncated(BadCompressedFile):
    kind = "truncated"


class BadChecksum(BadCompressedFile):
    kind = "bad_checksum"


class BadHeader(BadCompressedFile):
    kind = "bad_header"


class TrailingData(BadCompressedFile):
    kind = "trailing_data"


class OutputLimit(CodecError):
    kind, exit_code = "output_limit", 3


class BadIndex(ConfigError):
    kind = "bad_index"


class UnsafeArchive(BadCompressedFile):
    kind = "unsafe_archive"


#: Exit code of each class of failure; input and output failures are 1.
EXIT_CODES = {"io": 1, **{c.kind: c.exit_code for c in (ConfigError, UnsupportedFormat, BadIndex, BadCompressedFile, BadMagic, Truncated, BadChecksum, BadHeader, TrailingData, UnsafeArchive, OutputLimit, CodecError)}}


def error_class(e: BaseException) -> str:
    if isinstance(e, CodecError):
        return e.kind
    return "io" if isinstance(e, OSError) else "other"
