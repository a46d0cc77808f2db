"""Errors by name and number."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    """The numbers that callers know the errors by."""

    NO_ERROR = 0
    PANIC = 1
    INTERNAL = 2
    MSG = 3
    UNKNOWN = 4
    MISMATCH_KSIZES = 101
    MISMATCH_DNA_PROT = 102
    MISMATCH_MAX_HASH = 103
    MISMATCH_SEED = 104
    INVALID_DNA = 1101
    INVALID_PROT = 1102
    IO = 100001
    UTF8_ERROR = 100002
    PARSE_INT = 100003
    SERDE_ERROR = 100004


class SketchError(Exception):
    code = ErrorCode.INTERNAL


class MismatchKSizes(SketchError):
    code = ErrorCode.MISMATCH_KSIZES


class MismatchDNAProt(SketchError):
    code = ErrorCode.MISMATCH_DNA_PROT


class MismatchMaxHash(SketchError):
    code = ErrorCode.MISMATCH_MAX_HASH


class MismatchSeed(SketchError):
    code = ErrorCode.MISMATCH_SEED


class InvalidDNA(SketchError):
    code = ErrorCode.INVALID_DNA


class InvalidProt(SketchError):
    code = ErrorCode.INVALID_PROT


#: The name that begins the message of an error raised inside a query.
BY_NAME = {x.__name__: x for x in (MismatchKSizes, MismatchDNAProt, MismatchMaxHash, MismatchSeed, InvalidDNA, InvalidProt)}


def typed(error: BaseException) -> SketchError:
    """The error of this module that a failed Spark action stands for; Internal if none is named."""
    text = str(error)
    found = [(text.find(f"{name}:"), kind) for name, kind in BY_NAME.items() if f"{name}:" in text]
    return min(found, key=lambda x: x[0])[1](text) if found else SketchError(text)


def error_code(error: BaseException | None) -> ErrorCode:
    """The number of an error; input, text and number errors of Python have theirs, others are unknown."""
    if error is None:
        return ErrorCode.NO_ERROR
    if isinstance(error, SketchError):
        return error.code
    for kind, code in ((UnicodeError, ErrorCode.UTF8_ERROR), (ValueError, ErrorCode.PARSE_INT), (OSError, ErrorCode.IO)):
        if isinstance(error, kind):
            return code
    return ErrorCode.UNKNOWN
