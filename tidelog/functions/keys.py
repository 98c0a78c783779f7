"""Key order on bytes: shared prefixes, separators, successors, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import MAX_SEQ, OP_PUT

FILE_PATTERN = r"^(?:(CURRENT)|(LOCK)|(LOG|LOG\.old)|MANIFEST-([0-9]+)|([0-9]+)\.(log|ldb|dbtmp))$"


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes two binary columns share."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def _byte(x: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substr(x, at, F.lit(1))), 16, 10).cast("int")


def _bumped(x: Column, keep: Column) -> Column:
    """The first ``keep`` bytes of x, the last of them increased by one."""
    return F.concat(F.substr(x, F.lit(1), keep - 1), F.unhex(F.lpad(F.hex((_byte(x, keep) + 1).cast("bigint")), 2, "0")))


def separator(start: Column, limit: Column) -> Column:
    """A short key in ``[start, limit)``; start itself where it can't be shortened."""
    at = shared_prefix(start, limit) + 1
    inside = at <= F.least(F.octet_length(start), F.octet_length(limit))
    return F.when(inside & (_byte(start, at) + 1 < _byte(limit, at)), _bumped(start, at)).otherwise(start)


def successor(key: Column) -> Column:
    """A short key at or after the given one; a run of 0xFF stays."""
    n = F.octet_length(key)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.get(F.filter(at, lambda i: F.substr(key, i, F.lit(1)) != F.lit(b"\xff")), F.lit(0))
    return F.when(first.isNotNull(), _bumped(key, first)).otherwise(key)


def _shortened(key: Column, short: Column, seq: Column, op: Column) -> Column:
    """A shorter user key stands before all its versions; else the version itself stays."""
    cut = (F.octet_length(short) < F.octet_length(key)) & (short > key)
    first = F.struct(short.alias("k"), F.lit(MAX_SEQ).cast("bigint").alias("seq"), F.lit(OP_PUT).alias("op"))
    return F.when(cut, first).otherwise(F.struct(key.alias("k"), seq.cast("bigint").alias("seq"), op.cast("int").alias("op")))


def internal_separator(start: Column, seq: Column, op: Column, limit: Column) -> Column:
    """A short version ``(k, seq, op)`` at or after ``(start, seq, op)`` and before all versions of ``limit``."""
    return _shortened(start, separator(start, limit), seq, op)


def internal_successor(key: Column, seq: Column, op: Column) -> Column:
    """A short version at or after the given one."""
    return _shortened(key, successor(key), seq, op)


def log_name(number: Column) -> Column:
    return F.format_string("%06d.log", number)


def table_name(number: Column) -> Column:
    return F.format_string("%06d.ldb", number)


def manifest_name(number: Column) -> Column:
    return F.format_string("MANIFEST-%06d", number)


def file_kind(name: Column) -> Column:
    """Kind of an owned file by its name: null if the name isn't one."""
    suffix = F.regexp_extract(name, FILE_PATTERN, 6)
    return (
        F.when(~name.rlike(FILE_PATTERN), F.lit(None).cast("string"))
        .when(name == "CURRENT", "current")
        .when(name == "LOCK", "lock")
        .when(name.startswith("LOG"), "info")
        .when(name.startswith("MANIFEST-"), "manifest")
        .when(suffix == "log", "log")
        .when(suffix == "ldb", "table")
        .otherwise("temp")
    )


def file_number(name: Column) -> Column:
    digits = F.concat(F.regexp_extract(name, FILE_PATTERN, 4), F.regexp_extract(name, FILE_PATTERN, 5))
    return F.when(name.rlike(FILE_PATTERN), F.when(digits == "", F.lit(0)).otherwise(F.try_to_number(digits, F.lit("9" * 18)).cast("bigint")))


def unsigned_key(n: Column) -> Column:
    """Order-preserving bytes of a signed 64-bit integer: big-endian, sign flipped."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
