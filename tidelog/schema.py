"""Record shapes and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the storage format.
OP_DELETE = 0
OP_PUT = 1
MAX_SEQ = (1 << 56) - 1
NUM_LEVELS = 7
WAL_BLOCK = 32768
WAL_HEADER = 7
RESTART_INTERVAL = 16
FILTER_RANGE = 2048
MASK_DELTA = 0xA282EAD8
U32 = 0xFFFFFFFF

LOG = "k binary, seq bigint, op int, v binary"
PROBE = "k binary, snap bigint"
_KEY = "struct<k: binary, seq: bigint, op: int>"
FILE = f"struct<level: int, number: bigint, file_size: bigint, smallest: {_KEY}, largest: {_KEY}>"
EDITS = (
    "edit_id bigint, comparator string, log_number bigint, next_file bigint, last_seq bigint, "
    f"deleted array<struct<level: int, number: bigint>>, added array<{FILE}>"
)


#: Key orders that the engine has; a database that was written in another one isn't opened.
COMPARATORS = ("bytewise",)


@dataclass(frozen=True)
class Options:
    """Engine options; immutable, so one object can open many databases."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_bytes: int = 4 << 20
    bits_per_key: int = 10
    compression: str = "snappy"
    files_per_flush: int = 1
    comparator: str = "bytewise"


class StoreError(Exception):
    """A failed engine call; ``code`` is one of the status names."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def tag(seq: str | Column = "seq", op: str | Column = "op") -> Column:
    """The packed version tag ``seq << 8 | op``; its order is (seq, op)."""
    seq, op = (F.col(c) if isinstance(c, str) else c for c in (seq, op))
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def version_order(reverse: bool = False) -> list[Column]:
    """Total order of versions: key ascending, newest first (or its reverse)."""
    if reverse:
        return [F.col("k").desc_nulls_first(), F.col("seq").asc(), F.col("op").asc()]
    return [F.col("k").asc_nulls_last(), F.col("seq").desc(), F.col("op").desc()]


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise StoreError("InvalidArgument", f"missing columns {missing} in {df.columns}")
    return df
