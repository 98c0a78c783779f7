"""Snapshot resolution: which value a key has as of a sequence number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import OP_DELETE, OP_PUT, require, tag, version_order

_VARIABLE = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)


def visible(log: DataFrame, snap: int | None = None) -> DataFrame:
    """Versions with ``seq <= snap``; stays below every aggregate, so it reaches the scan."""
    require(log, "k", "seq", "op", "v")
    return log if snap is None else log.where(F.col("seq") <= F.lit(snap))


def latest(log: DataFrame, snap: int | None = None) -> DataFrame:
    """Newest version of each key, tombstones included.

    Fixed-width payloads use a hash aggregate keyed by the packed tag; wide
    payloads use a rank, which Spark limits per partition before its shuffle.
    """
    rows = visible(log, snap)
    if not isinstance(rows.schema["v"].dataType, _VARIABLE):
        newest = rows.groupBy("k").agg(F.max(tag()).alias("_t"), F.max_by("v", tag()).alias("v"))
        return newest.select(
            "k",
            F.shiftright("_t", 8).alias("seq"),
            F.col("_t").bitwiseAND(F.lit(255)).cast("int").alias("op"),
            "v",
        )
    order = Window.partitionBy("k").orderBy(F.col("seq").desc(), F.col("op").desc())
    ranked = rows.select("k", "seq", "op", "v", F.row_number().over(order).alias("_r"))
    return ranked.where("_r = 1").drop("_r")


def live(log: DataFrame, snap: int | None = None) -> DataFrame:
    """Full state as of ``snap``: the newest version of each key if it is a put."""
    return latest(log, snap).where(F.col("op") == OP_PUT).select("k", "seq", "v")


def get(log: DataFrame, key: object, snap: int | None = None) -> DataFrame:
    """Zero or one row ``(k, seq, v)`` for one key; a top-1, so nothing is shuffled."""
    newest = visible(log.where(F.col("k") == F.lit(key)), snap).orderBy(tag().desc()).limit(1)
    return newest.where(F.col("op") == OP_PUT).select("k", "seq", "v")


def outcome(op: Column) -> Column:
    return F.when(op.isNull(), "ABSENT").when(op == OP_DELETE, "DELETED").otherwise("OK")


def get_outcome(log: DataFrame, keys: DataFrame, snap: int | None = None) -> DataFrame:
    """Three-way outcome OK / DELETED / ABSENT for each row of ``keys(k)``."""
    wanted = visible(log, snap).join(keys.select("k").distinct(), "k", "left_semi")
    found = keys.join(latest(wanted), "k", "left")
    value = F.when(F.col("op") == OP_PUT, F.col("v"))
    return found.select("k", outcome(F.col("op")).alias("outcome"), value.alias("v"))


def multi_get(log: DataFrame, probes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """As-of lookup of every probe ``(k, snap)``; linear in log plus probes.

    Time is cut into ranges of ``width`` sequence numbers. Within a range the
    answer is a running last; a probe before its range's first version takes
    the last version of an earlier range. A key with a long history is thus
    spread over many tasks, and no probe meets the key's whole history.
    """
    require(probes, "k", "snap")
    version = F.struct("seq", "op", "v")
    log = log.select("k", "seq", "op", "v").withColumn("_b", F.floor(F.col("seq") / width))
    asked = probes.select("k", "snap").distinct().withColumn("_b", F.floor(F.col("snap") / width))
    void = F.lit(None).cast(log.select(version.alias("x")).schema["x"].dataType)
    events = log.select("k", "_b", F.col("seq").alias("_at"), F.lit(0).alias("_p"), "op", version.alias("_v")).unionByName(
        asked.select("k", "_b", F.col("snap").alias("_at"), F.lit(1).alias("_p"), F.lit(9).alias("op"), void.alias("_v"))
    )
    run = Window.partitionBy("k", "_b").orderBy("_at", "_p", "op")
    here = events.withColumn("_v", F.last("_v", ignorenulls=True).over(run)).where("_p = 1")
    ends = log.groupBy("k", "_b").agg(F.max_by(version, tag()).alias("_v"))
    ranges = ends.unionByName(asked.select("k", "_b", void.alias("_v"))).groupBy("k", "_b").agg(F.max_by("_v", "_v").alias("_v"))
    before = Window.partitionBy("k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select("k", "_b", F.last("_v", ignorenulls=True).over(before).alias("_c"))
    got = here.join(carry, ["k", "_b"], "left").withColumn("_v", F.coalesce("_v", "_c"))
    op = F.col("_v.op")
    return got.select(
        "k",
        F.col("_at").alias("snap"),
        outcome(op).alias("outcome"),
        F.when(op == OP_PUT, F.col("_v.v")).alias("v"),
    )


def layers(*parts: DataFrame) -> DataFrame:
    """Memtables and tables as one log; sequence numbers decide precedence."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def exists(probes: DataFrame, log: DataFrame) -> DataFrame:
    return probes.join(log.select("k"), "k", "left_semi")


def absent(probes: DataFrame, log: DataFrame) -> DataFrame:
    return probes.join(log.select("k"), "k", "left_anti")


def history(log: DataFrame) -> DataFrame:
    """Every version with its rank in its key, the newest being 1, and its end of validity."""
    order = Window.partitionBy("k").orderBy(F.col("seq").desc(), F.col("op").desc())
    return log.select(
        "k", "seq", "op", "v",
        F.row_number().over(order).alias("version"),
        F.lag("seq").over(order).alias("replaced_at"),
    )


def ordered(log: DataFrame, reverse: bool = False) -> DataFrame:
    return log.orderBy(*version_order(reverse))
