"""Ordered access: bounds, neighbours and cursors, one at a time or in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidelog.schema import version_order

_BOUNDS = {
    "ge": (lambda k, t: k >= t, False),
    "gt": (lambda k, t: k > t, False),
    "le": (lambda k, t: k <= t, True),
    "lt": (lambda k, t: k < t, True),
}


def seek(log: DataFrame, target: object, how: str = "ge") -> DataFrame:
    """First version at or beyond a key (``ge`` ``gt``) or before it (``le`` ``lt``); at most one row."""
    test, reverse = _BOUNDS[how]
    return log.where(test(F.col("k"), F.lit(target))).orderBy(*version_order(reverse)).limit(1)


def first(log: DataFrame) -> DataFrame:
    return log.orderBy(*version_order()).limit(1)


def last(log: DataFrame) -> DataFrame:
    return log.orderBy(*version_order(True)).limit(1)


def after_internal(k: object, seq: int, op: int) -> Column:
    """Predicate of the rows at or after ``(k, seq, op)`` in version order."""
    key = F.col("k")
    tail = (F.col("seq") < seq) | ((F.col("seq") == seq) & (F.col("op") <= op))
    return (key > F.lit(k)) | ((key == F.lit(k)) & tail)


def seek_internal(log: DataFrame, k: object, seq: int, op: int) -> DataFrame:
    return log.where(after_internal(k, seq, op)).orderBy(*version_order()).limit(1)


def neighbours(log: DataFrame, targets: DataFrame, how: str = "ge", width: int | None = None) -> DataFrame:
    """Bulk seek: for each ``targets(t)`` the neighbouring key, null if none.

    Keys and targets are merged into one range-partitioned order: each range
    finds its own answers and takes what lies beyond it from a table of one
    row a range, so there is neither a range join nor a window over all rows in one task.
    """
    forward = how in ("ge", "gt")
    # Among equal values the target stands where its bound excludes or includes the key.
    side = {"ge": 0, "gt": 2, "le": 2, "lt": 0}[how]
    keys = log.select(F.col("k").alias("_x")).distinct().withColumn("_s", F.lit(1)).withColumn("_k", F.col("_x"))
    asked = targets.select(F.col("t").alias("_x")).distinct().withColumn("_s", F.lit(side)).withColumn("_k", F.lit(None).cast(keys.schema["_k"].dataType))
    placed = ranged(keys.unionByName(asked), keys, "_x", width)
    order = [F.col("_x").asc(), F.col("_s").asc()] if not forward else [F.col("_x").desc(), F.col("_s").desc()]
    run = Window.partitionBy("_b").orderBy(*order)
    near = placed.withColumn("_n", F.last("_k", ignorenulls=True).over(run)).where(F.col("_s") == side)
    edge = placed.groupBy("_b").agg((F.min("_k") if forward else F.max("_k")).alias("_e"))
    beyond = Window.orderBy(F.col("_b").desc() if forward else F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select("_b", F.last("_e", ignorenulls=True).over(beyond).alias("_c"))
    return near.join(F.broadcast(carry), "_b", "left").select(F.col("_x").alias("t"), F.coalesce("_n", "_c").alias("found"))


#: Keys of the sample that ranges are cut by, for each range.
SAMPLE = 64


def ranged(rows: DataFrame, keys: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_b``, a range number that never falls as ``column`` rises; equal values share a range.

    Ranges are cut at whole values of ``keys``: quantiles of those whose hashes
    are least, ``SAMPLE`` for each range. The sample only balances the ranges;
    it is the same in every run, and its size doesn't grow with the rows.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return rows.withColumn("_b", F.lit(0))
    sample = sorted(r[0] for r in keys.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(n * SAMPLE).collect())
    cuts = sorted({x if not isinstance(x, bytearray) else bytes(x) for x in (sample[len(sample) * i // n] for i in range(1, n))}) if sample else []
    kind = keys.schema[column].dataType
    limits = F.array(*[F.lit(x).cast(kind) for x in cuts]).cast(ArrayType(kind))
    return rows.withColumn("_b", F.coalesce(F.size(F.filter(limits, lambda c: c < F.col(column))), F.lit(0)))


def with_next(log: DataFrame) -> DataFrame:
    """Successor key of every distinct key, by a bulk ``gt`` seek of the keys themselves."""
    got = neighbours(log, log.select(F.col("k").alias("t")), "gt")
    return got.select(F.col("t").alias("k"), F.col("found").alias("next_k"))


def with_prev(log: DataFrame) -> DataFrame:
    got = neighbours(log, log.select(F.col("k").alias("t")), "lt")
    return got.select(F.col("t").alias("k"), F.col("found").alias("prev_k"))


def ordinal(log: DataFrame, reverse: bool = False) -> DataFrame:
    """Number the versions 1.. in version order, without a single-task window.

    Keys are counted first and cut into ranges: totals of ranges, then of keys
    in a range, give each key its base, and ranks are taken within keys. Null
    keys stand last, in a range of their own.
    """
    per_key = log.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    placed = ranged(per_key, per_key, "k").withColumn("_b", F.when(F.col("k").isNull(), 1 << 30).otherwise(F.col("_b")))
    key_order = F.col("k").desc_nulls_first() if reverse else F.col("k").asc_nulls_last()
    totals = placed.groupBy("_b").agg(F.sum("_n").alias("_t"))
    over = Window.orderBy(F.col("_b").desc() if reverse else F.col("_b").asc())
    first = totals.select("_b", (F.sum("_t").over(over) - F.col("_t")).alias("_f"))
    run = Window.partitionBy("_b").orderBy(key_order)
    base = placed.join(F.broadcast(first), "_b").select("k", (F.col("_f") + F.sum("_n").over(run) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("k").orderBy(*version_order(reverse)[1:])
    ranked = log.withColumn("_r", F.row_number().over(inside))
    joined = ranked.alias("l").join(base.alias("b"), F.col("l.k").eqNullSafe(F.col("b.k"))).drop(F.col("b.k"))
    return joined.withColumn("ordinal", F.col("_base") + F.col("_r")).drop("_base", "_r")


def scan_range(log: DataFrame, low: object | None, high: object | None) -> DataFrame:
    """Keys in ``[low, high)``; both bounds reach the scan."""
    if low is not None:
        log = log.where(F.col("k") >= F.lit(low))
    return log if high is None else log.where(F.col("k") < F.lit(high))


class Cursor:
    """A driver-side cursor over a log: every move is a top-1 query, so no data is held."""

    def __init__(self, log: DataFrame):
        self._log, self._row = log, None

    @property
    def valid(self) -> bool:
        return self._row is not None

    def _set(self, df: DataFrame) -> "Cursor":
        self._row = next(iter(df.collect()), None)
        return self

    def seek(self, key: object) -> "Cursor":
        return self._set(seek(self._log, key, "ge"))

    def seek_to_first(self) -> "Cursor":
        return self._set(first(self._log))

    def seek_to_last(self) -> "Cursor":
        return self._set(last(self._log))

    def next(self) -> "Cursor":
        r = self._here()
        more = self._log.where(after_internal(r.k, r.seq, r.op) & ~self._same(r))
        return self._set(more.orderBy(*version_order()).limit(1))

    def prev(self) -> "Cursor":
        r = self._here()
        return self._set(self._log.where(~after_internal(r.k, r.seq, r.op)).orderBy(*version_order(True)).limit(1))

    def key(self):
        return self._here().k

    def value(self):
        return self._here().v

    @staticmethod
    def _same(r) -> Column:
        return (F.col("k") == F.lit(r.k)) & (F.col("seq") == r.seq) & (F.col("op") == r.op)

    def _here(self):
        if self._row is None:
            raise ValueError("cursor is not on a row")
        return self._row
