"""Atomic batches: building, sequencing, validation, sizing, grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.codec import varint_len
from tidelog.schema import OP_DELETE, OP_PUT


class WriteBatch:
    """An ordered list of operations that becomes visible as one."""

    def __init__(self, ops: Iterable[tuple[int, bytes, bytes | None]] = ()):
        self.ops = list(ops)

    def put(self, key: bytes, value: bytes) -> "WriteBatch":
        self.ops.append((OP_PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> "WriteBatch":
        self.ops.append((OP_DELETE, bytes(key), None))
        return self

    def append(self, other: "WriteBatch") -> "WriteBatch":
        self.ops += other.ops
        return self

    def clear(self) -> None:
        self.ops = []

    def replay(self, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> None:
        """Hand each operation, in order, to the callback of its kind; a callback that raises ends it."""
        for op, k, v in self.ops:
            put(k, v) if op == OP_PUT else delete(k)

    def __len__(self) -> int:
        return len(self.ops)

    def byte_size(self) -> int:
        return 12 + sum(1 + _sized(k) + (_sized(v) if op == OP_PUT else 0) for op, k, v in self.ops)


def _sized(x: bytes) -> int:
    return len(x) + max(1, -(-len(x).bit_length() // 7))


def expand(batches: DataFrame) -> DataFrame:
    """``(base_seq, ops)`` to one log row an operation; operation i gets ``base_seq + i``."""
    rows = batches.select("base_seq", F.posexplode("ops").alias("_i", "_o"))
    value = F.when(F.col("_o.op") == OP_PUT, F.col("_o.v"))
    return rows.select(
        F.col("_o.k").alias("k"), (F.col("base_seq") + F.col("_i")).alias("seq"), F.col("_o.op").alias("op"), value.alias("v")
    )


def concat(batches: DataFrame, by: list[str], order: str) -> DataFrame:
    """Append batches in order: operation lists concatenate and the first base sequence stays."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("base_seq").alias("b"), F.col("ops").alias("x"))))
    one = batches.groupBy(*by).agg(listed.alias("_l"))
    return one.select(*by, F.col("_l")[0]["b"].alias("base_seq"), F.flatten(F.transform("_l", lambda r: r["x"])).alias("ops"))


def check(ops: str | Column, count: str | Column) -> Column:
    """Status of a decoded batch: every tag known and the count right."""
    ops, count = (F.col(c) if isinstance(c, str) else c for c in (ops, count))
    known = F.forall(ops, lambda o: o["op"].isin(OP_DELETE, OP_PUT))
    return F.when((F.size(ops) == count) & known, "OK").otherwise("Corruption")


def dedup_first(log: DataFrame, arrival: str) -> DataFrame:
    """One row for each identical (k, seq, op): the value that arrived first."""
    return log.groupBy("k", "seq", "op").agg(F.min_by(F.struct("v"), F.col(arrival)).alias("_v")).select("k", "seq", "op", F.col("_v.v").alias("v"))


def entry_bytes(key_len: Column, value_len: Column) -> Column:
    """Encoded size of one memtable entry."""
    inner = key_len + F.lit(8)
    return varint_len(inner) + inner + varint_len(value_len) + value_len


def rotation(log: DataFrame, size: str, buffer_bytes: int, block: int = 1 << 16) -> DataFrame:
    """Number of the write buffer each record falls into, by cumulative bytes in sequence order.

    Totals of sequence blocks come first, then those of 4,096 blocks each; only
    the latter, one row in some 270 million sequences, pass through one ordered
    window, and the rest runs inside groups of blocks and inside blocks.
    """
    rows = log.withColumn("_b", F.floor(F.col("seq") / block))
    totals = rows.groupBy("_b").agg(F.sum(size).alias("_t")).withColumn("_g", F.floor(F.col("_b") / 4096))
    groups = totals.groupBy("_g").agg(F.sum("_t").alias("_s"))
    over = groups.select("_g", (F.sum("_s").over(Window.orderBy("_g")) - F.col("_s")).alias("_over"))
    within = F.sum("_t").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_t")
    base = totals.select("_g", "_b", within.alias("_within")).join(over, "_g").select("_b", (F.col("_over") + F.col("_within")).alias("_base"))
    inside = Window.partitionBy("_b").orderBy("seq", "op")
    run = rows.join(base, "_b").withColumn("cum_bytes", F.col("_base") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("buffer", F.floor((F.col("cum_bytes") - 1) / buffer_bytes)).drop("_b", "_base")


def group_commit(writers: DataFrame, queue: str, order: str, size: str, sync: str, cap: int = 1 << 20, small: int = 128 << 10) -> DataFrame:
    """Greedy commit groups of each queue: ``(queue, order, group)``.

    A group takes writers in turn up to ``cap`` bytes, or ``small`` bytes more
    than its first if that is small; a sync writer never joins a group whose
    head isn't one. The cut depends on all before it, hence one pass a queue.
    """
    kind = {f.name: f.dataType.simpleString() for f in writers.schema}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        group, used, limit, head_sync, out = -1, 0, -1, False, []
        for n, s in zip(pdf[size], pdf[sync]):
            if group < 0 or used + n > limit or (s and not head_sync):
                group, used, head_sync = group + 1, 0, bool(s)
                limit = n + small if n <= small else cap
            used += n
            out.append(group)
        return pd.DataFrame({queue: pdf[queue], order: pdf[order], "commit_group": out})

    schema = f"{queue} {kind[queue]}, {order} {kind[order]}, commit_group bigint"
    return writers.groupBy(queue).applyInPandas(cut, schema)
