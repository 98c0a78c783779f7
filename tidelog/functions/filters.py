"""Approximate membership: Bloom filters over user keys, and blocks of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidelog.functions.codec import byte_values
from tidelog.schema import FILTER_RANGE, U32

# Fixed values of the hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1(x: Column) -> Column:
    """32-bit FNV-1 of a binary column, on the JVM."""
    return F.aggregate(byte_values(x), F.lit(FNV_OFFSET).cast("bigint"), lambda h, b: (h * FNV_PRIME).bitwiseAND(F.lit(U32)).bitwiseXOR(b))


def fnv1_bytes(x: bytes) -> int:
    h = FNV_OFFSET
    for b in x:
        h = (h * FNV_PRIME & U32) ^ b
    return h


def probes(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def _spots(h: int, k: int, bits: int) -> list[int]:
    step = (h >> 17 | h << 15) & U32
    return [((h + i * step) & U32) % bits for i in range(k)]


def build(hashes: list[int], bits_per_key: int = 10) -> bytes:
    """Filter bytes of the keys' hashes; the last byte is the number of probes."""
    k, size = probes(bits_per_key), (max(64, len(hashes) * bits_per_key) + 7) // 8
    bits = bytearray(size)
    for h in hashes:
        for p in _spots(h, k, size * 8):
            bits[p >> 3] |= 1 << (p & 7)
    return bytes(bits) + bytes([k])


def matches(key: bytes, filt: bytes) -> bool:
    if len(filt) < 2:
        return False
    k, bits = filt[-1], 8 * (len(filt) - 1)
    return k > 30 or all(filt[p >> 3] >> (p & 7) & 1 for p in _spots(fnv1_bytes(key), k, bits))


def fnv1_rows(data: pa.Array) -> pa.Array:
    """FNV-1 of each value of a batch, null being empty: all step side by side, byte by byte, longest first."""
    data = data.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1] or bytes(8), np.int64)[data.offset : data.offset + len(data) + 1]
    body = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    size = np.where(data.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
    rank = np.argsort(-size, kind="stable")
    at, left, state, out = ends[rank], -size[rank], np.full(len(data), FNV_OFFSET, np.uint32), np.zeros(len(data), np.int64)
    for i in range(-left[0] if len(data) else 0):
        n = np.searchsorted(left, -i)
        state[:n] = state[:n] * np.uint32(FNV_PRIME) ^ body[at[:n] + i]
    out[rank] = state
    return pa.array(out)


def fnv1_batched(x: Column) -> Column:
    """As ``fnv1``, in Arrow batches: what many keys are hashed by."""

    def rows(data: pa.Array) -> pa.Array:
        return fnv1_rows(data)

    return F.arrow_udf(rows, LongType())(x)


def _starts(groups: pa.Array) -> np.ndarray:
    """Whether each of some sorted values differs from the one before it; the first does."""
    if len(groups) < 2:
        return np.ones(len(groups), bool)
    a, b = groups.slice(1), groups.slice(0, len(groups) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], differ & ~both])


def _array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def build_many(hashes: np.ndarray, counts: np.ndarray, bits_per_key: int = 10) -> list[bytes]:
    """As ``build``, for many groups at once: ``counts`` says how many of the hashes in turn are each group's."""
    k, size = probes(bits_per_key), (np.maximum(64, counts * bits_per_key) + 7) // 8
    ends = np.cumsum(size)
    base, width = np.repeat((ends - size) * 8, counts), np.repeat(size * 8, counts)
    bits = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    step = (hashes >> 17 | hashes << 15) & U32
    for i in range(k):
        bits[base + ((hashes + i * step) & U32) % width] = 1
    body = np.packbits(bits, bitorder="little").tobytes()
    return [body[e - n : e] + bytes([k]) for e, n in zip(ends.tolist(), size.tolist())]


def build_filters(keys: DataFrame, by: str, bits_per_key: int = 10) -> DataFrame:
    """One filter a group: ``(by, filter, n_keys)``; a null key counts as the empty one.

    Keys are hashed in batches and sent on as integers. A task goes through its
    groups in order, all that end in a batch at once, and holds one open group
    and its bits at most: some 60 bytes a key.
    """
    kind = keys.schema[by].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, names = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.field(0).type
            open_.append(batch)
            first = np.flatnonzero(_starts(_array(batch.column(0))))
            if first[-1] == 0 and (len(open_) == 1 or not _starts(pa.concat_arrays([open_[-2].column(0).slice(open_[-2].num_rows - 1), batch.column(0).slice(0, 1)]))[1]):
                continue  # one group so far
            open_[-1] = batch.slice(0, int(first[-1]))
            yield from done(open_, names)
            open_ = [batch.slice(int(first[-1]))]
        yield from done(open_, names)

    def done(parts: list[pa.RecordBatch], names: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in parts):
            return
        groups, hashes = (pa.concat_arrays([b.column(i) for b in parts]) for i in (0, 1))
        first = np.flatnonzero(_starts(groups))
        counts = np.diff(np.append(first, len(groups)))
        built = build_many(hashes.to_numpy(zero_copy_only=False), counts, bits_per_key)
        yield pa.RecordBatch.from_arrays([groups.take(pa.array(first)).cast(names), pa.array(built, pa.binary()), pa.array(counts, pa.int64())], [by, "filter", "n_keys"])

    hashed = keys.select(by, fnv1_batched(F.col("k")).alias("_h")).distinct()
    return hashed.repartition(F.col(by)).sortWithinPartitions(by).mapInArrow(made, f"{by} {kind}, filter binary, n_keys bigint")


def match_many(hashes: np.ndarray, filters: pa.Array, at: np.ndarray) -> np.ndarray:
    """As ``matches``, of hashes against the filter at each one's place in ``filters``; none at place -1."""
    filters = filters.cast(pa.large_binary())
    ends = np.frombuffer(filters.buffers()[1], np.int64)[filters.offset : filters.offset + len(filters) + 1]
    body = np.frombuffer(filters.buffers()[2] or b"\0", np.uint8)
    start, n = ends[at], np.where(at < 0, 0, ends[at + 1] - ends[at])
    k = np.where(n < 2, 0, body[np.where(n < 2, 0, start + n - 1)])
    out, width = n >= 2, np.maximum(1, 8 * (n - 1))
    step = (hashes >> 17 | hashes << 15) & U32
    for i in range(min(30, int(k.max(initial=0)))):
        asked = np.flatnonzero(out & (i < k) & (k <= 30))
        p = ((hashes[asked] + i * step[asked]) & U32) % width[asked]
        out[asked] = body[start[asked] + (p >> 3)] >> (p & 7) & 1
    return out


def probe_filters(asked: DataFrame, filters: DataFrame, by: str, key: Column, spread: int = 1) -> DataFrame:
    """``asked`` with ``may_match``: whether its ``key`` may be in its group's filter; false without one. A null key counts as the empty one.

    A filter isn't joined to each of its probes: it goes ahead of them, once to
    each of ``spread`` tasks that a group's probes are dealt to, so a task holds
    one filter and one batch of probes. Large filters want a spread.
    """
    names = asked.columns
    probe = asked.withColumn("_h", fnv1_batched(key)).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(spread)).cast("int"))
    ahead = filters.select(F.col(by), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_s"), F.col("filter").alias("_f"))
    both = probe.withColumn("_p", F.lit(1)).unionByName(ahead.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema), "may_match boolean"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            column = {n: _array(rows.column(n)) for n in rows.column_names}
            asked_ = column["_p"].to_numpy(zero_copy_only=False) == 1
            place = np.cumsum(~asked_) - 1
            ahead_ = np.flatnonzero(~asked_)
            if len(ahead_):
                last = batch_of(rows.slice(int(ahead_[-1]), 1))
                near = pa.array(np.where(place < 0, 0, ahead_[np.maximum(place, 0)]))
                same = pc.fill_null(pc.equal(column[by], column[by].take(near)), False).to_numpy(zero_copy_only=False)
                same &= column["_s"].to_numpy(zero_copy_only=False) == column["_s"].take(near).to_numpy(zero_copy_only=False)
                place = np.where(same, place, -1)
            at = np.flatnonzero(asked_)
            if not len(at):
                continue
            hashes = column["_h"].take(pa.array(at)).to_numpy(zero_copy_only=False)
            known = column["_f"].take(pa.array(ahead_)) if len(ahead_) else pa.array([b""], pa.binary())
            hit = match_many(hashes, known, place[at])
            yield pa.RecordBatch.from_arrays([*(column[n].take(pa.array(at)) for n in names), pa.array(hit)], [*names, "may_match"])

    def batch_of(rows: pa.Table) -> pa.RecordBatch:
        return rows.combine_chunks().to_batches()[0]

    placed = both.repartition(F.col(by), F.col("_s")).sortWithinPartitions(by, "_s", "_p")
    return placed.mapInArrow(match, kind)


def filter_block(chunks: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """``(block_offset, k)`` to one filter for each slot of 2 KiB of file offset that has keys."""
    slotted = chunks.select(F.floor(F.col("block_offset") / FILTER_RANGE).cast("bigint").alias("slot"), "k")
    return build_filters(slotted, "slot", bits_per_key)


def probe_block(probes_df: DataFrame, block: DataFrame) -> DataFrame:
    """``(block_offset, k)`` probes: a slot without keys within the block matches nothing, one beyond it anything."""
    last = block.agg(F.max("slot").alias("_last"))
    at = probes_df.withColumn("slot", F.floor(F.col("block_offset") / FILTER_RANGE).cast("bigint"))
    found = probe_filters(at, block, "slot", F.col("k")).crossJoin(F.broadcast(last))
    hit = F.when(F.col("slot") > F.col("_last"), True).otherwise(F.col("may_match"))
    return found.withColumn("may_match", hit).drop("_last")


def encode_block(filters: dict[int, bytes]) -> bytes:
    """Bytes of a filter block: filters, offsets, start of offsets, base of the range."""
    out, offsets = bytearray(), []
    for slot in range(max(filters, default=-1) + 1):
        offsets.append(len(out))
        out += filters.get(slot, b"")
    start = len(out)
    for o in [*offsets, start]:
        out += struct.pack("<I", o)
    return bytes(out) + bytes([FILTER_RANGE.bit_length() - 1])
