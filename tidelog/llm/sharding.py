"""Sharding by a communication matrix: exact shard sizes and a uniform permutation.

Rows fall into blocks. A matrix says how many rows of each block go to each
shard; it is drawn from the multivariate hypergeometric law, so its margins
are the exact block and shard sizes and every assignment of rows is equally
likely. Rows are permuted inside blocks, dealt out by the matrix, exchanged,
and permuted again inside shards. The data path is DataFrame functions only;
the driver draws the matrix, whose size is blocks x shards whatever the input.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import keep

BLOCK_BITS = 10


def hypergeometric(rng: random.Random, draws: int, good: int, total: int) -> int:
    """Number of good ones among ``draws`` taken from ``total``: inversion outward from the mode."""
    low, high = max(0, draws - (total - good)), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = lambda n: math.lgamma(n + 1)
    choose = lambda n, k: lg(n) - lg(k) - lg(n - k)
    up = down = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    left, i, j = rng.random() - up, mode, mode
    while left > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (total - good - draws + i + 1))
            i += 1
            left -= up
            if left <= 0:
                return i
        if j > low:
            down *= j * (total - good - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            left -= down
            if left <= 0:
                return j
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of block b that go to shard s; shard sizes differ by one at most."""
    rng, n = random.Random(seed), sum(blocks)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = []
    for size in blocks:
        row, left, total = [], size, sum(free)
        for s in range(shards):
            got = hypergeometric(rng, left, free[s], total)
            total -= free[s]
            free[s] -= got
            left -= got
            row.append(got)
        matrix.append(row)
    return matrix


def assign(rows: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in its shard) added; columns of any other names stay as they are.

    ValueError is raised if the rows have a column of one of the two names.
    Only row numbers are permuted: rows are written down once, numbered, so
    that repeated rows, null ids and ties are dealt like any others, and are
    joined with their places by number. An empty table gives an empty one.
    """
    clash = {"shard", "slot"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"the rows have columns {sorted(clash)}")
    numbered = keep(rows.select(F.struct("*").alias("row")).withColumn("rid", F.monotonically_increasing_id()))
    return numbered.join(_places(numbered.select("rid"), shards, seed), "rid").select("row.*", "shard", "slot")


def _places(numbers: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rid, shard, slot`` of row numbers."""
    first, second = F.xxhash64("rid", F.lit(seed)), F.xxhash64("rid", F.lit(seed + 1))
    top = lambda h: F.shiftrightunsigned(h, 64 - BLOCK_BITS).cast("int")
    blocks = numbers.withColumn("key", first).withColumn("block", top(F.col("key")))
    sizes = dict(numbers.groupBy(top(first).alias("b")).count().collect())
    matrix = communication_matrix([sizes.get(b, 0) for b in range(1 << BLOCK_BITS)], shards, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    inside = Window.partitionBy("block").orderBy("key", "rid")
    ranked = blocks.withColumn("rank", F.row_number().over(inside))
    bounds = F.element_at(F.lit(ends), F.col("block") + 1)
    shard = F.size(F.filter(bounds, lambda e: e < F.col("rank")))
    dealt = keep(ranked.select("rid", shard.alias("shard")))
    # The second permutation: shards are cut into ranges of a new random key, each range is ranked by it.
    ranges = dealt.withColumn("key", second).withColumn("range", top(F.col("key")) + (1 << (BLOCK_BITS - 1)))
    counts = ranges.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range")
    base = counts.select("shard", "range", (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "range").orderBy("key", "rid")
    # At most shards x 1024 ranges, whatever the input.
    slots = ranges.withColumn("r", F.row_number().over(within)).join(F.broadcast(base), ["shard", "range"])
    return slots.select("rid", "shard", (F.col("base") + F.col("r") - 1).alias("slot"))


def digest(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Shard and slot of every document by row count: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Texts are read once and only their sizes and checksums travel. A null text
    has size 1 and the checksum of no bytes.
    """
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    small = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    done = assign(small, shards, seed)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 17, rows_per_file: int = 1_000_000) -> None:
    """Whole rows as files: a folder for each shard, in slot order within and across its files."""
    placed = assign(rows, shards, seed).withColumn("part", F.floor(F.col("slot") / rows_per_file))
    placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)
