"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import keep


#: Parts into which the neighbours of a node are dealt, so that a node with a large share of all links isn't one task's.
SALTS = 8


def to_least(rows: DataFrame, least: DataFrame, how: str = "inner") -> DataFrame:
    """``rows(u, v)`` with the ``m`` of their ``u`` in ``least(u, m)``; neighbours of one node are dealt over several tasks."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    return salted.join(least.withColumn("s", every), ["u", "s"], how)


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours to the least of a node's neighbourhood: the larger ones, or the smaller ones and the node."""
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = to_least(both.where("v > u"), least).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = to_least(down, least).select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return linked.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links(a, b)``, the component being its least node.

    Each round halves distances at least; it ends when all links are stars.
    Rounds are written to the shared folder; only whether one is the last
    reaches the driver. Self-links and repeated links are allowed; no links give no rows.
    """
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        # A star forest: every node is linked up to one root at most, and no root is linked up.
        ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(1).alias("up")))
        seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("root"))
        if seen.where("up > 1 OR (up > 0 AND root = 0)").isEmpty():
            break
        edges = keep(_stars(_stars(edges, True), False), edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
