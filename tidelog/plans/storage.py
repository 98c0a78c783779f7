"""Sorted tables on Parquet: flush, file metadata, pruned read-back, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.batch import entry_bytes
from tidelog.schema import OP_PUT, Options, version_order

#: Rows that one task sorts, about: larger tables are cut into more files.
ROWS_PER_FILE = 1 << 19


def pieces(rows: int, least: int = 1) -> int:
    """Parts that so many rows are cut into."""
    return max(least, -(-rows // ROWS_PER_FILE))


def write_sorted(log: DataFrame, path: str, files: int, options: Options = Options(), distinct_keys: int | None = None, rows: int | None = None) -> DataFrame:
    """Write a log as sorted files of disjoint key ranges, ``files`` or as many as ``ROWS_PER_FILE`` asks for; returns their metadata.

    The range shuffle is by key alone, so versions of a key share a file.
    Delta-encoded keys come with the v2 writer; a Bloom filter on the key
    column is sized by ``distinct_keys`` where that is known. ``rows`` is the
    log's row count or a bound of it; without it the log is counted.
    """
    files = pieces(log.count() if rows is None else rows, files)
    writer = (
        log.repartitionByRange(files, F.col("k").asc_nulls_last())
        .sortWithinPartitions(*version_order())
        .write.mode("overwrite")
        .option("compression", options.compression)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#k", "false")
    )
    if distinct_keys:
        writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(distinct_keys))
    writer.parquet(path)
    return file_metadata(log.sparkSession.read.schema(log.schema).parquet(path))


def file_metadata(table: DataFrame) -> DataFrame:
    """Smallest and largest key and entry count of each file of a table as ``write_sorted`` makes it: its first and last row.

    Only those rows meet in an aggregate: one of keys over all rows would sort them, a file in one task.
    """
    key, at = F.struct("k", "seq", "op"), F.col("_metadata.row_index").alias("at")
    path, size = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size")
    ends = table.select(path, at).groupBy("path").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    edges = table.select("k", "seq", "op", path, size, at).join(F.broadcast(ends), "path").where("at = 0 OR at = last")
    return edges.groupBy("path", "file_size", "n").agg(F.min_by(key, "at").alias("smallest"), F.max_by(key, "at").alias("largest")).select("path", "file_size", "smallest", "largest", "n")


def summarize(log: DataFrame, by: str, key_len, value_len) -> DataFrame:
    """What a flush records of each output group: range, entries, encoded bytes."""
    return log.groupBy(by).agg(
        F.min("k").alias("smallest_k"), F.max("k").alias("largest_k"), F.count(F.lit(1)).alias("n"), F.sum(entry_bytes(key_len, value_len)).alias("bytes")
    )


def may_hold(files: DataFrame, key: object) -> DataFrame:
    """Files whose key range covers a key."""
    return files.where((F.col("smallest.k") <= F.lit(key)) & (F.col("largest.k") >= F.lit(key)))


def read_pruned(spark: SparkSession, files: DataFrame, key: object, schema) -> DataFrame:
    """Rows of one key, reading only files whose range covers it; the list is that of a manifest, not of rows."""
    paths = [r.path for r in may_hold(files, key).select("path").collect()]
    table = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return table.where(F.col("k") == F.lit(key))


def compact(log: DataFrame, oldest_snapshot: int | None = None, bottom: bool = True) -> DataFrame:
    """Drop what no snapshot from ``oldest_snapshot`` on can see.

    Of the versions at or under it only the newest of a key stays, and not
    even that if it is a tombstone on the bottom level; later ones all stay.
    Null means that only the latest state is wanted.
    """
    old = F.lit(True) if oldest_snapshot is None else F.col("seq") <= F.lit(oldest_snapshot)
    order = Window.partitionBy("k", "_old").orderBy(F.col("seq").desc(), F.col("op").desc())
    ranked = log.withColumn("_old", old).withColumn("_r", F.row_number().over(order))
    keep = ~F.col("_old") | ((F.col("_r") == 1) & (F.lit(not bottom) | (F.col("op") == OP_PUT)))
    return ranked.where(keep).drop("_old", "_r")


def block_prefixes(keys: DataFrame, group: str, interval: int = 16) -> DataFrame:
    """Delta form of each group's sorted keys: shared prefix with the key before, 0 at restarts."""
    from tidelog.functions.keys import shared_prefix

    order = Window.partitionBy(group).orderBy("k", "id")
    rows = keys.withColumn("pos", F.row_number().over(order) - 1).withColumn("_b", F.lag("k").over(order))
    restart = F.col("pos") % interval == 0
    shared = F.when(restart, 0).otherwise(shared_prefix(F.col("k"), F.col("_b")))
    return rows.withColumn("restart", restart).withColumn("shared", shared).drop("_b")
