"""Streaming ingest: files of operations become appended, sequenced log segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.batch import dedup_first


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch as one segment ``batch=N``; a replayed batch overwrites its own segment.

    Records carry their sequence, so nothing is late: the log is resolved when
    it is read, and the stream keeps no state. ``each`` is a hook on a batch.
    """

    def commit(df: DataFrame, number: int) -> None:
        rows = each(df) if each else df
        dedup_first(rows.withColumn("_at", F.monotonically_increasing_id()), "_at").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """All segments as one log; identical versions of two segments count once."""
    return dedup_first(spark.read.parquet(path), "batch")
