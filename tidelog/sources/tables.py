"""Input tables, and the changelog view of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import OP_DELETE, OP_PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: user is the key, event order the sequence, an error event a tombstone."""
    events = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, OP_DELETE).otherwise(OP_PUT).alias("op"),
        F.when(~gone, F.col("value")).alias("v"),
    )
