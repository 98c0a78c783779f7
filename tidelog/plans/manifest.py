"""The versioned file manifest: folding edits, versions, live files, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import file_kind, file_number
from tidelog.schema import NUM_LEVELS, StoreError


def actions(edits: DataFrame) -> DataFrame:
    """Edits as ``(level, number, edit_id, is_add, file)``; within one edit, adds come after deletes."""
    gone = edits.select("edit_id", F.explode("deleted").alias("f")).select(
        F.col("f.level").alias("level"), F.col("f.number").alias("number"), "edit_id", F.lit(0).alias("is_add")
    )
    new = edits.select("edit_id", F.explode("added").alias("file")).select(
        F.col("file.level").alias("level"), F.col("file.number").alias("number"), "edit_id", F.lit(1).alias("is_add"), "file"
    )
    return new.unionByName(gone, allowMissingColumns=True)


def fold(acts: DataFrame) -> DataFrame:
    """Files of the version after all edits: those whose last action was an add."""
    last = Window.partitionBy("level", "number").orderBy(F.col("edit_id").desc(), F.col("is_add").desc())
    return acts.withColumn("_r", F.row_number().over(last)).where("_r = 1 AND is_add = 1").drop("_r", "is_add", "edit_id")


def overlaps(files: DataFrame) -> DataFrame:
    """Neighbouring files of a level above 0 whose ranges meet; none in a valid version."""
    order = Window.partitionBy("level").orderBy("smallest_k", "number")
    reach = F.max("largest_k").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return files.where("level > 0").withColumn("reached", reach).where(F.col("reached") >= F.col("smallest_k")).drop("reached")


def level_counts(files: DataFrame) -> DataFrame:
    """Number of files of every level, empty levels included."""
    levels = files.sparkSession.range(NUM_LEVELS).select(F.col("id").cast("int").alias("level"))
    return levels.join(files.groupBy("level").count(), "level", "left").select("level", F.coalesce("count", F.lit(0)).alias("n_files"))


def scalars(edits: DataFrame) -> DataFrame:
    """Last value that any edit set for each counter: one row."""
    names = ("comparator", "log_number", "next_file", "last_seq")
    return edits.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("edit_id"))).alias(n) for n in names])


def validate(row, comparator: str) -> None:
    """Refuse a manifest without its counters or of another key order."""
    for name in ("next_file", "log_number", "last_seq"):
        if row[name] is None:
            raise StoreError("Corruption", f"manifest has no {name}")
    if row["comparator"] is not None and row["comparator"] != comparator:
        raise StoreError("InvalidArgument", f"manifest was written with comparator {row['comparator']}")


def obsolete(listing: DataFrame, live: DataFrame, min_log: int, manifest: int) -> DataFrame:
    """Owned files of ``listing(name)`` that may go: old logs and manifests, tables and temporaries not live."""
    named = listing.withColumn("kind", file_kind(F.col("name"))).withColumn("number", file_number(F.col("name")))
    owned = named.where(F.col("kind").isin("log", "manifest", "table", "temp"))
    marked = owned.join(live.select("number").distinct().withColumn("_live", F.lit(True)), "number", "left")
    keep = (
        F.when(F.col("kind") == "log", F.col("number") >= min_log)
        .when(F.col("kind") == "manifest", F.col("number") >= manifest)
        .otherwise(F.coalesce("_live", F.lit(False)))
    )
    return marked.where(~keep).select("name", "kind", "number")


def logs_to_replay(listing: DataFrame, min_log: int) -> DataFrame:
    named = listing.where(file_kind(F.col("name")) == "log").withColumn("number", file_number(F.col("name")))
    return named.where(F.col("number") >= min_log)
