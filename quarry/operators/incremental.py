"""Incremental maintenance from content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, status (added, changed, deleted or unchanged) between two manifests (file_path, sha256)."""
    o, n = old.select("file_path", F.col("sha256").alias("was")), new.select("file_path", F.col("sha256").alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "changed").otherwise("unchanged")
    return o.join(n, "file_path", "full_outer").select("file_path", status.alias("status"))


def merge_chunks(old: DataFrame, fresh: DataFrame, delta: DataFrame) -> DataFrame:
    """Old chunks of files that are unchanged, and the chunks of added and changed ones."""
    touched = delta.filter("status <> 'unchanged'").select("file_path")
    return old.join(touched, "file_path", "left_anti").unionByName(fresh.join(touched, "file_path", "left_semi"))


def number_chunks(chunks: DataFrame, at: str) -> DataFrame:
    """chunk_id by order of path (part by part), then span, without sorting all rows in one task.

    Rows are dealt in ranges, which are written to the directory `at`, so that all
    uses see the same ones; a range's first number is the count of those before it.
    """
    order = [F.split("file_path", "/"), F.col("first_character_index"), F.col("last_character_index")]
    dealt = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    dealt.write.parquet(at)
    dealt = chunks.sparkSession.read.schema(dealt.schema).parquet(at)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range reaches the window.
    starts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return dealt.join(F.broadcast(starts.select("_p", "_start")), "_p").select((F.col("_start") + F.col("_i") + 1).alias("chunk_id"), *chunks.columns)
