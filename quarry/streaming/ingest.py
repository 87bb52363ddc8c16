"""A stream of documents kept as chunks: each micro-batch replaces the chunks of its files.

The state is the table itself, keyed by file_path, so no watermark is needed; a
batch that is repeated after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import MAX_CHUNK, chunk_documents
from quarry.plans.index import exists


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Chunks as of the newest version (below `before`), with their version."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema("version long, file_path string, first_character_index int, last_character_index int, content string").parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("file_path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file_path", "version"]).filter("first_character_index is not null")


def ingest(documents: DataFrame, path: str, checkpoint: str, max_chunk_size: int = MAX_CHUNK, trigger: dict | None = None):
    """Start a query that appends, for each batch of documents (file_path, content; null content: deleted), their chunks as a new version."""

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("file_path").agg(F.last("content").alias("content"))
        cut = chunk_documents(last.filter("content is not null"), max_chunk_size)
        # A row without span marks that the file was seen, also if it has no chunks now.
        seen = last.select("file_path", F.lit(None).cast("int").alias("first_character_index"), F.lit(None).cast("int").alias("last_character_index"), F.lit(None).cast("string").alias("content"))
        cut.unionByName(seen).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
