"""From raw documents to a training mix: quality, line dedup, near dedup, decontamination, mixing.

Each stage takes what its predecessor kept and returns rows of the same columns;
the last has one row for each copy the mix takes, numbered from 1 in `copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import save, table
from quarry.llm.decontam import contaminated
from quarry.llm.linededup import without_repeats
from quarry.llm.mixing import mix_sources
from quarry.llm.neardup import near_duplicates
from quarry.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more hold, but for the largest doc_id."""
    return without_repeats(docs)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in gone; rows without one stay, and are dealt by their text."""
    salted = docs.withColumn("__salt", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    return salted.join(gone.select("doc_id", F.lit(0).cast("long").alias("__salt")), ["doc_id", "__salt"], "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are 0.8 alike or more."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return _without(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, gone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy of each document that the mix takes. A row is known by doc_id, text and source; rows that agree in all three take the mean of their numbers of copies, rounded."""
    th = F.xxhash64("text")
    taken = mix_sources(docs.select("doc_id", "text", "source", th.alias("th")), carry=("th", "source"))
    taken = taken.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("source").alias("__source")).agg(F.round(F.avg("copies")).cast("long").alias("__copies")).filter("__copies > 0")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__th")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    rows = docs.drop("copy").join(taken, same)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__id", "__th", "__source", "__copies")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Trained models and random rounding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
