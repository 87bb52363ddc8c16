"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT, CANDIDATES = 60, 50


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, constant: int = CONSTANT, candidates: int = CANDIDATES) -> DataFrame:
    """question_id, chunk_id, score, rank <= k from two rankings (question_id, chunk_id, rank), each cut at `candidates`.

    One shuffle by question and chunk. Ties: lexical hits in their order, then
    semantic-only hits in theirs.
    """
    part = 1.0 / (F.lit(constant) + F.col("rank"))
    lex = lexical.filter(F.col("rank") <= candidates).select("question_id", "chunk_id", F.col("rank").alias("lex_rank"), F.lit(None).cast("int").alias("sem_rank"), part.alias("part"))
    sem = semantic.filter(F.col("rank") <= candidates).select("question_id", "chunk_id", F.lit(None).cast("int").alias("lex_rank"), F.col("rank").alias("sem_rank"), part.alias("part"))
    both = lex.unionByName(sem).groupBy("question_id", "chunk_id").agg(F.sum("part").alias("score"), F.max("lex_rank").alias("lex_rank"), F.max("sem_rank").alias("sem_rank"))
    order = Window.partitionBy("question_id").orderBy(F.round("score", 12).desc(), F.col("lex_rank").asc_nulls_last(), F.col("sem_rank").asc())
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(0, k)).select("question_id", "chunk_id", "score", "rank")
