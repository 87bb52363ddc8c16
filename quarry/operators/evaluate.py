"""Recall@k of ranked spans against true spans by span overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import span_iou

KS, THRESHOLD = (1, 3, 5, 10), 0.05


def dedupe_results(results: DataFrame) -> DataFrame:
    """The last row of each question_id by pos."""
    order = Window.partitionBy("question_id").orderBy(F.desc("pos"))
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def usable_truth(truth: DataFrame) -> DataFrame:
    """Questions with a text and sources none of which lacks a field; the rest doesn't count."""
    whole = F.forall("sources", lambda s: s["file_path"].isNotNull() & s["first_character_index"].isNotNull() & s["last_character_index"].isNotNull())
    return truth.filter(F.col("question").isNotNull() & (F.size("sources") > 0) & whole)


def first_matches(truth: DataFrame, results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """question_id, pos, first_match_rank (null: never) of each true span; truth (question_id, sources), results (question_id, retrieved_sources).

    Spans meet on question and file, so the overlap is a residual of a hash join.
    """
    t = truth.select("question_id", F.posexplode("sources").alias("pos", "t"))
    r = results.select("question_id", F.posexplode("retrieved_sources").alias("at", "r")).select(F.col("question_id").alias("rq"), (F.col("at") + 1).alias("rank"), "r")
    span = lambda x: (F.col(f"{x}.file_path"), F.col(f"{x}.first_character_index"), F.col(f"{x}.last_character_index"))
    match = (F.col("question_id") == F.col("rq")) & (F.col("t.file_path") == F.col("r.file_path")) & (span_iou(*span("t"), *span("r")) >= threshold)
    return t.join(r, match, "left").groupBy("question_id", "pos").agg(F.min("rank").alias("first_match_rank"))


def recall_at_k(truth: DataFrame, results: DataFrame, ks: tuple[int, ...] = KS, threshold: float = THRESHOLD) -> DataFrame:
    """k, recall: share of each question's true spans found within rank k, averaged over the questions that have any; 0 if none has."""
    found = first_matches(usable_truth(truth), results, threshold)
    per = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first_match_rank") <= k).alias(f"m{k}") for k in ks])
    means = per.agg(*[F.coalesce(F.avg(F.col(f"m{k}") / F.col("n")), F.lit(0.0)).alias(f"r{k}") for k in ks])
    return means.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])))


def nest(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions with retrieved_sources in order of rank; a question without hits has an empty list."""
    spans = hits.join(chunks.select("chunk_id", "file_path", "first_character_index", "last_character_index"), "chunk_id")
    source = F.struct("file_path", "first_character_index", "last_character_index")
    lists = spans.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", source.alias("source")))).alias("ranked"))
    empty = F.array().cast("array<struct<file_path:string,first_character_index:int,last_character_index:int>>")
    return questions.join(lists, "question_id", "left").withColumn("retrieved_sources", F.coalesce(F.transform("ranked", lambda r: r["source"]), empty)).drop("ranked")
