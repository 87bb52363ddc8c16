"""Context assembly for answers: the text of cited spans within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import context_part, not_blank, span, strip

BUDGET, SOURCES = 3000, 3


def parts(results: DataFrame, documents: DataFrame, sources: int = SOURCES) -> DataFrame:
    """question_id, pos, part of the first sources (question_id, retrieved_sources) whose file is there and whose text isn't blank."""
    cited = results.select("question_id", F.posexplode(F.slice("retrieved_sources", 1, sources)).alias("pos", "s")).select("question_id", (F.col("pos") + 1).alias("pos"), "s.*")
    text = strip(span(F.col("content"), F.col("first_character_index"), F.col("last_character_index")))
    rows = cited.join(documents.select("file_path", "content"), "file_path").withColumn("text", text).filter(not_blank(F.col("text")))
    return rows.select("question_id", "pos", context_part(F.col("pos"), F.col("file_path"), F.col("text")).alias("part"))


def within_budget(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The parts of each question before the first that overruns the budget; lengths are positive, so a running sum tells."""
    running = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length("part")).over(running)).filter(F.col("used") <= budget).drop("used")


def build_context(results: DataFrame, documents: DataFrame, budget: int = BUDGET, sources: int = SOURCES) -> DataFrame:
    """question_id, context; questions without any part have an empty context."""
    own = within_budget(parts(results, documents, sources), budget)
    joined = own.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda r: r["part"]), "\n").alias("context"))
    return results.select("question_id").distinct().join(joined, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
