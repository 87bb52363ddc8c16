"""Answers to questions from retrieved sources, with a model that workers make once."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import chat_messages, clean_answer, not_blank
from quarry.operators.context import build_context

SYSTEM = "You answer questions about a code base. Answer directly, accurately and concisely from the context alone. Leave out your reasoning. If the context doesn't hold the answer, say that it is unavailable."
# Fixed value: the answer to a blank question.
NO_QUESTION = "No question provided."

#: Makes, once a worker, a function from chat messages and a number of new tokens to text.
Generator = Callable[[], Callable[[list[dict[str, str]], int], str]]


def extractive_generator() -> Generator:
    """Stand-in where no model is at hand: the context line that shares most words with the question, earliest on ties."""

    def make():
        def answer(messages: list[dict[str, str]], most: int) -> str:
            user = messages[-1]["content"]
            body, _, rest = user.removeprefix("Context:\n").rpartition("\n\nQuestion: ")
            wanted = set(re.findall(r"\w+", rest.lower()))
            lines = [x for x in body.splitlines() if x.strip() and not x.startswith("[Source ")]
            best = max(lines, key=lambda x: len(wanted & set(re.findall(r"\w+", x.lower()))), default="The answer is unavailable.")
            return " ".join(best.split()[:most])

        return answer

    return make


def generate(results: DataFrame, documents: DataFrame, make: Generator, max_new_tokens: int = 256, system: str = SYSTEM) -> DataFrame:
    """results (question_id, question, retrieved_sources, ...) with answer."""
    asked = results.join(build_context(results, documents), "question_id").withColumn("_messages", chat_messages(F.col("question"), F.col("context"), system)).drop("context")
    fields = asked.drop("_messages").schema.add("answer", "string")
    question, messages = asked.columns.index("question"), asked.columns.index("_messages")

    def fn(batches):
        model = None
        for batch in batches:
            answers = []
            for q, m in zip(batch.column(question).to_pylist(), batch.column(messages).to_pylist()):
                if not (q or "").strip():
                    answers.append(NO_QUESTION)
                else:
                    model = model or make()
                    answers.append(model(m, max_new_tokens))
            keep = [i for i in range(batch.num_columns) if i != messages]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(answers, pa.string())], [*(batch.schema.names[i] for i in keep), "answer"])

    out = asked.mapInArrow(fn, fields)
    return out.withColumn("answer", F.when(not_blank(F.col("question")), clean_answer(F.col("answer"))).otherwise(F.col("answer")))
