"""Rankings that search can use: a retriever turns a batch of questions into ranked hits.

Anything with this method can be handed to `search_batch`, also one of a user's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import not_blank
from quarry.operators import bm25, fusion, vectors


@runtime_checkable
class Retriever(Protocol):
    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        """question_id, chunk_id, score, rank from 1 to k at most, of questions (question_id, question)."""


@dataclass
class Lexical:
    """BM25 scores."""

    index: bm25.LexicalIndex

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        return bm25.retrieve(self.index, questions, k)


@dataclass
class Semantic:
    """Inner products of unit vectors (chunk_id, embedding) with those of the questions."""

    vectors: DataFrame
    make: vectors.Embedder

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        return vectors.cosine_top_k(self.vectors, vectors.embed_questions(questions, self.make), k)


@dataclass
class Hybrid:
    """Reciprocal ranks of two retrievers, fused; blank questions have no hits."""

    lexical: Retriever
    semantic: Retriever
    candidates: int = fusion.CANDIDATES

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        asked = questions.filter(not_blank(F.col("question")))
        return fusion.fuse(self.lexical.retrieve(asked, self.candidates), self.semantic.retrieve(asked, self.candidates), k, candidates=self.candidates)
