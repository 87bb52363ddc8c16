"""Vector search: unit vectors, inner products, and ranks.

Question vectors are a stated query set: their matrix goes to the workers in
blocks of a checked size, and each block meets the vectors in matrix products of a
bounded number of scores, whatever the number of questions. A task keeps its k best
a question. Only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import embedding_text, l2_normalize
from quarry.operators.ranking import HITS, Best, tile_rows

BLOCK_BYTES = 8 << 20
#: Vectors that a worker multiplies at once, at most.
TILE_ROWS = 1024


def normalized(vectors: DataFrame) -> DataFrame:
    """chunk_id, embedding as unit vectors."""
    return vectors.withColumn("embedding", l2_normalize(F.col("embedding")))


def _best(shared, k: int):
    def fn(batches):
        names, matrix = shared.value
        best = Best(len(names), k)
        step = min(TILE_ROWS, tile_rows(len(names)))
        for batch in batches:
            for start in range(0, batch.num_rows if names else 0, step):
                rows = batch.slice(start, step)
                flat = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                best.offer(np.round(matrix @ flat.T, 9), rows.column(0).to_numpy())
        yield from best.batches(names)

    return fn


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """question_id, chunk_id, score, rank <= k of queries (question_id, embedding) against vectors (chunk_id, embedding), all unit vectors; ties by chunk_id."""
    queries = queries.select(F.col("question_id").cast("string").alias("question_id"), "embedding")
    size = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0] * 8
    n = max(1, -(-size // block_bytes))
    hits = None
    for b in range(n):
        block = queries.filter(F.pmod(F.xxhash64("question_id"), F.lit(n)) == b).toArrow()
        matrix = block.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(max(1, block.num_rows), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((block.column("question_id").to_pylist(), matrix))
        some = vectors.select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(_best(shared, max(1, k)), HITS)
        hits = some if hits is None else hits.unionByName(some)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(0, k))


#: Makes, once a worker, a function from texts to their vectors.
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors (texts, tokens, width) where mask is 1."""
    weight = mask[..., None].astype(np.float64)
    return (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def hashing_embedder(width: int = 384, most: int = 512) -> Embedder:
    """Stand-in where no model is at hand: signed hashes of the first `most` words, mean-pooled."""

    def make():
        import zlib

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, text in enumerate(texts):
                words = text.lower().split()[:most]
                for w in words:
                    h = zlib.crc32(w.encode())
                    out[i, h % width] += 1.0 if h >> 31 else -1.0
                out[i] /= max(1, len(words))
            return out

        return embed

    return make


def embed(chunks: DataFrame, make: Embedder, batch: int = 64) -> DataFrame:
    """chunk_id, embedding (unit vectors) of chunks (chunk_id, file_path, content); the model is made once a worker."""

    @F.pandas_udf("array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in texts:
            rows: list[np.ndarray] = []
            for i in range(0, len(part), batch):
                v = np.asarray(model(part.iloc[i : i + batch].tolist()), np.float64)
                rows += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pd.Series(rows, dtype=object)

    return chunks.select("chunk_id", vectors(embedding_text(F.col("file_path"), F.col("content"))).alias("embedding"))


def embed_questions(questions: DataFrame, make: Embedder) -> DataFrame:
    """question_id, embedding of questions that aren't blank."""
    from quarry.functions.text import not_blank

    rows = questions.filter(not_blank(F.col("question"))).select(F.col("question_id").alias("chunk_id"), F.lit(None).cast("string").alias("file_path"), F.col("question").alias("content"))

    @F.pandas_udf("array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in texts:
            v = np.asarray(model(part.tolist()), np.float64)
            yield pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)), dtype=object)

    return rows.select(F.col("chunk_id").alias("question_id"), vectors("content").alias("embedding"))
