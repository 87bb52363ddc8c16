"""Index snapshots and the commands over them.

A snapshot is a directory of Parquet tables: chunks, postings, term_stats,
corpus_stats, manifest, and vectors if they were made. Each build writes a new one
and then names it in `current`, so readers never see half an index, and anything
cached is kept by snapshot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, chunking, evaluate, incremental, vectors
from quarry.operators.answers import Generator, generate
from quarry.operators.cache import lookup
from quarry.operators.retrievers import Hybrid, Lexical, Retriever, Semantic
from quarry.sources import files, schemas
from quarry.sources.work import Work, delete, filesystem

TABLES = ("chunks", "postings", "term_stats", "corpus_stats", "manifest")


@dataclass
class Snapshot:
    path: str
    number: str
    lexical: bm25.LexicalIndex
    manifest: DataFrame
    documents: DataFrame


_OPEN: dict[tuple[str, str], Snapshot] = {}


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def current(spark: SparkSession, index_dir: str) -> str:
    """Number of the snapshot in use; FileNotFoundError without an index."""
    if not exists(spark, f"{index_dir}/current"):
        raise FileNotFoundError(f"no index in {index_dir}")
    # The pointers are one small row each; the newest by time of writing holds.
    return spark.read.schema("number string, at long").json(f"{index_dir}/current").agg(F.max_by("number", "at")).first()[0]


def _publish(spark: SparkSession, index_dir: str, number: str) -> None:
    import time

    spark.createDataFrame([(number, time.time_ns())], "number string, at long").coalesce(1).write.mode("append").json(f"{index_dir}/current")


def _scanned(spark: SparkSession, raw_dir: str, root: str | None) -> DataFrame:
    """file_path, content, sha256 of each supported file, in one scan."""
    return files.scan_files(spark, raw_dir, root).select("file_path", files.text_of(F.col("raw")).alias("content"), F.sha2("raw", 256).alias("sha256"))


def write(spark: SparkSession, index_dir: str, scanned: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> str:
    """Write a snapshot of scanned files (file_path, content, sha256), their chunks by `cut`, and all that follows from them; its number.

    Files are read once, and every later table is made from written ones: nothing is
    taken from a cache, which would know a directory by its path and not see that
    files have changed.
    """
    number = uuid.uuid4().hex
    at = f"{index_dir}/{number}"
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    scanned.write.parquet(f"{at}/documents")
    read("documents").select("file_path", "sha256").write.parquet(f"{at}/manifest")
    chunks = chunking.valid(cut(read("documents").select("file_path", "content"))).select("file_path", "first_character_index", "last_character_index", "content")
    incremental.number_chunks(chunks, f"{at}/ranges").write.parquet(f"{at}/chunks")
    delete(spark, f"{at}/ranges")
    # Sorted by term, a lookup of few terms skips most row groups; a frequent term takes as many ranges as its postings need.
    bm25.postings_of(bm25.texts_of(read("chunks"))).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{at}/postings")
    bm25.term_counts(read("postings")).write.parquet(f"{at}/counts")
    terms, corpus = bm25.statistics(read("chunks").agg(F.count(F.lit(1)).alias("n")), read("counts"))
    terms.write.parquet(f"{at}/term_stats")
    corpus.write.parquet(f"{at}/corpus_stats")
    delete(spark, f"{at}/counts")
    _publish(spark, index_dir, number)
    return number


def load(spark: SparkSession, index_dir: str) -> Snapshot:
    """The current snapshot; one that is open already is handed out again, a newer one replaces it."""
    number = current(spark, index_dir)
    key = (index_dir, number)
    if key not in _OPEN:
        for old in [k for k in _OPEN if k[0] == index_dir]:
            _OPEN.pop(old)
        at = f"{index_dir}/{number}"
        read = {t: spark.read.parquet(f"{at}/{t}") for t in (*TABLES, "documents")}
        lexical = bm25.LexicalIndex(read["chunks"], read["postings"], read["term_stats"], read["corpus_stats"])
        _OPEN[key] = Snapshot(at, number, lexical, read["manifest"], read["documents"])
    return _OPEN[key]


def index(spark: SparkSession, raw_dir: str, index_dir: str, max_chunk_size: int = chunking.MAX_CHUNK, root: str | None = None) -> str:
    """Index the supported files below raw_dir; the snapshot's number."""
    chunking.check_sizes(max_chunk_size)
    if not exists(spark, raw_dir):
        raise FileNotFoundError(raw_dir)
    return write(spark, index_dir, _scanned(spark, raw_dir, root), lambda documents: chunking.chunk_documents(documents, max_chunk_size))


def index_incremental(spark: SparkSession, raw_dir: str, index_dir: str, max_chunk_size: int = chunking.MAX_CHUNK, root: str | None = None) -> tuple[str, dict[str, int]]:
    """Chunk only files that were added or changed, drop deleted ones; the snapshot's number (the old one if nothing changed) and counts by status."""
    if not exists(spark, f"{index_dir}/current"):
        number = index(spark, raw_dir, index_dir, max_chunk_size, root)
        return number, {"added": load(spark, index_dir).manifest.count()}
    old = load(spark, index_dir)
    work = Work(spark, "index")
    scanned = work.save(_scanned(spark, raw_dir, root), "scanned")
    delta = work.save(incremental.manifest_delta(old.manifest, scanned.select("file_path", "sha256")), "delta")
    counts = {r.status: r.n for r in delta.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = old.number
    if set(counts) - {"unchanged"}:
        columns = ["file_path", "first_character_index", "last_character_index", "content"]
        touched = delta.filter("status in ('added', 'changed')").select("file_path")

        def cut(documents: DataFrame) -> DataFrame:
            fresh = chunking.chunk_documents(documents.join(touched, "file_path", "left_semi"), max_chunk_size)
            return incremental.merge_chunks(old.lexical.chunks.select(*columns), fresh.select(*columns), delta)

        number = write(spark, index_dir, scanned, cut)
    work.keep()
    return number, counts


def index_semantic(spark: SparkSession, index_dir: str, make: vectors.Embedder | None = None) -> int:
    """Vectors of the current snapshot's chunks; their number. A later snapshot has none until this runs again."""
    snapshot = load(spark, index_dir)
    vectors.embed(snapshot.lexical.chunks, make or vectors.hashing_embedder()).write.mode("overwrite").parquet(f"{snapshot.path}/vectors")
    return spark.read.parquet(f"{snapshot.path}/vectors").count()


def retriever(spark: SparkSession, snapshot: Snapshot, hybrid: bool = False, make: vectors.Embedder | None = None) -> Retriever:
    """The lexical or the hybrid ranking of a snapshot."""
    lexical = Lexical(snapshot.lexical)
    if not hybrid:
        return lexical
    if not exists(spark, f"{snapshot.path}/vectors"):
        raise FileNotFoundError("no vectors for this snapshot: run index_semantic")
    return Hybrid(lexical, Semantic(spark.read.parquet(f"{snapshot.path}/vectors"), make or vectors.hashing_embedder()))


def search_batch(spark: SparkSession, questions: DataFrame, index_dir: str, k: int = 10, hybrid: bool = False, make: vectors.Embedder | None = None, by: Retriever | None = None) -> DataFrame:
    """questions (question_id, question, ...) with retrieved_sources, ranked by the given retriever or the snapshot's own; blank questions keep their row with an empty list."""
    snapshot = load(spark, index_dir)
    hits = (by or retriever(spark, snapshot, hybrid, make)).retrieve(questions, k)
    return evaluate.nest(questions, hits, snapshot.lexical.chunks)


def search(spark: SparkSession, query: str, k: int = 5, index_dir: str = "index", hybrid: bool = False, make: vectors.Embedder | None = None, cache_dir: str | None = None) -> list[dict]:
    """The k best sources of one query; [] for a blank one or k < 1. With cache_dir, kept by query, k and snapshot."""
    if not (query or "").strip() or k <= 0:
        return []
    snapshot = load(spark, index_dir)
    one = spark.createDataFrame([("q", query)], "question_id string, question string")
    namespace, params = ("search_hybrid" if hybrid else "search"), {"index_dir": index_dir, "k": k}
    key = None
    if cache_dir:
        kept = spark.read.schema(schemas.CACHE).parquet(cache_dir) if exists(spark, cache_dir) else spark.createDataFrame([], schemas.CACHE)
        row = lookup(one.withColumnRenamed("question", "query"), kept, namespace, params, snapshot.number).first()
        if row.hit:
            return [s.asDict() for s in row.sources]
        key = row.cache_key
    found = search_batch(spark, one, index_dir, k, hybrid, make).select("retrieved_sources").first()[0]
    if key:
        spark.createDataFrame([(key, found)], schemas.CACHE).coalesce(1).write.mode("append").parquet(cache_dir)
    return [s.asDict() for s in found]


def search_dataset(spark: SparkSession, dataset_path: str, save_directory: str, index_dir: str, k: int = 10, hybrid: bool = False, make: vectors.Embedder | None = None) -> str:
    """Search all questions of a dataset in one job and write the results; where they are."""
    questions = files.read_questions(spark, dataset_path).select("question_id", F.coalesce("question", F.lit("")).alias("question"), "pos")
    return files.write_results(search_batch(spark, questions, index_dir, k, hybrid, make), files.output_name(save_directory, dataset_path), k)


def answer(spark: SparkSession, query: str, make: Generator, k: int = 5, index_dir: str = "index") -> dict:
    snapshot = load(spark, index_dir)
    found = search_batch(spark, spark.createDataFrame([("q", query)], "question_id string, question string"), index_dir, k)
    row = generate(found, snapshot.documents, make).first()
    return {"query": query, "answer": row.answer, "sources": [s.asDict() for s in row.retrieved_sources]}


def answer_dataset(spark: SparkSession, results_path: str, save_directory: str, index_dir: str, make: Generator) -> str:
    """Answers to the questions of a results file, from its sources; k is passed on."""
    results = files.read_results(spark, results_path)
    k = results.agg(F.max("k")).first()[0] or 0
    out = generate(results, load(spark, index_dir).documents, make)
    return files.write_results(out, files.output_name(save_directory, results_path), k)


def evaluate_results(spark: SparkSession, results_path: str, dataset_path: str) -> dict[int, float]:
    """Recall at 1, 3, 5 and 10."""
    truth = files.read_questions(spark, dataset_path)
    results = evaluate.dedupe_results(files.read_results(spark, results_path))
    return {r.k: r.recall for r in evaluate.recall_at_k(truth, results).orderBy("k").collect()}
