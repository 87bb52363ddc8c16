import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, evaluate, fusion, vectors
from quarry.sources import schemas

CHUNKS = "chunk_id long, file_path string, content string"


def corpus(spark, *texts):
    return spark.createDataFrame([(i, f"src/f{i}.py", t) for i, t in enumerate(texts)], CHUNKS)


def ask(spark, *questions):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "question_id string, question string")


def plain_scores(texts, query):
    """The formula, straight."""
    import math
    import re

    def toks(t):
        out = []
        for w in re.split("[^a-zA-Z0-9_]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", t)):
            w = w.strip("_").lower()
            if len(w) > 1:
                out.append(w)
                if "_" in w:
                    out += [p for p in w.split("_") if len(p) > 1]
        return out

    bags = [toks(t) for t in texts]
    n, avgdl = len(bags), sum(map(len, bags)) / len(bags)
    df = {}
    for b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(q, 0) * b.count(q) * 2.5 / (b.count(q) + 1.5 * (0.25 + 0.75 * len(b) / avgdl)) for q in toks(query)) for b in bags]


TEXTS = ["def check_wheel_size(path): return wheel size of data raw", "def read_data(): return raw data data loader", "class Unrelated: raw thing with data", "", "the data of nothing raw at all"]


@pytest.mark.parametrize("query", ["check_wheel_size", "wheel size", "wheel wheel", "return", "data raw", "readData the", "quantum banana"])
def test_bm25_scores(spark, query):
    index = bm25.build(corpus(spark, *TEXTS))
    want = plain_scores([f"src/f{i}.py src/f{i}.py {t}" for i, t in enumerate(TEXTS)], query)
    for broadcast in (True, False):
        got = {r.chunk_id: r.score for r in bm25.score(ask(spark, query), index.postings, index.term_stats, index.corpus_stats, broadcast).collect()}
        assert set(got) == {i for i, s in enumerate(want) if s > 1e-12}
        assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_bm25_ranking(spark):
    index = bm25.build(corpus(spark, "alpha beta", "alpha alpha gamma", "delta", "alpha beta", "other words"))
    hits = bm25.retrieve(index, ask(spark, "beta", " ", "zzz", "beta delta"), 2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id, r.rank) for r in hits][:2] == [("0", 0, 1), ("0", 3, 2)]
    assert {r.question_id for r in hits} == {"0", "3"}
    assert bm25.retrieve(index, ask(spark, "beta"), 0).count() == 0 and bm25.retrieve(index, ask(spark, "beta"), -1).count() == 0
    many = bm25.retrieve(index, ask(spark, "alpha", "beta", "gamma delta"), 3).collect()
    single = [r for i, q in enumerate(("alpha", "beta", "gamma delta")) for r in bm25.retrieve(index, ask(spark, q), 3).collect()]
    assert sorted((r.chunk_id, r.rank, round(r.score, 9)) for r in many) == sorted((r.chunk_id, r.rank, round(r.score, 9)) for r in single)


def test_empty_index(spark):
    index = bm25.build(corpus(spark).limit(0))
    assert bm25.retrieve(index, ask(spark, "alpha"), 5).count() == 0


def rankings(spark, rows):
    return spark.createDataFrame([("q", c, r) for c, r in rows], "question_id string, chunk_id long, rank int")


def test_fusion(spark):
    lex, sem = rankings(spark, [(0, 1), (1, 2)]), rankings(spark, [(1, 1), (2, 2)])
    got = {r.chunk_id: r.score for r in fusion.fuse(lex, sem, 5).collect()}
    assert got == pytest.approx({0: 1 / 61, 1: 1 / 62 + 1 / 61, 2: 1 / 62})
    tie = fusion.fuse(rankings(spark, [(7, 1)]), rankings(spark, [(3, 1)]), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == [7, 3]
    assert fusion.fuse(lex, sem, 0).count() == 0
    cut = fusion.fuse(rankings(spark, [(i, i + 1) for i in range(80)]), sem, 100)
    assert cut.count() == 50


def test_cosine_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    df = vectors.normalized(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = df.filter("chunk_id < 5").select(F.col("chunk_id").cast("string").alias("question_id"), "embedding")
    for size in (1 << 20, 100):
        got = vectors.cosine_top_k(df, q, 4, size).orderBy("question_id", "rank").collect()
        for i in range(5):
            s = np.round(unit @ unit[i], 9)
            want = sorted(range(60), key=lambda j: (-s[j], j))[:4]
            assert [r.chunk_id for r in got if r.question_id == str(i)] == want
    assert vectors.cosine_top_k(df.limit(2), q, 10).count() == 10


def test_embeddings(spark):
    df = corpus(spark, "alpha beta", "gamma")
    rows = vectors.embed(df, vectors.hashing_embedder(16), batch=1).collect()
    assert all(len(r.embedding) == 16 and np.linalg.norm(r.embedding) == pytest.approx(1) for r in rows)
    asked = vectors.embed_questions(ask(spark, "alpha", " "), vectors.hashing_embedder(16)).collect()
    assert [r.question_id for r in asked] == ["0"]
    pooled = vectors.mean_pool(np.array([[[1.0, 2], [3, 4], [9, 9]]]), np.array([[1, 1, 0]]))
    assert pooled.tolist() == [[2, 3]]


def results(spark, rows):
    return spark.createDataFrame(rows, schemas.RESULT)


def truth(spark, rows):
    return spark.createDataFrame(rows, schemas.ANSWERED_QUESTION)


def recall(spark, t, r):
    return {x.k: x.recall for x in evaluate.recall_at_k(truth(spark, t), results(spark, r)).collect()}


def test_recall(spark):
    span = ("a.py", 10, 30)
    assert recall(spark, [("q", "?", [span], "")], [("q", "?", [span])]) == {1: 1, 3: 1, 5: 1, 10: 1}
    far = [("x.py", 0, 9)] * 3
    assert recall(spark, [("q", "?", [span, ("b.py", 0, 5)], "")], [("q", "?", [*far, ("a.py", 12, 40)])]) == {1: 0, 3: 0, 5: 0.5, 10: 0.5}
    assert recall(spark, [("q", "?", [span], ""), ("r", "?", [], ""), ("s", "?", None, "")], []) == {1: 0, 3: 0, 5: 0, 10: 0}
    assert recall(spark, [], [("q", "?", [span])]) == {1: 0, 3: 0, 5: 0, 10: 0}
    assert recall(spark, [("q", "?", [span], ""), ("z", "?", [("c", None, 3)], "")], [("q", "?", [span])])[1] == 1
    two = recall(spark, [("q", "?", [span], ""), ("r", "?", [span], "")], [("q", "?", [span])])
    assert two[1] == 0.5


def test_recall_is_monotone(spark):
    import random

    rng = random.Random(1)
    span = lambda: (rng.choice("ab"), s := rng.randrange(100), s + rng.randrange(1, 60))
    t = [(str(i), "?", [span() for _ in range(3)], "") for i in range(20)]
    r = [(str(i), "?", [span() for _ in range(10)]) for i in range(20)]
    got = recall(spark, t, r)
    assert got[1] <= got[3] <= got[5] <= got[10] and 0 < got[10] <= 1


def test_last_result_wins(spark):
    rows = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("r", 3, 2)], "question_id string, x int, pos int")
    assert sorted((r.question_id, r.x) for r in evaluate.dedupe_results(rows).collect()) == [("q", 2), ("r", 3)]


def test_nest_keeps_questions_without_hits(spark):
    chunks = corpus(spark, "a", "b").withColumn("first_character_index", F.lit(0)).withColumn("last_character_index", F.lit(1))
    hits = spark.createDataFrame([("0", 1, 0.5, 1), ("0", 0, 0.4, 2)], schemas.HITS)
    got = {r.question_id: [s.file_path for s in r.retrieved_sources] for r in evaluate.nest(ask(spark, "x", ""), hits, chunks).collect()}
    assert got == {"0": ["src/f1.py", "src/f0.py"], "1": []}


def ranked(hits):
    return sorted((r.question_id, r.rank, r.chunk_id, round(r.score, 9)) for r in hits.collect())


def test_ranking_shuffles_only_the_best(spark, monkeypatch):
    """Texts in a scan, stored postings and the joined scores rank alike, in any number of blocks and tiles, and neither a posting nor a score for each question and chunk is saved or shuffled."""
    import random

    from quarry.operators import ranking

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = corpus(spark, *[" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(300)]).repartition(3).cache()
    asked = ask(spark, *[" ".join(rng.choices(words, k=6)) for _ in range(30)], "", "zzz")
    index = bm25.build(docs)
    stored = bm25.LexicalIndex(docs, index.postings, index.term_stats, index.corpus_stats)
    want = ranked(bm25.top_k(bm25.score(asked, index.postings, index.term_stats, index.corpus_stats), 5))
    assert len(want) == 150
    for cells, chars in ((1 << 19, 1 << 20), (64, 100)):
        monkeypatch.setattr(ranking, "CELLS", cells)
        monkeypatch.setattr(bm25, "BLOCK_CHARS", chars)
        assert ranked(bm25.retrieve(index, asked, 5)) == ranked(bm25.retrieve(stored, asked, 5)) == want
    monkeypatch.setattr(bm25, "BLOCK_CHARS", 1 << 20)
    hits = bm25.retrieve(index, asked, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_best_holds_a_bounded_number_of_scores():
    from quarry.operators.ranking import Best

    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (7, 500)).astype(float)
    scores[2, :] = -np.inf
    scores[3, 40] = np.nan
    ids = rng.permutation(500)
    best = Best(7, 5)
    for a in range(0, 500, 13):
        best.offer(scores[:, a : a + 13], ids[a : a + 13])
    rows = [r for b in best.batches([str(i) for i in range(7)]) for r in b.to_pylist()]
    for q in range(7):
        key = lambda j: (-np.inf if np.isnan(scores[q, j]) else -scores[q, j], ids[j])
        want = [int(ids[j]) for j in sorted(range(500), key=key)[:5] if scores[q, j] > -np.inf or np.isnan(scores[q, j])]
        assert [r["chunk_id"] for r in rows if r["question_id"] == str(q)] == want


def test_vector_tiles_are_bounded_by_questions(monkeypatch):
    """A worker never holds scores of all questions for a whole batch of vectors."""
    import pyarrow as pa

    from quarry.operators import ranking

    rng = np.random.default_rng(2)
    matrix, v = rng.normal(size=(3000, 4)), rng.normal(size=(5000, 4))
    shapes = []
    offer = ranking.Best.offer
    monkeypatch.setattr(ranking.Best, "offer", lambda self, scores, ids: (shapes.append(scores.size), offer(self, scores, ids))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(v.tolist())], ["chunk_id", "embedding"])
    shared = type("Shared", (), {"value": ([str(i) for i in range(3000)], matrix)})
    rows = sum(b.num_rows for b in vectors._best(shared, 3)(iter([batch, batch])))
    assert rows == 9000 and max(shapes) <= ranking.CELLS
