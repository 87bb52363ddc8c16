import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm.blocks import block_of, cut_points
from quarry.llm.common import Words, buffers, clear, n_words, pieces, save
from tests.llm.helpers import DOCS, corpus, frame, words


def test_words_and_grams_are_those_of_each_text():
    rng = random.Random(0)
    texts = [None, "", " ", "a", *("".join(rng.choice("ab É\n\t\x1c ") for _ in range(rng.randint(0, 60))) for _ in range(200))]
    raw, off = buffers(pa.array(texts))
    w = Words(raw, off)
    known, grams = {}, {}
    for i, t in enumerate(texts):
        lo, hi = w.rows[i], w.rows[i + 1]
        want = words(t)
        assert [raw[a:b].tobytes().decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] == want
        for x, h in zip(want, w.hashes[lo:hi]):
            assert known.setdefault(x, h) == h
        for k in (2, 3):
            g, ok = w.grams(k)
            assert ok[lo:hi].sum() == max(0, len(want) - k + 1)
            for j in np.flatnonzero(ok[lo:hi]):
                assert grams.setdefault(tuple(want[j : j + k]), g[lo + j]) == g[lo + j]
    assert len(set(known.values())) == len(known) and len(set(grams.values())) == len(grams)


def test_slices_and_cases():
    texts = pa.array(["Ab cD", "ab cd", None, "ÉA éa"])
    raw, off = buffers(texts.slice(1))
    assert off.tolist() == [0, 5, 5, 12]
    h = Words(*buffers(texts), lower=True).hashes
    assert h[:2].tolist() == h[2:4].tolist() and h[4] != h[5]
    assert list(pieces(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_word_counts(spark):
    rows = corpus(11, 60)
    got = {r.doc_id: r.n for r in frame(spark, rows).select("doc_id", n_words(F.col("text")).alias("n")).collect()}
    assert got == {r[0]: len(words(r[1])) for r in rows}


def test_blocks(spark):
    df = spark.createDataFrame([(i * 7 - 300, "x" * 50, None, None, 0) for i in range(500)] + [(None, "y", None, None, 0)], DOCS)
    cuts = cut_points(df, 1000)
    got = df.select("doc_id", block_of(df.doc_id, cuts).alias("b")).collect()
    assert 15 < len(cuts) < 40
    assert all(r.b == (len(cuts) if r.doc_id is None else sum(c <= r.doc_id for c in cuts)) for r in got)
    assert {r.b for r in df.select(block_of(df.doc_id, []).alias("b")).collect()} == {0}


def test_blocks_of_dense_ids_and_long_documents_are_alike(spark):
    """A far id, a dense run, and a run of long documents: no block has much more than it should."""
    size = {i: 20 for i in range(3000)} | {5000 + i: 4000 if i < 20 else 10 for i in range(100)} | {1 << 60: 30, -(1 << 62): 30}
    df = spark.createDataFrame([(i, "x" * n, None, None, 0) for i, n in size.items()], DOCS)
    cuts = cut_points(df, 5000)
    assert cuts == sorted(set(cuts)) and 20 < len(cuts) < 80
    got = {}
    for r in df.select("doc_id", block_of(df.doc_id, cuts).alias("b")).collect():
        got[r.b] = got.get(r.b, 0) + size[r.doc_id]
    assert max(got.values()) <= 10_000
    assert cut_points(frame(spark, []), 10) == [] and cut_points(df.filter("doc_id = 1"), 1) == []


def test_saved_tables_can_be_cleared(spark):
    df = save(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5
    clear(spark)
    import os

    assert not os.path.exists(path)
