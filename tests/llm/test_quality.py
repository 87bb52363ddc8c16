import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.quality import classify, keep_good, ratios, train
from tests.llm.helpers import frame


def data(n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        w = ["".join(rng.choice(["th", "er", "an", "in"]) for _ in range(3)) for _ in range(rng.randint(4, 60))]
        t = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + "$$$" for x in w), (w[0] + " ") * 40])
        docs.append((i, t, None, None, 0))
        labels.append((i, int(good), 0))
    return docs, labels


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = data()
    out = {r.doc_id: r for r in classify(frame(spark, docs), labelled(spark, labels)).collect()}
    held = [(out[i].predicted, q) for i, q, _ in labels if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in labels)
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    kept = keep_good(frame(spark, docs).withColumn("label", F.lit("clash")), labelled(spark, labels))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted} and "label" in kept.columns


def test_edges(spark):
    docs, labels = data(60)
    docs += [(100, None, None, None, 0), (101, "", None, None, 0), (None, "than", None, None, 0), (5, docs[5][1], None, None, 0)]
    labels += [(None, 1, 0), (100, None, 0), (7, 0, 0), (999, 1, 1)]
    out = classify(frame(spark, docs), labelled(spark, labels)).collect()
    assert len(out) == len(docs) and len({r.score for r in out if r.doc_id in (100, 101)}) == 1
    assert classify(frame(spark, []), labelled(spark, labels)).count() == 0
    assert {r.predicted for r in classify(frame(spark, docs), labelled(spark, [])).collect()} == {1}


def test_dual_coordinate_descent_meets_the_optimum():
    """Against plain subgradient descent on the same objective."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.array([int(0 in x or 1 in x or 2 in x) for x in rows])
    r = ratios(rows, y)
    cost = 0.5
    w, b = train(rows, y, r, cost, 300)
    s = np.where(y > 0, 1.0, -1.0)
    limit = np.where(s > 0, cost * 60 / (2 * (s > 0).sum()), cost * 60 / (2 * (s < 0).sum()))

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - t * (w[x] @ r[x] + b)) for x, t, c in zip(rows, s, limit))

    v, c = np.zeros_like(w), 0.0
    best = np.inf
    for i in range(4000):
        g, h = v.copy(), c
        for x, t, k in zip(rows, s, limit):
            if t * (v[x] @ r[x] + c) < 1:
                g[x] -= k * t * r[x]
                h -= k * t
        v, c = v - g / (i + 20), c - h / (i + 20)
        if i % 100 == 0:
            best = min(best, objective(v, c))
    assert objective(w, b) <= best * 1.01


def test_a_very_long_text_and_clashing_columns(spark):
    docs, labels = data(80)
    docs += [(900, "the than erin " * 400_000, None, None, 0), (901, "X$$$" * 1_000_000, None, None, 0)]
    df = frame(spark, docs).selectExpr("*", "'a' AS score", "'b' AS held_out", "'c' AS predicted", "'d' AS label", "'e' AS features")
    out = {r.doc_id: r for r in classify(df, labelled(spark, labels)).collect()}
    assert len(out) == 82 and out[901].predicted == 0 and all(0 <= r.score <= 1 for r in out.values())
    assert keep_good(df, labelled(spark, labels)).columns == df.columns


def test_scores_by_plain_loops(spark):
    """Features, their sum of weights and the curve, without tables of indices."""
    from quarry.llm.quality import fitted

    docs, labels = data(60)
    df = frame(spark, docs)
    w, b = fitted(df, labelled(spark, labels))
    out = {r.doc_id: r.score for r in classify(df, labelled(spark, labels)).collect()}
    for i, t, *_ in docs:
        raw, words_ = t.encode(), t.split()
        code = lambda a, b, c: (lambda x: (x ^ x >> 15) >> 16)((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF)
        at = {code(*raw[j : j + 3]) for j in range(len(raw) - 2)}
        n = len(words_)
        same = sum(x == y for x, y in zip(words_, words_[1:])) / max(1, n)
        distinct = len(set(words_)) / max(1, n) ** 0.8
        at |= {65536 + sum(same >= x for x in (0.001, 0.02, 0.1, 0.3)), 65541 + sum(distinct >= x for x in (0.1, 0.3, 0.6, 1.0)), 65546 + sum(n >= x for x in (1, 5, 20, 60, 200))}
        assert abs(out[i] - 1 / (1 + np.exp(-(sum(w[j] for j in at) + b)))) < 1e-9


def test_a_sample_beyond_the_indices_is_cut(spark, monkeypatch):
    import quarry.llm.quality as m

    docs, labels = data(120)
    seen = []
    monkeypatch.setattr(m, "fit", lambda rows, y: seen.append(sum(map(len, rows))) or (np.zeros(m.TABLE + m.EXTRA), 0.0))
    m.fitted(frame(spark, docs), labelled(spark, labels))
    monkeypatch.setattr(m, "MAX_INDICES", seen[0] // 2)
    m.fitted(frame(spark, docs), labelled(spark, labels))
    assert seen[0] // 4 < seen[1] <= seen[0] // 2
