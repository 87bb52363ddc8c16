import numpy as np

import pandas as pd

from quarry.llm.mixing import _rounder, mix_sources, pivot
from tests.llm.helpers import corpus, frame, words


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight; stop at the cap and share the excess again, until none is above."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        each = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        above = {s for s in open_ if each[s] > cap * sizes[s] + 1e-9}
        if not above:
            return got | each
        for s in above:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= above
    return got


def check(spark, rows, **options):
    df = frame(spark, rows)
    out = mix_sources(df, **options).collect()
    again = mix_sources(df.repartition(7), **options).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    sizes, source = {}, {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want, taken = targets(sizes), {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        if r.size and sizes[s]:
            assert r.copies in (int(np.floor(want[s] / sizes[s] + 1e-9)), int(np.ceil(want[s] / sizes[s] - 1e-9)))
        taken[s] = taken.get(s, 0) + r.taken
    largest = max(r.size for r in out)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest, 0.02 * want[s])
    return out


def test_targets_sizes_and_nearness(spark):
    assert len(check(spark, corpus(2, 150))) == 151


def test_reduction_tree(spark):
    rows = [(i, "w " * (1 + i % 17), None, "abc"[i % 3] if i % 4 else "hot", 0) for i in range(1200)]
    out = check(spark, rows, bucket=16)
    for s in "abc":
        own = [r for r in out if rows[r.doc_id][3] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 17


def test_a_long_document_is_made_up_for_at_every_size(spark):
    """In small sources beside one of several buckets, in one of two levels and in one of three."""
    rows = [(i, "w " * (1 + i % 5), None, "big", 0) for i in range(400)]
    rows += [(1000 + i, "w " * (1 + i % 5), None, "mid", 0) for i in range(100)]
    rows += [(2000 + i, "w " * (1 + i % 5), None, f"small{i % 4}", 0) for i in range(48)]
    rows += [(3000 + i, "w " * 100, None, s, 0) for i, s in enumerate(["big", "mid"])] + [(3010 + i, "w " * (30 + i), None, f"small{i}", 0) for i in range(4)]
    source = {r[0]: r[3] for r in rows}
    out = mix_sources(frame(spark, rows), weights=(24, 6, 0.7, 0.7, 0.7, 0.7), bucket=16).collect()
    for s in set(source.values()):
        own = [r for r in out if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3


def test_null_empty_and_clashing(spark):
    rows = [(None, None, None, None, 0), (1, "", None, "a", 0), (2, "a b", None, "b", 0), (2, "a b", None, "b", 0)]
    df = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS copies", "3 AS target")
    out = mix_sources(df).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 4
    assert mix_sources(frame(spark, [])).count() == 0


def test_pivot_keeps_expectation_and_mass():
    sizes, p = np.array([9, 5, 5, 3, 2, 1, 1]), np.array([0.3, 0.5, 0.2, 0.7, 0.9, 0.1, 0.4])
    mean, n = np.zeros(7), 4000
    for i in range(n):
        done, held, mass = pivot(sizes, p, np.random.default_rng(i).random(7))
        x = done.astype(float)
        if held >= 0:
            x[held] = mass
        assert abs((x * sizes).sum() - (p * sizes).sum()) < 1e-6
        mean += x
    assert np.abs(mean / n - p).max() < 0.04


def tree(sizes, p, seed, bucket):
    """Copies of one source's documents through the whole reduction tree, without Spark."""
    n = len(sizes)
    rows = pd.DataFrame({"doc_id": np.arange(n), "source_no": 1, "size": sizes, "source_size": sizes.sum(), "target": p * sizes.sum(), "n_docs": n, "copies": 0, "p": p, "way": 0})
    groups, level, copies = -(-n // bucket), 0, np.zeros(n, np.int64)
    while True:
        fn, done = _rounder(level, seed, bucket, ()), []
        of = np.random.default_rng(level).permutation(len(rows)) % groups
        for b in range(groups):
            done.append(fn(rows[of == b].assign(groups=groups, bucket=b)))
        out = pd.concat(done)
        settled = out[~out.up]
        copies[settled.doc_id] = settled.copies
        if groups == 1:
            return copies
        rows, groups, level = out[out.up].drop(columns="up"), -(-groups // bucket), level + 1


def test_the_whole_tree_keeps_expectations_and_comes_near():
    sizes, p, n = np.array([1 + i % 9 for i in range(150)] + [60]), 0.37, 500
    mean, misses = np.zeros(len(sizes)), []
    for seed in range(n):
        copies = tree(sizes, p, seed, 16)
        assert set(copies.tolist()) <= {0, 1}
        mean += copies
        misses.append(abs((copies * sizes).sum() - p * sizes.sum()))
    error = (mean / n - p) / (p * (1 - p) / n) ** 0.5
    assert np.abs(error).max() < 4.5 and abs(error.mean()) < 0.5 and abs(error[-1]) < 4
    assert max(misses) <= 2


def test_rows_without_id_and_words_do_not_share_a_bucket(spark):
    """Many rows without doc_id, text or both are dealt like others."""
    rows = [(None, None, None, "a", 0)] * 300 + [(None, "w x", None, "a", 0)] * 300 + [(i, "w " * (i % 4), None, "b", 0) for i in range(300)]
    out = mix_sources(frame(spark, rows), bucket=16).collect()
    assert len(out) == 900 and sum(r.size for r in out) == 600 + 450


def test_a_very_long_text(spark):
    out = mix_sources(frame(spark, [(1, "w " * 3_000_000, None, "a", 0), (2, "w", None, "a", 0)])).collect()
    assert {r.doc_id: r.size for r in out} == {1: 3_000_000, 2: 1}
