import random

import numpy as np
import pytest

import quarry.llm.neardup as m
from quarry.llm.common import Work
from quarry.llm.neardup import band_keys, components, jaccard_estimate, near_duplicates, sketches
from tests.llm.helpers import corpus, frame, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent=80):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], shingles(r[1], k))
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_like_brute_force(spark, k):
    rows = corpus(6, 150)
    out = near_duplicates(frame(spark, rows), k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_chains_in_one_bucket_are_not_lost(spark):
    """Near copies of a drifting text: neighbours are linked, the ends aren't; and texts that share a bucket without a link."""
    rng = random.Random(7)
    text, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        rows.append((i, " ".join(text), None, None, 0))
        text[rng.randrange(60)] = f"n{i}"
        text[rng.randrange(60)] = f"m{i}"
    rows += [(100 + i, " ".join(f"w{j}" if j % 3 else f"q{i}_{j}" for j in range(60)), None, None, 0) for i in range(40)]
    band, bands = m.BAND, m.BANDS
    try:  # short bands put nearly all in one bucket
        m.BAND, m.BANDS = 1, 40
        out = near_duplicates(frame(spark, rows), 2).collect()
    finally:
        m.BAND, m.BANDS = band, bands
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 2)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d", None, None, 0), (3, "a b c d", None, None, 0), (3, "a b c d", None, None, 0), (1, None, None, None, 0), (2, "", None, None, 0), (9, "A  b\tc d", None, None, 0)]
    out = near_duplicates(frame(spark, rows).selectExpr("*", "1 AS n", "2 AS h1", "3 AS id"), 2).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in out) == sorted([("None", 3, None, True), ("3", 3, 3, True), ("3", 3, 3, True), ("1", 0, 1, True), ("2", 0, 2, True), ("9", 3, 3, False)], key=lambda x: (x[0], x[1]))
    assert near_duplicates(frame(spark, []), 2).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(51, 60)] + [(70, 71)]
    rng = random.Random(1)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "test"), "c").collect()}
    assert got == {i: 0 for i in range(1, 31)} | {i: 50 for i in range(51, 60)} | {71: 70}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(2)
    every = rng.permutation(np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)))
    for n in (40, 400, 3000):
        a, b = np.sort(every[: n]), np.sort(every[n // 10 : n + n // 10])
        truth = (n - n // 10) / (n + n // 10)
        r = sketches([a, b])
        assert abs(jaccard_estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0] - truth) < 0.15
    r = sketches([np.sort(every[:3000]), np.sort(every[3000:])])
    assert jaccard_estimate(r[:1], r[1:], np.array([3000]), np.array([2900]))[0] < 0.05


def near_copies(rng, text, n, most):
    """Copies of a text with up to `most` words changed, at places of their own."""
    out = []
    for i in range(n):
        own = list(text)
        for at in rng.sample(range(len(own)), rng.randrange(most)):
            own[at] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("share", [4, 256])
@pytest.mark.parametrize("k", [2, 5])
def test_families_around_the_threshold(spark, k, share):
    """Near copies of three texts and a passage in many others: many members are linked with a few or with none. How groups are dealt in parts changes nothing."""
    rng = random.Random(11)
    base = [[f"t{j}w{i}" for i in range(80)] for j in range(3)]
    texts = [x for t in base for x in near_copies(rng, t, 60, 16)]
    texts += [" ".join([*base[0][:30], *(f"u{i}x{j}" for j in range(rng.randrange(60)))]) for i in range(60)]
    texts += [t + " " + " ".join(f"tail{j}" for j in range(rng.randrange(8))) for t in texts[:40]]
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    old = m.SHARE
    try:
        m.SHARE = share
        out = near_duplicates(frame(spark, rows), k).collect()
    finally:
        m.SHARE = old
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k)


def test_differences_decide_like_sets(spark):
    """What two members share beside a core tells their link, whatever the core."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        core = set(rng.choice(60, rng.integers(0, 40), replace=False).tolist())
        x, y = (set(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) for _ in range(2))
        w = lambda s: 100 * len(core - s) + 80 * len(s - core)
        shared = len((core - x) & (core - y)) + len((x - core) & (y - core))
        assert (180 * shared >= w(x) + w(y) - 20 * len(core)) == (100 * len(x & y) >= 80 * len(x | y))


@pytest.mark.parametrize("n", [4, 5, 9, 18, 45, 400])
def test_recall_of_the_bands_by_size(n):
    """Pairs of similarity 0.8, or as little above it as their size allows, share a band."""
    rng = np.random.default_rng(n)
    sets, both = [], -(-8 * n // 9)
    for _ in range(400):
        every = rng.permutation(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2))
        if n < 9:  # one has a shingle more
            sets += [np.sort(every[:n]), np.sort(every[: n + 1])]
        else:
            sets += [np.sort(every[:n]), np.sort(np.concatenate([every[:both], every[n : 2 * n - both]]))]
    keys = band_keys(sketches(sets))
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.99


def test_a_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, text, None, None, 0), (2, text + " tail", None, None, 0), (3, "short one here", None, None, 0)]
    out = near_duplicates(frame(spark, rows).selectExpr("*", "1 AS g", "2 AS id", "3 AS w", "4 AS key"), 5).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 3}


def test_a_repeated_id_with_other_texts_does_not_break(spark):
    rows = [(7, "a b c d e f", None, None, 0), (7, "q r s t u v", None, None, 0), (8, "q r s t u v", None, None, 0), (9, "x y", None, None, 0)]
    out = near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(7, 7), (7, 7), (8, 7), (9, 9)]
