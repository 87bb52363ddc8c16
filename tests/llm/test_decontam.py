import random
import re

import numpy as np

from quarry.llm.decontam import contaminated, match_lengths, tile
from tests.llm.helpers import frame

ITEMS = "item_id long, text string"


def plain_tiles(item, doc, least=4):
    """Greedy tiling by trying all matches again and again."""
    ui, ud, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and not ui[p + n] and not ud[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        ui[p : p + n], ud[q : q + n] = [True] * n, [True] * n
        out.append(best)


def toks(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def corpus(rng):
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w = items[i % 12][1].split()
            parts = [w[a : a + 6] for a in range(0, len(w), 6)]
            if i % 2:
                rng.shuffle(parts)
            body[len(body) // 2 : len(body) // 2] = [x.upper() + "," for p in parts for x in p]
        docs.append((i, " ".join(body), None, None, 0))
    return docs, items


def test_like_brute_force(spark):
    docs, items = corpus(random.Random(4))
    want = {}
    for d in docs:
        for i, t in items:
            w = toks(t)
            n = sum(x[0] for x in plain_tiles(w, toks(d[1])))
            if n >= 0.5 * len(w):
                want[d[0], i] = n
    assert len(want) >= 20
    df, bench = frame(spark, docs), spark.createDataFrame(items, ITEMS)
    for size in (1 << 24, 500):
        got = contaminated(df, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id): r.n_covered for r in got} == want
        assert all(abs(r.coverage - r.n_covered / len(toks(items[r.item_id][1]))) < 1e-9 for r in got)


def test_edges(spark):
    whole = "one two three four five six"
    docs = [(None, whole, None, None, 0), (1, None, None, None, 0), (2, "", None, None, 0), (3, f"x {whole} " * 3, None, None, 0), (3, whole, None, None, 0), (4, "one two three", None, None, 0)]
    items = [(1, whole), (1, whole), (2, None), (3, "one two"), (None, whole + " seven")]
    df = frame(spark, docs).selectExpr("*", "1 AS item_id", "2 AS coverage")
    got = contaminated(df, spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(None, 1), (None, None), (3, 1), (3, None)}
    assert got.count() == 4
    assert contaminated(df, spark.createDataFrame([], ITEMS)).count() == 0
    assert contaminated(frame(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0


def test_match_lengths_and_tiles():
    rng = np.random.default_rng(1)
    item, doc = rng.integers(0, 3, 20).astype(np.uint64) + np.uint64(1), rng.integers(0, 3, 50).astype(np.uint64) + np.uint64(1)
    p, q = np.divmod(np.arange(1000), 50)
    for a, b, n in zip(p, q, match_lengths(item, doc, p, q)):
        m = 0
        while a + m < 20 and b + m < 50 and item[a + m] == doc[b + m]:
            m += 1
        assert n == m
    own = [t[2] for t in tile(item, doc, p, q, 3)]
    assert own == sorted(own, reverse=True) and own == [t[0] for t in plain_tiles(item.tolist(), doc.tolist(), 3)]


def test_a_very_long_text(spark):
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(1, "filler word " * 500_000 + item[: len(item) // 2] + " between " * 5 + item[len(item) // 2 :] + " rest" * 100_000, None, None, 0), (2, "filler word " * 500_000, None, None, 0)]
    out = contaminated(frame(spark, rows), spark.createDataFrame([(7, item), (8, "filler word filler")], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(1, 7)]
