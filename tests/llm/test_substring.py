import random

from quarry.llm.substring import remove_repeats
from tests.llm.helpers import corpus, frame, sha, words


def brute(rows):
    seen, out = {}, []
    for n, (i, t) in enumerate(sorted([(r[0], r[1]) for r in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if seen.setdefault(tuple(w[a : a + 20]), (n, a)) != (n, a):
                gone[a : a + 20] = [True] * 20
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()], key=repr)


def test_like_brute_force_in_one_and_in_many_blocks(spark):
    rows = corpus(3, 120)
    want = brute(rows)
    assert sum(w[2] for w in want) > 100
    for size in (1 << 30, 20_000):
        assert got(remove_repeats(frame(spark, rows), block_bytes=size)) == want


def test_every_alignment_shares_an_anchor(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(i % 13 + rng.randrange(3) * 13)] + passage + [f"z{i}"] * (i % 3)), None, None, 0) for i in range(60)]
    out = got(remove_repeats(frame(spark, rows), block_bytes=300))
    assert out == brute(rows)
    assert sum(r[2] for r in out) == 59 * 20


def test_repeats_within_a_document_nulls_and_empty(spark):
    loop = " ".join(str(i % 5) for i in range(60))
    rows = [(5, loop, None, None, 0), (None, loop, None, None, 0), (None, None, None, None, 0), (6, loop, None, None, 0), (6, loop, None, None, 0), (7, "é" * 3, None, None, 0)]
    df = frame(spark, rows).selectExpr("*", "1 AS block", "2 AS kind", "3 AS n_words")
    assert got(remove_repeats(df)) == brute(rows)
    assert remove_repeats(frame(spark, [])).count() == 0


def test_digest_is_that_of_the_text(spark):
    df = frame(spark, corpus(5, 40))
    text = {r.doc_id: sha(r.kept_text) for r in remove_repeats(df).collect()}
    assert text == {r.doc_id: r.kept_sha256 for r in remove_repeats(df, digest=True).collect()}


def test_many_rows_without_id_are_spread(spark):
    rows = [(None, " ".join(f"t{i % 40}w{j}" for j in range(40)), None, None, 0) for i in range(400)] + [(3, " ".join(f"t7w{j}" for j in range(40)), None, None, 0)]
    out = remove_repeats(frame(spark, rows), block_bytes=5000).collect()
    assert len(out) == 401 and sum(r.n_removed == 40 for r in out) == 361
    assert [r.n_removed for r in out if r.doc_id == 3] == [0]


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long, None, None, 0), (2, "x " + " ".join(f"w{i}" for i in range(100_000, 100_030)) + " y", None, None, 0)]
    assert [(r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(frame(spark, rows)).orderBy("doc_id").collect()] == [(1, 400_000, 0), (2, 32, 30)]
