import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quarry.llm.common import save
from quarry.llm.mixing import mix_sources
from quarry.llm.quality import classify
from quarry.sources import work
from tests.llm.helpers import corpus, frame
from tests.llm.test_decontam import plain_tiles, toks
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_neardup import brute as near_brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "on"]) for _ in range(3))
    line = "this line stands in many of the documents here"
    item = " ".join(word() + str(i) for i in range(20))
    docs, labels = [], []
    for i in range(200):
        body = " ".join(word() for _ in range(40))
        bad = i % 10 == 3
        if bad:
            body = " ".join(w.upper() + "!!" for w in body.split())
        if i % 10 == 5:
            body = docs[-1][1]
        if i % 10 == 7:
            body += "\n" + line
        if i % 50 == 9:
            body += " " + item
        docs.append((i, body, "xx", "abc"[i % 3], len(body)))
        labels.append((i, int(not bad), 0))
    docs += [(500, None, None, None, None), (501, "", None, "a", 0)]
    root = str(tmp_path_factory.mktemp("sf"))
    frame(spark, docs).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    bad = {i for i in range(200) if i % 10 == 3}
    assert not kept[1] & bad and kept[1] >= {i for i in range(200)} - bad
    assert kept[2] == kept[1]
    copies = {i for i in range(200) if i % 10 == 5}
    assert kept[3] & set(range(200)) == kept[2] & set(range(200)) - copies
    leaks = {9, 59, 109, 159}
    assert kept[3] - kept[4] == leaks
    text = {r.doc_id: r for r in docs.collect()}
    assert [i for i in text if "this line" in (text[i].text or "")] == [197]
    assert all(r.n_chars == len(r.text) for r in text.values() if r.text is not None)
    mixed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= kept[4] and all(1 <= r.copy <= 3 for r in mixed)
    assert sorted(map(repr, pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, mixed))


def brute_stage(name, rows, labels, items, scores):
    """doc_id: text of what a stage keeps, by plain loops over rows (doc_id, text, source); the quality stage's scores are given."""
    if name == "quality":
        return {r[0]: r[1] for r in rows if scores[r[0]] >= 0.5}
    if name == "line_dedup":
        out = {r[0]: r for r in line_brute(rows)}
        return {r[0]: out[r[0]][3] if out[r[0]][2] else r[1] for r in rows}
    if name == "near_dedup":
        parts = near_brute(rows, 5)
        return {r[0]: r[1] for r in rows if parts[r[0]][1] == r[0]}
    hit = set()
    for r in rows:
        for item in items:
            words_ = toks(item)
            tiles = plain_tiles(words_, toks(r[1]))
            if len(words_) >= 4 and sum(t[0] for t in tiles) >= 0.5 * len(words_):
                hit.add(r[0])
    return {r[0]: r[1] for r in rows if r[0] not in hit}


def test_each_stage_like_brute_force(spark, tmp_path):
    import random

    rng = random.Random(11)
    items = [" ".join(f"b{rng.randrange(400)}" for _ in range(18)) for _ in range(3)]
    docs = [r for r in corpus(13, 70) if len(r[1] or "") < 3000]
    for i in range(12):
        w = items[i % 3].split()
        parts = [w[:9], w[9:]] if i % 2 else [w[9:], w[:9]]
        docs.append((2000 + i, f"start {i} " + " mid ".join(map(" ".join, parts[: 1 + i % 3])) + f" end {i * 7}", "xx", "hot", 0))
    for i in range(20):
        docs.append((3000 + i, " ".join(rng.choice(["BUY!!", "NOW$$", "###"]) + str(rng.randrange(99)) for _ in range(30)), "xx", "a", 0))
    labels = [(r[0], int(r[0] < 3000), 0) for r in docs]
    root = str(tmp_path)
    frame(spark, docs).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    scores = {r.doc_id: r.score for r in classify(frame(spark, docs), spark.read.parquet(f"{root}/labels.parquet")).collect()}
    df, rows = spark.read.parquet(f"{root}/documents.parquet"), docs
    for name, stage in pipeline.STAGES[:-1]:
        want = brute_stage(name, rows, labels, items, scores)
        df = save(stage(spark, df, root), name)
        got = {r.doc_id: r for r in df.collect()}
        assert {i: r.text for i, r in got.items()} == want, name
        assert len(want) < len(rows) or name == "line_dedup"
        rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got.values()]
    mixed = pipeline.STAGES[-1][1](spark, df, root).collect()
    copies = {r.doc_id: r.copies for r in mix_sources(df).collect()}
    assert sorted((r.doc_id, r.copy) for r in mixed) == sorted((i, c) for i, n in copies.items() for c in range(1, n + 1))


def test_nulls_repeats_and_empty_side_tables(spark, tmp_path):
    """Rows that repeat a doc_id with other texts, rows without id, and empty labels and benchmark: every row that is kept keeps its own text."""
    root = str(tmp_path)
    docs = [(1, "alpha beta gamma delta epsilon", "x", "a", 0), (1, "one two three four five six seven", "x", "a", 0), (None, "no id here at all", None, None, 0), (None, None, None, None, None), (2, "", "x", "a", 0), (3, "zeta eta theta iota", "x", "b", 0)] + [(4, "the same row again", "x", "b", 0)] * 3
    frame(spark, docs).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    out = pipeline.run(spark, root).collect()
    there = {(r[0], r[1]) for r in docs}
    assert out and {(r.doc_id, r.text) for r in out} <= there
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert abs(sum(taken.values()) - sum(len((r[1] or "").split()) for r in docs)) <= 14


def test_empty_and_clashing(spark, sf_dir):
    for name, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), sf_dir).count() == 0
        clash = frame(spark, [(1, "a few words here", "xx", "a", 16)]).withColumns({c: F.lit(1) for c in ("score", "n_lines", "kept", "size", "label", "copies")})
        out = stage(spark, clash, sf_dir)
        assert out.columns[: len(clash.columns)] == clash.columns and out.count() >= 1


def test_driver_gives_back_native_memory(spark, monkeypatch):
    """Freed memory outside the heap goes back whenever a table is saved or dropped, not only when a run is over; a JVM without the command does no harm."""
    said, release = [], work.release_native
    monkeypatch.setattr(work, "release_native", lambda s: said.append(release(s)) or said[-1])
    tables = work.Work(spark, "some")
    assert tables.save(spark.range(5), "a").count() == 5 and len(said) == 1
    tables.drop("a")
    assert len(said) == 2 and all(x == "" or x.startswith("Trim native heap") for x in said)
    if shutil.which("jcmd") and "System.trim_native_heap" in subprocess.run(["jcmd", str(spark.sparkContext._jvm.ProcessHandle.current().pid()), "help"], capture_output=True, text=True).stdout:
        assert all(said)
