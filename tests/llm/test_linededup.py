import pytest
from pyspark.sql import functions as F

from quarry.llm.common import Work
from quarry.llm.linededup import LineRuns, dedup_lines, repeated_lines, without_repeats
from tests.llm.helpers import corpus, frame

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WS).translate(LOW)
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault(key(line), set()).add(r[0])
    rank = lambda i: (i is not None, i if i is not None else 0)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)], key=rank) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()], key=repr)


def test_like_brute_force(spark):
    rows = corpus(1)
    assert got(dedup_lines(frame(spark, rows))) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    line = "a line that is long enough to count"
    rows = [(None, line, None, None, 1), (1, line, "x", "s", 1), (1, line, "x", "s", 1), (2, f"{line}\nÉ {line.upper()}", "x", "s", 1), (2, line.upper() + " ", "x", "s", 1)]
    df = frame(spark, rows).withColumn("n_lines", F.lit(7)).withColumn("key", F.lit("k")).withColumn("pos", F.lit(0))
    out = dedup_lines(df)
    assert got(out) == brute(rows)
    assert {"key", "pos", "lang"} <= set(out.columns)
    assert without_repeats(df).columns == df.columns


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("fanout", [2, 3])
def test_many_batches_and_deep_levels(spark, monkeypatch, fanout):
    """Nine batches and more give what one gives."""
    import quarry.llm.linededup as m

    rows = corpus(2, 150)[:-1] + [(None, "a line that nobody has with an id\n" * 2, None, None, 0)]
    size = sum(len((r[1] or "").encode()) for r in rows)
    made, add = [], LineRuns.add
    monkeypatch.setattr(LineRuns, "add", lambda self, keys: (add(self, keys), made.append([len(x) for x in self.levels]))[0])
    monkeypatch.setattr(m, "FANOUT", fanout)
    many = repeated_lines(frame(spark, rows), batch_bytes=size // 11, fanout=fanout)
    assert len(made) >= 9 and len(made[-1]) >= 3
    one = repeated_lines(frame(spark, rows), batch_bytes=1 << 40)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect())) != []
    assert got(dedup_lines(frame(spark, rows), batch_bytes=size // 11)) == brute(rows)


def keys(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("h1"), (-F.col("id")).alias("h2"), F.lit(1).cast("long").alias("n"), F.col("id").alias("top"))


def test_runs_are_compacted_and_keep_what_was_seen(spark):
    store = LineRuns(spark, Work(spark, "runs"), fanout=2)
    for i in range(5):
        assert store.unseen(keys(spark, i * 10, i * 10 + 15)).count() == (15 if i == 0 else 10)
        assert store.add(keys(spark, i * 10, i * 10 + 15)).count() == (0 if i == 0 else 5)
    assert len(store.runs()) == 2 and [len(x) for x in store.levels] == [1, 0, 1]
    assert store.unseen(keys(spark, 0, 60)).count() == 5
    store.drop()


def test_no_run_is_shuffled(spark):
    store = LineRuns(spark, Work(spark, "runs"), fanout=4)
    for i in range(3):
        store.add(keys(spark, i * 10, i * 10 + 15))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "false")):
            spark.conf.set(c, v)
        held = keys(spark, 0, 60).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        plan = store.marked(held)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3
        a, b = store.runs()[:2]
        merged = a.alias("a").join(b.alias("b"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
        store.drop()


def test_a_very_long_text(spark):
    line = "a line that stands in three documents"
    rows = [(i, f"{line}\n" + "word " * n + "\n" + "\n".join(f"line {j} of document {i} alone" for j in range(m)), None, None, 0) for i, (n, m) in enumerate([(2_000_000, 1), (1, 100_000), (1, 1)])]
    assert got(dedup_lines(frame(spark, rows))) == brute(rows)
