"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only.

Documents come in batches of descending doc_id, as many bytes at once as CORE_BYTES
for each core. A batch's distinct 128-bit line keys, each with the number of its
documents and the largest of them, merge-anti-join the runs: keys that are in none
become a run of level 0, those that are known only add to a key's number of
documents. When a level holds `fanout` runs, they are merged into one of the next
level, so a batch meets at most fanout * log(batches) runs, and each key is rewritten
log(batches) times. Runs are bucketed and sorted by key: only a batch's own keys are
shuffled, once.

In the end a key's run names the largest doc_id that holds it, for that came first;
lines of keys that enough documents hold go from all other documents.

Defined cases: a null or empty text is one empty line; an empty table gives an
empty result; rows of one doc_id are one document when documents are counted, and
rows without doc_id are one document that ranks below all others (as one of the least
doc_id there is, -2^63); equal rows get equal decisions; other columns are ignored by
the decisions. There are no ties: doc_ids differ. A text is worked on as a whole in
its row, in about ten times its bytes of memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WS_CHARS, Work
from quarry.sources.work import collect_garbage, delete

#: Bytes of text that a batch has for each core; runs of a level that are merged into one.
CORE_BYTES, FANOUT = 64 << 20, 2
#: What stands for no doc_id: it ranks below all others.
NO_ID = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(WS_CHARS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levels of sorted runs.

    A run is a table of keys (h1, h2) with the number n of documents of its batch that
    hold the key and the largest of them, `top`. Runs are bucketed and sorted by key,
    all alike, so a batch that is dealt by key once meets each of them by a merge of
    sorted buckets, and runs are compacted bucket by bucket: no run is ever shuffled.
    No key is in two runs.
    """

    def __init__(self, spark: SparkSession, work: Work, fanout: int = FANOUT):
        self.spark, self.work, self.fanout, self.made = spark, work, fanout, 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self._read(name).filter("not seen").drop("seen") for level in self.levels for name in level]

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, keys: DataFrame) -> str:
        """A bucketed table (h1, h2, n, top, seen) in the shared folder."""
        self.made += 1
        name = f"quarry_{uuid.uuid4().hex}"
        self.names.append(name)
        columns = keys.select("h1", "h2", "n", "top", "seen")
        columns.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.work.at}/run-{self.made}").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that are in no run."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys with seen: is the key in a run? One anti-join's merge a run, of which the rest is kept too."""
        seen = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select("h1", "h2", F.lit(True).alias(f"in{i}")), ["h1", "h2"], "left")
            seen = seen | F.coalesce(f"in{i}", F.lit(False))
        return keys.select("h1", "h2", "n", "top", seen.alias("seen"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Distinct keys (h1, h2, n, top) meet the runs; those that are new become a run. Result: those that are not, with their n."""
        name = self._write(self.marked(keys))
        self.levels[0].append(name)
        for k in range(len(self.levels) + 1):
            if k == len(self.levels) or len(self.levels[k]) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._compacted(self.levels[k]))
            self.levels[k] = []
        collect_garbage(self.spark)  # once a batch
        return self._read(name).filter("seen").select("h1", "h2", "n")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for i in range(1, self.made + 1):
            delete(self.spark, f"{self.work.at}/run-{i}")

    def _compacted(self, names: list[str]) -> str:
        """Sorted runs merged two by two. Their keys are disjoint, so a full outer merge join has each key once."""
        while len(names) > 1:
            a, b = (self._read(name).filter("not seen").alias(x) for x, name in zip("ab", names))
            both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
            merged = both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("h1", "h2", "n", "top", "seen")])
            names = [*names[2:], self._write(merged)]
        return names[0]


def _cuts(docs: DataFrame, batch_bytes: int) -> list[int]:
    """Values of doc_id that split docs (doc_id, text) into ranges of about as many rows, as many as batches of batch_bytes need."""
    n = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes)
    if n < 2:
        return []
    found = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in found})


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batch_bytes: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, th (hash of the text), pos of the lines to drop from docs (doc_id, text)."""
    spark, work = docs.sparkSession, Work(docs.sparkSession, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = _cuts(docs, batch_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism)
    th = F.xxhash64(F.col("text"))
    keys = F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    keys = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    # Batches of descending doc_id: the first that holds a key holds it in its largest doc_id.
    above = F.lit(0)
    for cut in cuts:
        above = above + F.when(F.col("doc_id") > cut, 0).otherwise(1)
    batch = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above).cast("int")
    rows = docs.select("doc_id", th.alias("th"), batch.alias("batch"), F.explode(keys).alias("x"))
    lines = work.save(rows.select("doc_id", "th", F.col("x.pos").alias("pos"), F.xxhash64("x.key").alias("h1"), F.xxhash64(F.lit(1), "x.key").alias("h2"), "batch"), "lines", "batch")
    there = sorted(r.batch for r in lines.select("batch").distinct().toLocalIterator())
    runs, again = LineRuns(spark, work, fanout), None
    for b in there:
        held = lines.filter(F.col("batch") == b).select("h1", "h2", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
        # Distinct first, with sums at both sides of the shuffle: a hot line is one row a task.
        held = held.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        seen = runs.add(held)
        again = seen if again is None else again.unionByName(seen)
    if again is None:
        return lines.select("doc_id", "th", "pos").limit(0)
    again = work.save(again.groupBy("h1", "h2").agg(F.sum("n").alias("more")), "again")
    often = None
    for run in runs.runs():
        some = run.join(again, ["h1", "h2"], "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs).select("h1", "h2", "top")
        often = some if often is None else often.unionByName(some)
    # Written first, its join with the lines has a shuffle on either side, whose hot parts Spark can split.
    often = work.save(often, "often")
    dropped = lines.join(often, ["h1", "h2"]).filter(F.coalesce("doc_id", F.lit(NO_ID)) != F.col("top"))
    dropped = work.save(dropped.select("doc_id", "th", "pos"), "dropped")
    runs.drop()
    work.keep("dropped")
    return dropped


def _marked(docs: DataFrame, min_chars: int, min_docs: int, batch_bytes: int | None) -> DataFrame:
    """docs with __kept, __n_lines, __n_dropped."""
    gone = repeated_lines(docs, min_chars, min_docs, batch_bytes).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    g = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__gone_th"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__th", F.xxhash64("text"))
    rows = rows.join(g, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__gone_th")), "left")
    rows = rows.withColumn("__lines", lines_of(F.col("text")))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.get("__lines", i))
    kept = F.when(F.col("__gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(rest, "\n"))
    dropped = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    rows = rows.withColumn("__kept", kept).withColumn("__n_lines", F.size("__lines").cast("long")).withColumn("__n_dropped", dropped)
    return rows.drop("__id", "__th", "__gone_th", "__gone", "__lines")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batch_bytes: int | None = None) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added (in place of columns of those names)."""
    names = {"__kept": "kept_text", "__n_lines": "n_lines", "__n_dropped": "n_dropped"}
    return _marked(docs, min_chars, min_docs, batch_bytes).drop(*names.values()).withColumnsRenamed(names)


def without_repeats(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batch_bytes: int | None = None) -> DataFrame:
    """docs, their columns as they were, with the lines gone from text, and n_chars of the documents that lost any; a null text stays null."""
    out = _marked(docs, min_chars, min_docs, batch_bytes)
    lost = F.col("__n_dropped") > 0
    changed = {"text": F.when(lost, F.col("__kept")).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[changed.get(c, F.col(c)) for c in docs.columns])
