"""URL filters by a cascade of Bloom filters; DataFrame functions only.

Keys are `host/path-prefix` strings. Level 1 encodes the listed keys; level 2 the
keys of the corpus that level 1 takes for listed though they are not; level 3 the
listed keys that level 2 takes; and so on until a level errs on nothing. Over the
corpus's complete key universe membership is then exact: a key is listed if the
first level that lacks it is an even one (counting from 1). Lookups are bit tests
against arrays held as scalars, without a join.

Level 1 has a false-positive rate of about listed / (sqrt(2) * universe), the
others 1/2, which keeps the sum of all levels near its least: it grows with the
list and the logarithm of the universe. A list whose filters would be beyond
MAX_FILTER_BYTES is dealt by key hash into as many cascades as keep each within that,
and pages' keys pass them one after the other, each a scan with bit tests of its own.

Defined cases: a url that is null or has no `://` has empty host and path and no
rule; an empty table gives an empty result; repeated rows are judged alike; other
columns are ignored. Of rules that fit the one of most characters decides; there are no
ties, for two of one length and page are the same. A url is worked on in its row,
whatever its length: a candidate key for each of its host's labels and each length of
rules' paths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import save
from quarry.llm.linededup import LOWER, UPPER

MAX_FILTER_BYTES = 32 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1), "?", 1)).otherwise("")
    host = F.coalesce(F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.substring(rest, F.char_length(F.substring_index(rest, "/", 1)) + 1, 2_000_000_000), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that could fit a page, longest first: each host suffix with each path prefix of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)]), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((F.char_length(s) + F.char_length(p)).alias("n"), F.char_length(s).alias("h"), F.concat(s, p).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sort_array(pairs, False), lambda x: x["key"]))


class Level:
    """One Bloom filter: bits as an array of longs, which Spark makes and hands to the plan as a scalar."""

    def __init__(self, keys: DataFrame, n: int, rate: float, number: int):
        self.n_bits, self.hashes, self.number = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(rate))), number
        at = keys.select(F.explode(F.array(*self._positions(F.col("key")))).alias("at"))
        some = at.groupBy(F.floor(F.col("at") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
        whole = keys.sparkSession.range(self.n_bits // 64).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
        # One row, no larger than a cascade may be.
        words = whole.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("w")).select(F.transform("w", lambda x: x["bits"]).alias("words"))
        self.words = save(words, "cascade-level").scalar()

    def _positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(1000 * self.number + i), key), F.lit(self.n_bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self._positions(key):
            found = found & (F.bit_get(F.get(self.words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


class Cascade:
    """Exact membership of listed keys over a universe; listed and universe: DataFrames of distinct `key`. Keys are dealt by hash to as many shards, each a cascade, as keep the filters of one within max_bytes."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES):
        self.yes = save(listed.select("key").distinct(), "cascade-yes")
        self.no = save(universe.select("key").distinct().join(self.yes, "key", "left_anti"), "cascade-no")
        n_yes, n_no = self.yes.count(), self.no.count()
        self.rate = min(0.5, max(1e-9, n_yes / (math.sqrt(2) * max(n_no, 1))))
        self.shards = max(1, math.ceil(n_yes * -math.log(self.rate) / math.log(2) ** 2 / 8 / max_bytes))

    def _of(self, shard: int, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(77), key), F.lit(self.shards)) == shard if self.shards > 1 else F.lit(True)

    def levels(self, shard: int) -> list[Level]:
        inside, outside = (x.filter(self._of(shard, F.col("key"))) for x in (self.yes, self.no))
        levels: list[Level] = []
        while n := inside.count():
            level = Level(inside, n, 0.5 if levels else self.rate, len(levels) + 1)
            levels.append(level)
            inside, outside = save(outside.filter(level.has(F.col("key"))), "cascade-wrong"), inside
        return levels

    def first(self, rows: DataFrame, keys: str, name: str) -> DataFrame:
        """rows with the first of an array of keys that is listed, or null.

        Keys are tested as rows of their own, since a filter is a scalar of the plan, which
        lambdas can't see; rows of one page lie together, so that their sum is made before
        it is shuffled.
        """
        columns = rows.columns
        for shard in range(self.shards):
            one = rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.posexplode_outer(keys).alias("__pos", "__key"))
            hit = F.when(self.member(shard)(F.col("__key")), F.col("__pos"))
            best = [F.min(hit).alias("__hit"), *[F.first(c).alias(c) for c in rows.columns]]
            rows = one.groupBy("__row").agg(*best).drop("__row")
            if "__at" in rows.columns:
                rows = rows.withColumn("__hit", F.least("__hit", "__at")).drop("__at")
            rows = rows.withColumnRenamed("__hit", "__at")
            if self.shards > 1:
                rows = save(rows, "cascade-pass")
        return rows.select(*columns, F.when(F.col("__at").isNotNull(), F.get(keys, F.col("__at"))).alias(name))

    def member(self, shard: int) -> Callable[[Column], Column]:
        """Tells of a key of the universe whether it is listed, and of this shard. Without a join."""
        levels = self.levels(shard)

        def test(key: Column) -> Column:
            answer = F.lit(len(levels) % 2 == 1)
            for i in range(len(levels) - 1, -1, -1):
                answer = F.when(levels[i].has(key), answer).otherwise(F.lit(i % 2 == 1))
            return self._of(shard, key) & answer & key.isNotNull()

        return test


def filter_urls(pages: DataFrame, allow: list[str], block: list[str], max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict. Rules are `host/path`; the longest that fits decides, and a page that fits none of the listed keys is allowed."""
    spark = pages.sparkSession
    lengths = [len(r) - r.index("/") for r in [*allow, *block]]
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = save(rows.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    cascade = lambda rules: Cascade(spark.createDataFrame([(r,) for r in rules], "key string"), universe, max_bytes)
    rows = cascade([*allow, *block]).first(rows, "keys", "rule")
    rows = rows.withColumn("own", F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.array().cast("array<string>")))
    rows = cascade(block).first(rows, "own", "bad")
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("bad").isNotNull(), "block").otherwise("allow").alias("verdict"))
