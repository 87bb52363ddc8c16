"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a fractional number of copies: its source's target over its
source's size. The whole part is taken; the fractions are rounded in pairs.
A pair moves mass from one to the other, at random and in either direction with
the odds that keep each expectation, until one fraction is 0 or 1; mass is
measured in words, so the words a source takes stay exact up to its last
document. Documents meet within buckets of bounded size; what each bucket leaves
open, one document, goes to the next level, where buckets are grouped again: a
reduction tree of depth log(documents) / log(bucket). Each bucket also sends up
settled documents of each power of two of words, rounded up and rounded down: so many
that the source's buckets send about as many of each as a bucket holds. A source that is in one bucket ends there, whatever the size of
the others: its last open document is rounded by its fraction, at random, and what
that misses is made up for by settled documents of that bucket, its own or sent up, drawn at random:
rounded up, as many words as it is too much go down, and the other way round. That
keeps the words near the target and, since both ways weigh alike, each document's
expected copies (a source's documents share one fraction). Only if too few documents
are there to make up for it, by more than NEAR of the target, the other whole number
is taken if that misses less.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; a source without words has target 0 and takes nothing; rows that repeat a
doc_id are documents of their own; an empty table gives an empty result; other
columns are ignored. Documents of one size and id are ties of no consequence: equal rows
are interchangeable. Only the number of words of a text is used, which is counted where
it is read, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import n_words, save

BUCKET = 4096
#: Settled documents of each power of two of words and each direction that a bucket sends up at least.
SPARE = 2
#: Share of a source's target that its last rounding may miss before the other whole number is tried.
NEAR = 0.01
#: A table of sources of at most so many rows is broadcast; beyond, it is joined.
BROADCAST_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per source: source_no, source, source_size, n_docs, target.

    Targets share all sizes by weight; those above cap times their source's size
    stop there and the excess is shared again by weight. Sorted by how soon they
    stop, the stopped ones are a prefix, so running sums give the final share.
    One row a source reaches the windows, never one a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(order))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_stop = Window.orderBy((F.col("limit") / F.col("w")).asc(), "source_no")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("weight", F.sum("w").over(everything))
    per = per.withColumn("share", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("weight") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("stop_no", F.row_number().over(by_stop))
    fits = F.col("share") * F.col("w") <= F.col("limit") * (1 + 1e-12)
    share = F.coalesce(F.min_by("share", F.when(fits, F.col("stop_no"))).over(everything), F.lit(float("inf")))
    target = F.when(F.col("source_size") > 0, F.least(share * F.col("w"), F.col("limit"))).otherwise(0.0)
    return per.select("source_no", "source", "source_size", "n_docs", target.alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round the fractions p of documents of these sizes, in this order. Result: 0 or 1 each, the one left open (or -1) and its fraction."""
    out = np.zeros(len(p), np.int64)
    held, mass = -1, 0.0
    for j in range(len(p)):
        q, s = float(p[j]), float(sizes[j])
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[j] = int(q > 0.5)
            continue
        if held < 0:
            held, mass = j, q
            continue
        size = float(sizes[held])
        up = min((1 - mass) * size, q * s)
        down = min(mass * size, (1 - q) * s)
        moved = up if u[j] * (up + down) < down else -down
        mass, q = mass + moved / size, q - moved / s
        held_done = mass <= 1e-12 or mass >= 1 - 1e-12
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[j] = int(q > 0.5)
            if held_done:
                out[held] = int(mass > 0.5)
                held = -1
        else:
            out[held] = int(mass > 0.5)
            held, mass = j, q
    return out, held, mass


def spare(sizes: np.ndarray, way: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Which settled documents go up: of each power of two of sizes and each way but 0, the first by order, so many at most."""
    at = np.lexsort((order, np.frexp(sizes.astype(float))[1], way))
    kind = np.stack([way[at], np.frexp(sizes[at].astype(float))[1]])
    new = np.concatenate([[True], (kind[:, 1:] != kind[:, :-1]).any(axis=0)])[: len(at)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(sizes), bool)
    out[at] = (np.arange(len(at)) - first < most) & (way[at] != 0)
    return out


def made_up(steps: np.ndarray, missed: float, order: np.ndarray) -> tuple[np.ndarray, float]:
    """Takes steps, each once or not: in this order all that still fit into what is missed, and at last the one that comes nearest, if one does. Result: 1, -1 or 0 copies more of each, and what is missed still."""
    change = np.zeros(len(steps), np.int64)
    for j in order[steps[order] * missed > 0]:
        if abs(steps[j]) <= abs(missed):
            change[j] = int(np.sign(steps[j]))
            missed -= steps[j]
    left = np.where((change == 0) & (steps != 0), np.abs(missed - steps), np.inf)
    if len(left) and left.min() < abs(missed) - 1e-9:
        j = int(np.argmin(left))
        change[j] = int(np.sign(steps[j]))
        missed -= steps[j]
    return change, missed


def _rounder(level: int, seed: int, bucket: int, carry: tuple[str, ...]):
    """Rounds a bucket. way: 0 of an open document or one without a fraction, 1 or -1 of a settled one that could go up or down."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "way", "copies", "p"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(pdf.source_no.iloc[0]), int(pdf.bucket.iloc[0])])
        u = rng.random(len(pdf) + 1)
        size, way = pdf["size"].to_numpy(), pdf["way"].to_numpy().copy()
        p = np.where(way == 0, pdf.p.to_numpy(), 0.0)
        done, held, mass = pivot(size, p, u)
        copies = pdf["copies"].to_numpy() + done
        fresh = (p > 1e-12) & (p < 1 - 1e-12)
        way[fresh] = 1 - 2 * done[fresh]
        up, q = np.zeros(len(pdf), bool), np.zeros(len(pdf))
        if held >= 0:
            way[held] = 0
        groups = int(pdf.groups.iloc[0])
        if groups > 1:
            up = spare(size, way, rng.random(len(pdf)), max(SPARE, -(-bucket // groups)))
            if held >= 0:
                up[held], q[held] = True, mass
        elif held >= 0:
            steps, order = size * way.astype(float), rng.permutation(len(pdf))
            near = int(u[-1] < mass)
            change, missed = made_up(steps, (mass - near) * float(size[held]), order)
            if abs(missed) > NEAR * float(pdf.target.iloc[0]):
                other, least = made_up(steps, (mass - 1 + near) * float(size[held]), order)
                if abs(least) < abs(missed):
                    near, change = 1 - near, other
            copies += change
            copies[held] += near
        return pd.DataFrame({"doc_id": pdf.doc_id, "source_no": pdf.source_no, "size": size, "source_size": pdf.source_size, "target": pdf.target, "n_docs": pdf.n_docs, "copies": copies, "p": q, "way": way, "up": up} | {c: pdf[c] for c in carry})

    return fn


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of docs (doc_id, text, source), and the columns to carry along."""
    own = [F.col("source").cast("string").alias("source") if c == "source" else F.col(c) for c in {"source": 0} | dict.fromkeys(carry)]
    sizes = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, n_words(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("__spread")), "mix-sizes")
    through = (*carry, "__spread")
    sources = save(source_targets(sizes, weights, cap), "mix-sources")
    n_sources, most = sources.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    side = F.broadcast(sources) if n_sources <= BROADCAST_ROWS else sources
    s, t = sizes.alias("s"), side.alias("t")
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.doc_id", "s.size", "t.source_no", "t.source_size", "t.target", "t.n_docs", *[f"s.{c}" for c in through])
    p = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    rows = rows.withColumn("p", p).withColumn("copies", F.floor("p").cast("long")).withColumn("p", F.col("p") - F.col("copies")).withColumn("way", F.lit(0))
    fields = "doc_id long, source_no int, size long, source_size long, target double, n_docs long, copies long, p double, way int, up boolean"
    fields += "".join(f", `{c}` {sizes.schema[c].dataType.simpleString()}" for c in through)
    settled, groups, level = [rows.filter("p = 0").withColumn("up", F.lit(False))], F.ceil(F.col("n_docs") / bucket), 0
    rows, left = rows.filter("p > 0"), most or 0
    while left > 0:
        key = F.pmod(F.xxhash64(F.lit(seed + level), F.col("doc_id"), F.col("size"), F.col("__spread")), groups)
        out = save(rows.withColumn("groups", groups).withColumn("bucket", key).groupBy("source_no", "bucket").applyInPandas(_rounder(level, seed, bucket, through), fields), f"mix-level{level}")
        settled.append(out.filter(~F.col("up")))
        rows = out.filter("up").drop("up")
        left = 0 if left <= bucket else -(-left // bucket)
        groups, level = F.ceil(groups / bucket), level + 1
    result = settled[0]
    for x in settled[1:]:
        result = result.unionByName(x)
    return result.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *carry)
