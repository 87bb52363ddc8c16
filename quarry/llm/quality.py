"""Quality classifier: Naive Bayes support vectors.

Features are indicators of the byte trigrams of the raw text (hashed into a table)
and of how much it repeats itself. Each indicator is scaled by its log-count ratio
between the classes, and a linear model with hinge loss is fitted to the scaled
indicators by dual coordinate descent. A logistic curve, fitted on a quarter of the
sample that the model hadn't seen, turns the margin into a score. The sample is
about `max_train` labelled documents, chosen by hash; the labels drawn are so few
that they are broadcast, so no text is shuffled.

Defined cases: a null text is an empty one, which is scored by its repetition
indicators and the bias; with no labels, or one class only, every score is that
class's share (1 with none); several labels of a document count as their least;
labels of null doc_id or quality are left out; repeated rows score alike; an empty
table gives an empty result; other columns are ignored; a score of exactly 0.5 counts
as 1. A worker takes texts in pieces of 1 MB, or one text if it is longer: about 25
times its bytes of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Work, Words, buffers, pieces
from quarry.llm.langid import held_out

TABLE = 1 << 16
EXTRA = 16  # indicators of repetition, after the table
#: Labelled documents that the model is fitted on, about, and indices of features in all of them at most.
MAX_TRAIN, MAX_INDICES = 12_000, 1 << 25
COST, EPOCHS = 0.1, 12
PIECE = 1 << 20


def features(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted indices of each text's features."""
    words = Words(raw, offsets)
    again = np.zeros(len(words.hashes) + 1, np.int64)
    if len(words.hashes):
        again[1:-1] = words.hashes[1:] == words.hashes[:-1]
    again[words.rows[:-1]] = 0
    again = np.concatenate([[0], np.cumsum(again[:-1])])
    b = raw.astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(15))) >> np.uint32(16)
    out = []
    for i in range(len(offsets) - 1):
        c = code[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        if len(c) < 3000:
            at = np.unique(c).astype(np.int32)
        else:
            seen = np.zeros(TABLE, bool)
            seen[c] = True
            at = np.flatnonzero(seen).astype(np.int32)
        lo, hi = words.rows[i], words.rows[i + 1]
        n = hi - lo
        same = (again[hi] - again[lo]) / max(1, n)
        distinct = len(np.unique(words.hashes[lo:hi])) / max(1, n) ** 0.8
        out.append(np.concatenate([at, [TABLE + np.searchsorted([0.001, 0.02, 0.1, 0.3], same, "right"), TABLE + 5 + np.searchsorted([0.1, 0.3, 0.6, 1.0], distinct, "right"), TABLE + 10 + np.searchsorted([1, 5, 20, 60, 200], n, "right")]]).astype(np.int32))
    return out


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each indicator between label 1 and label 0."""
    sums = []
    for label in (1, 0):
        own = [r for r, v in zip(rows, y) if v == label]
        c = 1.0 + (np.bincount(np.concatenate(own), minlength=TABLE + EXTRA) if own else np.zeros(TABLE + EXTRA))
        sums.append(c / c.sum())
    return np.log(sums[0] / sums[1])


def train(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and bias that minimise hinge loss plus half their squared norm, one dual variable at a time."""
    s = np.where(y > 0, 1.0, -1.0)
    # The rarer class costs more, so that neither is drowned.
    limit = np.where(s > 0, cost * len(y) / (2 * max(1, (s > 0).sum())), cost * len(y) / (2 * max(1, (s < 0).sum())))
    w, b, alpha = np.zeros(len(r)), 0.0, np.zeros(len(y))
    norm = np.array([float((r[x] ** 2).sum()) + 1 for x in rows])
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x = rows[i]
            gradient = s[i] * (float(w[x] @ r[x]) + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * s[i]
            if step:
                w[x] += step * r[x]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) = 1 / (1 + exp(-(slope * margin + offset)))."""
    a, c = 1.0, 0.0
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), c


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each indicator and the rest, for the log odds of label 1."""
    share = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
    if len(set(y.tolist())) < 2 or min((y > 0).sum(), (y <= 0).sum()) < 4:
        return np.zeros(TABLE + EXTRA), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    apart = np.random.default_rng(4).random(len(y)) < 0.25
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.arange(len(y)) % 2 == 0
    r = ratios([x for x, q in zip(rows, apart) if not q], y[~apart])
    w, b = train([x for x, q in zip(rows, apart) if not q], y[~apart], r)
    margin = np.array([float(w[x] @ r[x]) + b for x, q in zip(rows, apart) if q])
    slope, offset = logistic(margin, y[apart])
    r = ratios(rows, y)
    w, b = train(rows, y, r)
    return slope * w * r, slope * b + offset


def _extract(batches):
    for batch in batches:
        raw, off = buffers(batch.column(2))
        for i, j in pieces(off, PIECE):
            rows = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))], ["doc_id", "label", "features"])


def _score(shared):
    def fn(batches):
        w, b = shared.value
        for batch in batches:
            raw, off = buffers(batch.column(2))
            for i, j in pieces(off, PIECE):
                rows = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                odds = np.array([float(w[x].sum()) + b for x in rows])
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return fn


def _keep(shared, text: int, threshold: float):
    def fn(batches):
        w, b = shared.value
        for batch in batches:
            raw, off = buffers(batch.column(text))
            for i, j in pieces(off, PIECE):
                rows = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                odds = np.array([float(w[x].sum()) + b for x in rows])
                yield batch.slice(i, j - i).filter(pa.array(odds >= np.log(threshold / (1 - threshold))))

    return fn


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights and bias learned from labels (doc_id, quality) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id").cast("long")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    n = usable.count()
    some = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) * F.lit(n) < F.lit(max_train * (1 << 30)).cast("long"))
    # About max_train rows of 12 bytes: the bound of this broadcast.
    work = Work(docs.sparkSession, "quality")
    drawn = work.save(docs.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text").mapInArrow(_extract, "doc_id long, label int, features array<int>"), "sample")
    # Sizes first: those documents come to the driver, in order of hash, that hold MAX_INDICES in all.
    order = F.xxhash64("doc_id", F.lit(31))
    sizes = drawn.select(order.alias("at"), F.size("features").alias("n")).toArrow().sort_by("at")
    fit_in = np.searchsorted(np.cumsum(sizes.column("n").to_numpy().astype(np.int64)), MAX_INDICES, "right")
    if fit_in < sizes.num_rows:
        drawn = drawn.filter(order < F.lit(sizes.column("at")[int(fit_in)].as_py()))
    drawn = drawn.toArrow().sort_by("doc_id")
    flat = drawn.column("features").combine_chunks() if drawn.num_rows else None
    rows = [flat[i].values.to_numpy() for i in range(drawn.num_rows)]
    model = fit(rows, drawn.column("label").to_numpy().astype(np.int64) if drawn.num_rows else np.zeros(0, np.int64))
    del drawn, flat, rows
    pa.default_memory_pool().release_unused()  # of the driver, which keeps the session
    work.drop("sample")
    return model


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text); learns from labels (doc_id, quality)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_train))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_train))
    return docs.mapInArrow(_keep(shared, docs.columns.index("text"), threshold), docs.schema)
