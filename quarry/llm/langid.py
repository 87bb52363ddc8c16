"""Language proportions of documents by multilingual mixture inference.

A text's letter trigrams (over bytes, lower-cased, anything but letters as one
space, hashed into a table) are drawn from a mixture of languages. Expectation-
maximisation estimates each language's proportion. The set of languages is chosen
by penalised likelihood: the best single language, then the next in order of
proportion as long as each raises the likelihood by more than half the logarithm
of the text's length; where even the mixture of all can't, the single one stands
without trying. The model, trigram counts of labelled documents, is fitted on at
most about `max_docs` labelled documents of each language, chosen by hash.

Defined cases: a null text, or one without a letter, is `und` with score 0; if no
document is labelled, all are `und`; ties go to the language that sorts first;
rows of null doc_id are neither held out nor learned from; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored. A worker
takes texts in pieces of 1 MB, or one text if it is longer: about 20 times its bytes of
memory, for what is inferred on is a count for each of the table's codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buffers, pieces

TABLE = 1 << 16
#: Labelled documents of a language, about, and languages, those of most documents, that the model is fitted on.
MAX_DOCS, MAX_LANGS = 3000, 256
SMOOTH = 0.1
ROUNDS = 8
PIECE = 1 << 20
#: Overlapping trigrams say the same thing about three times over.
OVERLAP = 3.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pick(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by` (doc_id and by; rows of null are left out), chosen by hash of doc_id. The values are few: a count for each is broadcast, so that no text is shuffled."""
    rows = rows.filter(F.col(by).isNotNull() & F.col("doc_id").isNotNull())
    counts = F.broadcast(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")))
    return rows.join(counts, by).filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) * F.col("_n") < F.lit(most * (1 << 30)).cast("long")).drop("_n")


_CLEAN: list[np.ndarray] = []


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Code of the trigram from each byte on; the last two are missing."""
    if not _CLEAN:
        t = np.full(256, 0x20, np.uint32)
        t[0x61:0x7B] = np.arange(0x61, 0x7B)
        t[0x80:] = np.arange(0x80, 0x100)
        _CLEAN.append(t)
    b = _CLEAN[0][raw]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code * np.uint32(0x9E3779B1)
    return (code ^ (code >> np.uint32(15))) >> np.uint32(16)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < 3000:
        return np.unique(codes, return_counts=True)
    c = np.bincount(codes, minlength=TABLE)
    at = np.flatnonzero(c)
    return at, c[at]


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pc.utf8_lower(texts))


def _count(batches):
    for batch in batches:
        raw, off = _lowered(batch.column(1))
        langs = batch.column(0).to_pylist()
        sums: dict[str, np.ndarray] = {}
        for i, lang in enumerate(langs):
            if off[i + 1] - off[i] >= 3:
                sums.setdefault(lang, np.zeros(TABLE, np.int64))
                sums[lang] += np.bincount(trigrams(raw[off[i] : off[i + 1]]), minlength=TABLE)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "code", "n"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probability of each trigram code in each: a table of fixed size."""
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text").filter("text is not null")
    # The bound of what comes to the driver: MAX_LANGS names, and as many numbers a language as the table has codes.
    known = [r.lang for r in labelled.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    if not known:
        return [], np.zeros((TABLE, 1), np.float32)
    labelled = labelled.filter(F.col("lang").isin(known))
    counts = pick(labelled, "lang", max_docs).select("lang", "text").mapInArrow(_count, "lang string, code int, n long")
    got = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique())
    table = np.zeros((TABLE, max(1, len(langs))))
    for i, lang in enumerate(langs):
        own = got[got.lang == lang]
        table[own.code.to_numpy(), i] = own.n.to_numpy()
    return langs, np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * TABLE)).astype(np.float32)


def _em(p: np.ndarray, c: np.ndarray, seg: np.ndarray, owner: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, and log likelihood against p, of documents whose trigrams (rows of p, c times each) begin at seg."""
    total = np.add.reduceat(c, seg)
    for _ in range(rounds):
        r = p * theta[owner]
        r *= (c / r.sum(axis=1))[:, None]
        theta = np.add.reduceat(r, seg, axis=0) / total[:, None]
    return theta, np.add.reduceat(c * np.log((p * theta[owner]).sum(axis=1)), seg)


def infer(docs: list[tuple[np.ndarray, np.ndarray]], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language, 0 outside the chosen set, and how sure the single best language is, for documents as trigram codes and counts (none empty)."""
    seg = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])[:-1].astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    c = np.concatenate([d[1] for d in docs]).astype(np.float64)
    lp = log_p[np.concatenate([d[0] for d in docs])].astype(np.float64)
    top = lp.max(axis=1)
    single = np.add.reduceat((lp - top[:, None]) * c[:, None], seg, axis=0)
    best = single.argmax(axis=1)
    sure = 1 / np.exp((single - single.max(axis=1, keepdims=True)) / OVERLAP).sum(axis=1)
    p = np.exp(lp - top[:, None])
    n = np.add.reduceat(c, seg)
    languages = log_p.shape[1]
    theta, full = _em(p, c, seg, owner, np.full((len(docs), languages), 1 / languages), ROUNDS)
    penalty = 0.5 * OVERLAP * np.log(n)
    out = np.zeros_like(theta)
    out[np.arange(len(docs)), best] = 1
    for i in np.flatnonzero(full - single.max(axis=1) > penalty):
        lo, hi = seg[i], seg[i + 1] if i + 1 < len(seg) else len(c)
        order = [best[i], *[j for j in np.argsort(-theta[i], kind="stable") if j != best[i]]]
        value = single[i].max()
        for k in range(2, languages + 1):
            some = order[:k]
            t, v = _em(p[lo:hi, some] + 1e-300, c[lo:hi], np.zeros(1, np.int64), np.zeros(hi - lo, np.int64), np.full((1, k), 1 / k), 2 * ROUNDS)
            if v[0] - value <= penalty[i]:
                break
            out[i], value = 0, v[0]
            out[i, some] = t[0]
    return out, sure


def _predict(langs: list[str], shared):
    def fn(batches):
        log_p = shared.value
        for batch in batches:
            raw, off = _lowered(batch.column(2))
            asis = batch.column(2).to_pylist()
            for i, j in pieces(off, PIECE):
                docs, where = [], []
                for d in range(i, j):
                    if off[d + 1] - off[d] and any(map(str.isalpha, asis[d])):
                        codes = trigrams(np.concatenate([[0x20], raw[off[d] : off[d + 1]], [0x20]]).astype(np.uint8))
                        docs.append(counted(codes))
                        where.append(d - i)
                pred, score, shares = ["und"] * (j - i), [0.0] * (j - i), [""] * (j - i)
                if docs and langs:
                    theta, sure = infer(docs, log_p)
                    for w, t, s in zip(where, theta, sure):
                        top = int(t.argmax())
                        pred[w], score[w] = langs[top], float(t[top] * s)
                        shares[w] = ",".join(f"{langs[k]}:{t[k]:.3f}" for k in np.flatnonzero(t > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(pred), pa.array(score), pa.array(shares)], ["doc_id", "held_out", "lang_pred", "score", "shares"])

    return fn


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares (chosen languages and their proportions) of each row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, log_p = fit(docs, max_docs)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(langs, shared), "doc_id long, held_out boolean, lang_pred string, score double, shares string")
