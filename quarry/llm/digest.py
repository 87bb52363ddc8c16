"""Improbable-feature digests of documents.

Every window of 32 bytes has an entropy, kept exactly (in fixed point) while the
window slides. Rarity is how far it lies from that of ordinary prose; windows of
almost no entropy, long runs of a few bytes, say nothing and rank last. The rarest
window of each 32 consecutive ones, leftmost on ties, is a feature. Texts below
1024 bytes have features of 8-byte windows, the rarest of each 4, too, and those
below 256 only these. A feature's hash sets 5 bits of a 2048-bit Bloom filter, and
after 160 features the next filter of the chain is opened. Two digests are compared
filter by filter: bits in common, normalised between the overlap that chance gives
and the most there can be, for each filter of the shorter chain its best partner among
those at most REACH places off (some 1.3 MB of text).

The ranking is fixed, so equal texts have equal fingerprints in any corpus. Texts
are met with their neighbours in blocks of doc_id ranges, into which the last
document of the block below is copied, so each text is shuffled once.

Defined cases: a null text is empty; the empty fingerprint equals itself (1) and
nothing else (0); a text shorter than the short window is one feature; rows without doc_id
come before all others in descending order; rows of one doc_id follow each other
by text; a single document is its own next; an empty table gives an empty result;
other columns are ignored; of equally rare windows the leftmost is taken. A worker takes
texts in pieces of 1 MB, or one text if it is longer, beside its block's: about 150
times its bytes of memory.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import block_of, cut_points, in_order
from quarry.llm.common import _byte_hash, _powers, mix

#: Bytes of a window, consecutive windows of which one is taken, bits of its entropy in ordinary prose, and below which it says nothing.
LONG, SHORT = (32, 32, 3.55, 1.2), (8, 4, 2.5, 0.8)
#: Texts of fewer bytes have short windows too, or only.
TOO, ONLY = 1024, 256
BITS, FEATURES, HASHES = 2048, 160, 5
CUT = 0.25
#: How far apart in their chains filters may be that are compared.
REACH = 512
_ONE = 1 << 16
PIECE = 1 << 20
LAST = (1 << 63) - 1


def _rarity(raw: np.ndarray, kind: tuple) -> np.ndarray:
    """Of the window from each byte on, in fixed point; windows cut short at the end are missing."""
    w, _, typical, least = kind
    n = len(raw)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, w):
        same = (raw[:-d] == raw[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    c = np.arange(1, w + 1, dtype=float)
    step = np.concatenate([[0], np.rint((c * np.log2(c) - (c - 1) * np.log2(np.maximum(c - 1, 1))) * _ONE)]).astype(np.int64)
    into, out = np.cumsum(step[behind]), np.concatenate([[0], np.cumsum(step[ahead])])
    total = into[w - 1 :] - out[: n - w + 1]
    top = np.log2(w)
    usual, dull = int((top - typical) * w * _ONE), int((top - least) * w * _ONE)
    return np.where(total > dull, 0, np.abs(total - usual))


def _lowest(keys: np.ndarray, group: int) -> np.ndarray:
    """Least of each group of consecutive keys."""
    span = 1
    while span < group:
        step = min(span, group - span)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        span += step
    return keys


def _places(rarity: np.ndarray, group: int) -> np.ndarray:
    """The rarest of each group of consecutive windows, leftmost on ties."""
    at = np.arange(len(rarity), dtype=np.int64)
    low = _lowest(((np.int64(1 << 38) - rarity) << np.int64(24)) + (at & 0xFFFFFF), min(len(rarity), group))
    first = np.arange(len(low), dtype=np.int64)
    return np.unique(first + (((low & 0xFFFFFF) - first) & 0xFFFFFF))  # places are kept modulo 2^24; groups are far shorter


def feature_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's features, those of one window length in order of place."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    p, inv = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_hash(False, 9)[raw] * p[:n])])
    long = _rarity(raw, LONG) if n >= LONG[0] else None
    out, at = [], 0
    for t in texts:
        size, own = len(t), []
        if size >= LONG[0] and size >= ONLY:
            place = _places(long[at : at + size - LONG[0] + 1], LONG[1]) + at
            own.append(mix((sums[place + LONG[0]] - sums[place]) * inv[place]))
        if SHORT[0] <= size < TOO:
            place = _places(_rarity(raw[at : at + size], SHORT), SHORT[1]) + at
            own.append(mix((sums[place + SHORT[0]] - sums[place]) * inv[place] + np.uint64(1)))
        if 0 < size < SHORT[0]:
            own.append(mix((sums[at + size : at + size + 1] - sums[at : at + 1]) * inv[at : at + 1]))
        out.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
        at += size
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chain of Bloom filters, one row of 256 bytes each."""
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    chain = np.zeros((-(-len(h) // FEATURES), BITS // 8), np.uint8)
    for j in range(HASHES):
        bit = ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(chain, (np.arange(len(h)) // FEATURES, bit // 8), (1 << (bit % 8)).astype(np.uint8))
    return chain


def fingerprint(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain's filters of the best normalised overlap, with filters of the other at most REACH places off: linear in the chains."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    # A last filter that is hardly filled tells little; the mean weighs filters by their bits.
    wide_a, wide_b = a.view(np.uint64), b.view(np.uint64)
    of_a, of_b = (np.bitwise_count(x).sum(axis=1).astype(float) for x in (wide_a, wide_b))
    best = np.empty(len(a))
    for i in range(len(a)):
        near = slice(max(0, min(i, len(b)) - REACH), i + REACH + 1)
        most = np.minimum(of_a[i], of_b[near])
        chance = of_a[i] * of_b[near] / BITS
        low = chance + np.maximum(CUT * (most - chance), 3 * np.sqrt(chance))
        common = np.bitwise_count(wide_a[i] & wide_b[near]).sum(axis=1)
        best[i] = ((common - low) / np.maximum(most - low, 1e-9)).max()
    return float(np.clip(np.average(np.clip(best, 0, 1), weights=of_a), 0, 1))


def _chains(texts: list[bytes]) -> list[np.ndarray]:
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > PIECE:
            out += map(filters, feature_hashes(part))
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + [filters(h) for h in (feature_hashes(part) if part else [])]


def _block(table: pa.Table) -> pa.Table:
    table = in_order(table)
    guests = table.column("guest").to_pylist()
    texts = [t or "" for t in table.column("text").to_pylist()]
    own = [i for i, g in enumerate(guests) if not g]
    copied = [i for i, g in enumerate(guests) if g]
    before = copied[-1] if copied else own[-1]
    follow = [before, *own[:-1]]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(own, follow)]
    coded = [e.encode() for e in edited]
    chains = dict(zip([*own, before], _chains([texts[i].encode() for i in [*own, before]])))
    altered = _chains(coded)
    ids = table.column("doc_id").to_pylist()
    return pa.table({
        "doc_id": pa.array([ids[i] for i in own], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in coded]),
        "fingerprint": pa.array([fingerprint(chains[i]) for i in own]),
        "edited_fingerprint": pa.array([fingerprint(c) for c in altered]),
        "near_edited": pa.array([likeness(chains[i], c) for i, c in zip(own, altered)]),
        "near_next": pa.array([likeness(chains[i], chains[j]) for i, j in zip(own, follow)]),
    })


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text of docs (doc_id, text) and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.col("text").cast("string").alias("text"))
    cuts = cut_points(rows.filter("not none"))
    rows = rows.withColumn("block", block_of(F.col("doc_id"), cuts))
    # One number a block.
    heads = {r.block: r.top for r in rows.groupBy("block").agg(F.max("doc_id").alias("top")).toLocalIterator()}
    order = sorted(heads)
    if len(order) > 1:
        n = len(cuts) + 1
        top = F.split(F.lit(",".join(str(heads.get(i, LAST)) for i in range(n))), ",").cast("array<bigint>")
        to = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
        then = F.split(F.lit(",".join(str(to.get(i, 0)) for i in range(n))), ",").cast("array<int>")
        copied = F.when(F.col("doc_id") == F.get(top, F.col("block")), F.struct(F.get(then, F.col("block")).alias("block"), F.lit(True).alias("guest")))
        at = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")), copied), lambda x: x.isNotNull())
        rows = rows.withColumn("at", F.explode(at)).select("at.block", "at.guest", "doc_id", "none", "text")
    else:
        rows = rows.select("block", F.lit(False).alias("guest"), "doc_id", "none", "text")
    rows = rows.select("block", "guest", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text")
    return rows.groupBy("block").applyInArrow(_block, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
