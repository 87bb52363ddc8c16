"""Substring dedup with difference-cover anchors.

A window is 20 words. The set {0, 1, 3, 9} modulo 13 is a difference cover: for any
two windows there is a shift of 0 to 12 words that takes both to cover positions,
and 8 words from there still lie within both windows. So only the 8-word anchors
at cover positions, 4 in 13, are hashed and sent out; a window can repeat only if
one of its anchors does. Windows next to a repeated anchor, and only those, are
then hashed whole (96 bits) and sent out, and the first in order stays.

Documents are worked on in blocks (ranges of ascending doc_id). Each block sends
the distinct hashes of a range as one packed row, so a hash that every document
holds is one entry a block, and gets back one bit an entry. What repeats within a
block is settled there: its first occurrence stands for the block, and a lower
block wins.

Defined cases: a null text has no words; a document of fewer than 20 words loses
none; rows that repeat a doc_id are ordered by text, and each counts as a document of
its own; rows without one come last, by block, which a hash of their text names, and
then by text; an empty table gives
an empty result; other columns are ignored. There are no ties but equal texts of one
doc_id, which are interchangeable. A text is in one block, with about 40 times its
bytes of memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import BLOCK_BYTES, block_of, cut_points, in_order
from quarry.llm.common import Words, _Q, buffers, mix

PERIOD, COVER, ANCHOR, WINDOW = 13, (0, 1, 3, 9), 8, 20
_Q2 = np.uint64(0xA24BAED4963EE407)


def parts_for(blocks: int) -> int:
    """Ranges of hashes: a power of two near the number of blocks, and from 2^20 blocks on a sixteenth of it, so that a range's bytes stay bounded and a block's rows few."""
    size = (blocks - 1).bit_length()
    return 1 << max(3, min(16, size), size - 4)


class Block:
    """Words, anchors and windows of a block's documents, in order."""

    def __init__(self, table: pa.Table):
        self.table = in_order(table)
        self.raw, off = buffers(self.table.column("text"))
        self.words = Words(self.raw, off)
        self.rows, n = self.words.rows, len(self.words.hashes)
        counts = np.diff(self.rows)
        self.place = np.arange(n) - np.repeat(self.rows[:-1], counts)  # in its document
        g, ok = self.words.grams(ANCHOR)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.at = np.flatnonzero(ok & cover[self.place % PERIOD])
        self.anchors, self.which, seen = np.unique(g[self.at], return_inverse=True, return_counts=True)
        self.twice = seen > 1

    def repeats(self, bits: np.ndarray) -> np.ndarray:
        """Starts of the windows next to an anchor that repeats; bits: of the distinct anchors, in other blocks."""
        n = len(self.words.hashes)
        hit = np.zeros(n + PERIOD + 1, np.int64)
        hit[self.at] = (self.twice | bits)[self.which]
        upto = np.concatenate([[0], np.cumsum(hit)])
        near = upto[PERIOD : PERIOD + n] - upto[:n] > 0
        left = np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(n)
        return np.flatnonzero(near & (left >= WINDOW))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in order of hash: hash, second hash, first start; and which of them each start has."""
        h = self.words.hashes
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for j in range(WINDOW):
            word = h[starts + j]
            one, two = one * _Q + word, two * _Q2 + word
        one, two = mix(one), (mix(two) >> np.uint64(32)).astype(np.uint32)
        distinct, first, which = np.unique(one, return_index=True, return_inverse=True)
        return distinct, two[first], starts[first], which


def _slices(hashes: np.ndarray, parts: int):
    shift = np.uint64(64 - (parts.bit_length() - 1))
    there, first = np.unique(hashes >> shift, return_index=True)
    return list(zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(hashes)]))


def _packed(block: int, rows: list[tuple[int, bytes]], kind: int) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "kind": pa.array([kind] * len(rows), pa.int32()), "part": pa.array([p for p, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def _send_anchors(parts: int):
    def fn(table: pa.Table) -> pa.Table:
        b = Block(table)
        six = b.anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        return _packed(table.column("block")[0].as_py(), [(p, six[i:j].tobytes()) for p, i, j in _slices(b.anchors, parts)], 0)

    return fn


def _meet_anchors(table: pa.Table) -> pa.Table:
    """Bits of a part's entries: is the anchor in several blocks?"""
    out, data = [], table.column("data").to_pylist()
    counts = [len(d) // 6 for d in data]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    h = wide.view("<u8").reshape(-1)
    _, which, seen = np.unique(h, return_inverse=True, return_counts=True)
    several = (seen > 1)[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = [np.packbits(several[ends[i] : ends[i + 1]]).tobytes() for i in range(len(data))]
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "part": table.column("part"), "data": pa.array(out, pa.binary())})


def _bits(told: pa.Table, kind: int, hashes: np.ndarray, parts: int) -> np.ndarray:
    of = {p: d for k, p, d in zip(told.column("kind").to_pylist(), told.column("part").to_pylist(), told.column("data").to_pylist()) if k == kind}
    bits = np.zeros(len(hashes), bool)
    for p, i, j in _slices(hashes, parts):
        bits[i:j] = np.unpackbits(np.frombuffer(of[p], np.uint8), count=j - i)
    return bits


def _send_windows(parts: int):
    def fn(table: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(table)
        one, two, _, _ = b.windows(b.repeats(_bits(told, 0, b.anchors, parts)))
        rows = [(p, one[i:j].tobytes() + two[i:j].tobytes()) for p, i, j in _slices(one, parts)]
        return _packed(table.column("block")[0].as_py(), rows, 1)

    return fn


def _meet_windows(table: pa.Table) -> pa.Table:
    """Bits of a part's entries: does a lower block hold the window too?"""
    data, blocks = table.column("data").to_pylist(), table.column("block").to_numpy()
    counts = [len(d) // 12 for d in data]
    one = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, counts)])
    two = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for d, n in zip(data, counts)])
    order = np.lexsort((np.repeat(blocks, counts), two, one))
    later = np.zeros(len(one), bool)
    later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = [np.packbits(later[ends[i] : ends[i + 1]]).tobytes() for i in range(len(data))]
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "part": table.column("part"), "data": pa.array(out, pa.binary())})


def _remove(parts: int):
    def fn(table: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(table)
        starts = b.repeats(_bits(told, 0, b.anchors, parts))
        one, _, first, which = b.windows(starts)
        later = _bits(told, 1, one, parts)[which] | (first[which] != starts)
        n = len(b.words.hashes)
        edge = np.zeros(n + 1, np.int64)
        bad = starts[later]
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + WINDOW, -1)
        gone = np.cumsum(edge[:n]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[b.rows[1:]] - before[b.rows[:-1]]
        raw, texts = b.raw.tobytes(), []
        begin, end = b.words.starts, b.words.ends
        for i in range(len(removed)):
            lo, hi = int(b.rows[i]), int(b.rows[i + 1])
            if lo == hi:
                texts.append(b"")
            elif not removed[i]:
                texts.append(b" ".join(raw[begin[lo] : end[hi - 1]].split()))
            else:
                runs = np.flatnonzero(np.diff(np.concatenate([[True], gone[lo:hi], [True]]).astype(np.int8)))
                texts.append(b" ".join(b" ".join(raw[begin[lo + s] : end[lo + e - 1]].split()) for s, e in zip(runs[::2], runs[1::2])))
        return pa.table({"doc_id": b.table.column("doc_id"), "n_words": pa.array(np.diff(b.rows)), "n_removed": pa.array(removed), "kept_text": pa.array([t.decode() for t in texts], pa.string())})

    return fn


def _digest(fn):
    def short(table: pa.Table, told: pa.Table) -> pa.Table:
        out = fn(table, told)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in out.column("kept_text").to_pylist()]
        return out.drop_columns("kept_text").append_column("kept_sha256", pa.array(sha, pa.string()))

    return short


def remove_repeats(docs: DataFrame, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or its kept_sha256, which is made where the text is) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = cut_points(rows, block_bytes)
    # Rows without doc_id come last, in blocks by hash of their text.
    none = rows.filter("doc_id is null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    more = max(1, -(-none // block_bytes))
    parts = parts_for(len(cuts) + more)
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(more)).cast("int")).otherwise(0)
    blocks = rows.withColumn("block", block_of(F.col("doc_id"), cuts) + place).select("block", "doc_id", "text")
    packed = "block int, kind int, part int, data binary"
    anchors = blocks.groupBy("block").applyInArrow(_send_anchors(parts), packed)
    known = anchors.groupBy("part").applyInArrow(_meet_anchors, packed)
    windows = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_windows(parts), packed)
    firsts = windows.groupBy("part").applyInArrow(_meet_windows, packed)
    fn = _digest(_remove(parts)) if digest else _remove(parts)
    last = "kept_sha256 string" if digest else "kept_text string"
    return blocks.groupBy("block").cogroup(known.unionByName(firsts).groupBy("block")).applyInArrow(fn, f"doc_id long, n_words long, n_removed long, {last}")
