"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. Documents and benchmark items
that share seeds of 4 words are joined on them; a pair goes on if its seeds cover
enough of the item, which bounds what tiles can cover. Tiling then marks the
longest matches first, none overlapping, each at least a seed long, with running
Karp-Rabin hashes of windows of any length; so an item whose parts come in another
order is covered as well as one that is whole. A pair is a hit if tiles cover at
least `threshold` of the item's words.

The benchmark is a stated query set: its seeds are broadcast in blocks of a checked
size, each block against all documents, so documents are never shuffled and a
benchmark of any size costs one scan for each block.

Defined cases: null or empty texts have no words; items of fewer words than a seed
match nothing, for so few words stand in many clean documents; of tiles of one length
the leftmost in the item, then in the document, is marked first; items that repeat are matched each; rows that repeat a doc_id are
matched each and their hits are one; an empty table, of either kind, gives an empty
result; other columns are ignored. A worker takes texts in pieces of 1 MB, or one text
if it is longer: about 30 times its bytes of memory.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, _powers, buffers, mix, pieces

SEED = 4
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pc.utf8_lower(texts))


class Items:
    """Benchmark items: word hashes, and their seeds in order of hash."""

    def __init__(self, ids: list, texts: pa.Array, seed: int = SEED):
        raw, off = words_of(texts)
        w = Words(raw, off, "alnum")
        self.ids, self.seed, self.rows, self.words = ids, seed, w.rows, w.hashes
        g, ok = w.grams(seed)
        at = np.flatnonzero(ok)
        item = np.searchsorted(w.rows, at, "right") - 1
        order = np.argsort(g[at], kind="stable")
        self.hashes, first = np.unique(g[at][order], return_index=True)
        self.first = np.concatenate([first, [len(order)]])
        self.item, self.place = item[order], (at - w.rows[item])[order]


def prefix_sums(words: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(words) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p[: len(words)])])


def match_lengths(item: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """How far item[p:] and doc[q:] agree, for each pair: window hashes, doubling and halving the length. sums: the document's prefix sums."""
    _, inv = _powers(max(len(item), len(doc)) + 1)
    a, b = prefix_sums(item), prefix_sums(doc) if sums is None else sums
    size = np.zeros(len(p), np.int64)
    step = 1 << max(0, len(item).bit_length() - 1)
    while step:
        longer = size + step
        fits = (p + longer <= len(item)) & (q + longer <= len(doc))
        x, y, n = p[fits], q[fits], longer[fits]
        same = (a[x + n] - a[x]) * inv[x] == (b[y + n] - b[y]) * inv[y]
        at = np.flatnonzero(fits)[same]
        size[at] = longer[at]
        step >>= 1
    return size


def tile(item: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, least: int = SEED, sums: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words), longest first, from the seeds at p and q."""
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(match_lengths(item, doc, p, q, sums), p, q) if n >= least]
    heapq.heapify(heap)
    used_p, used_q, out = np.zeros(len(item), bool), set(), []
    while heap:
        n, x, y = heapq.heappop(heap)
        free = 0
        while free < -n and not used_p[x + free] and y + free not in used_q:
            free += 1
        if free == -n:
            used_p[x : x + free] = True
            used_q.update(range(y, y + free))
            out.append((x, y, free))
            if used_p.all():
                break
        elif free >= least:
            heapq.heappush(heap, (-free, x, y))
    return out


def hits_in(words: Words, items: Items, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(document, item, words covered, tiles, coverage) of some texts."""
    k = items.seed
    g, ok = words.grams(k)
    if not len(items.hashes) or not len(g):
        return []
    at = np.minimum(np.searchsorted(items.hashes, g), len(items.hashes) - 1)
    q = np.flatnonzero(ok & (items.hashes[at] == g))
    seeds = at[q]
    often = items.first[seeds + 1] - items.first[seeds]
    one = np.repeat(np.arange(len(q)), often)
    entry = np.repeat(items.first[seeds], often) + np.arange(len(one)) - np.repeat(np.cumsum(often) - often, often)
    doc = np.searchsorted(words.rows, q[one], "right") - 1
    item, place, q = items.item[entry], items.place[entry], q[one]
    order = np.lexsort((q, place, item, doc))
    doc, item, place, q = doc[order], item[order], place[order], q[order]
    if not len(doc):
        return []
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    reach = np.minimum(np.diff(place, append=place[-1] + k), k)
    last = np.concatenate([edge[1:], [len(doc)]]) - 1
    reach[last] = k
    covered = np.add.reduceat(reach, edge)
    out, known, sums = [], -1, None
    for e, end, c in zip(edge, last + 1, covered):
        i, d = int(item[e]), int(doc[e])
        own = items.words[items.rows[i] : items.rows[i + 1]]
        if c < threshold * len(own):
            continue
        lo = int(words.rows[d])
        text = words.hashes[lo : words.rows[d + 1]]
        if d != known:
            known, sums = d, prefix_sums(text)
        tiles = tile(own, text, place[e:end], q[e:end] - lo, k, sums)
        n = sum(t[2] for t in tiles)
        if n >= threshold * len(own):
            out.append((d, i, n, len(tiles), n / len(own)))
    return out


def _find(shared, threshold: float):
    def fn(batches):
        items = shared.value
        for batch in batches:
            raw, off = words_of(batch.column(1))
            for i, j in pieces(off, PIECE):
                found = hits_in(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], "alnum"), items, threshold)
                if found:
                    d, it, n, t, c = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + x for x in d])), pa.array([items.ids[x] for x in it], pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "item_id", "n_covered", "n_tiles", "coverage"])

    return fn


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_covered, n_tiles, coverage of each hit between docs (doc_id, text) and benchmark (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    schema = "doc_id long, item_id long, n_covered long, n_tiles long, coverage double"
    out = None
    for b in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        shared = rows.sparkSession.sparkContext.broadcast(Items(block.column(0).to_pylist(), block.column(1), seed))
        found = rows.mapInArrow(_find(shared, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_covered", "n_tiles", "coverage"), F.col("n_covered")).alias("x")).select("doc_id", "item_id", "x.*")
