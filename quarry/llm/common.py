"""What several operators share: the shared folder, and word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.work import Work, clear, save, shared_dir  # noqa: F401  for the operators

#: The ASCII white space that separates words: space and \x09-\x0D.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- word hashes over whole Arrow batches, without a Python object per word ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: Bytes whose words are hashed at once.
SPAN = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 20)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def byte_classes(word: str) -> np.ndarray:
    """Table over bytes: does it belong to a word? 'space': anything but white space; 'alnum': ASCII letters and digits, and all of a non-ASCII character."""
    t = np.zeros(256, bool)
    if word == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def _byte_hash(lower: bool, seed: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint64)
    if lower:
        v[0x41:0x5B] += np.uint64(32)
    return mix((v + np.uint64(1)) * _Q + np.uint64(seed))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some texts: starts and ends in bytes, a 64-bit hash each, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: str = "space", lower: bool = False, seed: int = 0):
        n = len(raw)
        inside = byte_classes(word)[raw]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # of each text, and the end
        self.hashes, values, i = np.empty(len(self.starts), np.uint64), _byte_hash(lower, seed), 0
        while i < len(self.starts):  # a hash doesn't depend on the place, so some bytes at once, or one word, will do
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + SPAN, "right")))
            begin, end = self.starts[i:j] - base, self.ends[i:j] - base
            m = int(end[-1])
            p, inv = _powers(m + 1)
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum(values[raw[base : base + m]] * p[:m], out=sums[1:])
            self.hashes[i:j] = mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64) * _M1)
            i = j

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are of one text."""
        h, n = self.hashes, len(self.hashes)
        m = max(0, n - k + 1)
        g = np.zeros(n, np.uint64)
        if m:
            acc = h[:m].copy()
            for j in range(1, k):
                acc *= _Q
                acc += h[j : j + m]
            g[:m] = mix(acc + np.uint64(k))
        counts = np.diff(self.rows)
        left = np.repeat(self.rows[1:], counts) - np.arange(n)
        return g, left >= k
