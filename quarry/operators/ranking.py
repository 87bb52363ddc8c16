"""The k best of each question that a worker keeps while it goes through its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HITS = "question_id string, chunk_id long, score double"
#: Scores that a worker holds at once, whatever the number of questions.
CELLS = 1 << 19
#: Hits in a batch that a worker gives back.
GIVEN = 1 << 15


def tile_rows(n: int) -> int:
    """Rows whose scores for n questions are held at once."""
    return max(1, CELLS // max(1, n))


class Best:
    """Hits of n questions seen so far, k >= 1 each at most: highest score at 9 decimals first (nan before all), then lowest id. -inf is no hit."""

    def __init__(self, n: int, k: int):
        self.k, self.key, self.score = k, np.full((n, k), -np.inf), np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores (n, rows) of rows with these ids."""
        key = np.round(scores, 9)
        key[np.isnan(key)] = np.inf
        floor, last = self.key[:, -1:], self.id[:, -1:]
        near = (key > floor) | ((key == floor) & (ids < last) & (key > -np.inf))
        if len(ids) > self.k and np.count_nonzero(near) > 4 * near.shape[0] * self.k:
            near &= key >= np.partition(key, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
        q, j = np.nonzero(near)
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        new = key[q[len(touched) * self.k :], j], scores[q[len(touched) * self.k :], j], ids[j]
        key, score, held = (np.concatenate([old[touched].reshape(-1), x]) for old, x in zip((self.key, self.score, self.id), new))
        order = np.lexsort((held, -key, q))
        # Each question that is touched has k entries at least, since unused places count.
        take = order[np.searchsorted(q[order], touched)[:, None] + np.arange(self.k)]
        self.key[touched], self.score[touched], self.id[touched] = key[take], score[take], held[take]

    def batches(self, names: list) -> Iterator[pa.RecordBatch]:
        """The hits, with the questions' names."""
        step = max(1, GIVEN // self.k)
        for start in range(0, len(names), step):
            q, place = np.nonzero(self.key[start : start + step] > -np.inf)
            own = pa.array(names[start : start + step], pa.string()).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([own, pa.array(self.id[start + q, place]), pa.array(self.score[start + q, place])], ["question_id", "chunk_id", "score"])
