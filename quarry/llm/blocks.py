"""Blocks: documents in ranges of doc_id of about equal bytes, each worked on as one Arrow table.

A block is a unit that any executor can rebuild from the input: its rows, in order
of doc_id, are the same each time, so later stages need only send it bits about
what it sent out. Its size doesn't grow with the input up to MOST_BLOCKS of them; their
number does. Rows without doc_id are in the last block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import save

BLOCK_BYTES = 6 << 20
#: Above so many blocks (6 TB of text) they get larger instead: the driver holds a number for each, and the plan names them.
MOST_BLOCKS = 1 << 20
#: Cells that bytes are first counted in, for each block, and bits by which one that has too many is split.
CELLS, SPLIT = 4, 6
LOWEST = -(1 << 63)


def cut_points(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[int]:
    """Ascending first doc_ids of all blocks but the first, so that each has about block_bytes, or one document.

    Bytes are counted in cells of equal width, a few for each block; a cell that holds
    more than half a block, where doc_ids are dense or documents long, is split and
    counted again. Then cells are taken together in order.
    """
    sized = save(docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "block-sizes")
    total, low, high = sized.agg(F.sum("bytes"), F.min("doc_id"), F.max("doc_id")).first()
    n = min(MOST_BLOCKS, -(-(total or 0) // block_bytes))
    if n < 2:
        return []
    size = total / n
    bits = min(63, ((high - low) // (CELLS * n)).bit_length())  # of a doc_id, which a cell leaves open
    open_, done = sized, []
    while True:
        cell = F.shiftright("doc_id", bits)
        found = open_.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).toArrow()
        cells, of = found.column("cell").to_numpy().astype(np.int64), found.column("bytes").to_numpy()
        heavy = (of > size / 2) & (bits > 0)
        done += [(int(c) << bits, int(b)) for c, b in zip(cells[~heavy], of[~heavy])]
        if not heavy.any():
            break
        some = docs.sparkSession.createDataFrame(pa.table({"cell": cells[heavy]}))
        open_ = open_.withColumn("cell", cell).join(some, "cell", "left_semi").drop("cell")
        bits = max(0, bits - SPLIT)
    cuts, held = [], 0
    for start, of_cell in sorted(done):
        if held and held + of_cell > size:
            cuts.append(start)
            held = 0
        held += of_cell
    return sorted({c for c in cuts if low < c <= high})


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def block_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cut points at or below doc_id; null comes after all."""
    if not cuts:
        return F.lit(0)
    side = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::side]
    group = F.size(F.filter(_numbers(coarse), lambda c: c <= doc_id))
    fine = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, cuts[i : i + side])) for i in range(0, len(cuts), side))), ";"), group - 1), ",").cast("array<bigint>")
    inside = F.when(group == 0, 0).otherwise((group - 1) * side + F.size(F.filter(fine, lambda c: c <= doc_id)))
    return F.when(doc_id.isNull(), len(cuts)).otherwise(inside).cast("int")


def in_order(table: pa.Table) -> pa.Table:
    """By doc_id, null last, then by text, so that a block is the same each time."""
    ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else None
    if ids is not None and len(np.unique(ids)) == len(ids):
        return table.take(pa.array(np.argsort(ids, kind="stable")))
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
