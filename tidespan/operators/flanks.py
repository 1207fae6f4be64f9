"""Alignment of a read's flank of a repeat with the reference's, base to base."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidespan.operators.alignment import edit_table, moves, paired
from tidespan.session import dealt


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def aligned(read: str, flank: str, at_end: bool) -> tuple[str, str]:
    """(reference row, read row) with - for gaps: fixed at the tract (at_end: where both end, else where both start), free at the other end, where either may go on beyond the other; what does stands against blanks."""
    way = slice(None, None, -1 if at_end else 1)
    ref, own = flank[way], read[way]
    a, b = letters(ref), letters(own)
    table = edit_table(a, b)
    # where all of one of them is used with the fewest edits: both, else the reference, else the read
    ends = [(len(a), len(b)), *((len(a), j) for j in range(len(b) + 1)), *((i, len(b)) for i in range(len(a) + 1))]
    end = ends[int(np.array([table[e] for e in ends]).argmin())]
    pairs = paired(moves(table, a, b), end)
    over_ref, over_own = ref[end[0] :], own[end[1] :]
    width = max(len(over_ref), len(over_own))
    rows = (
        "".join("-" if i is None else ref[i] for i, _ in pairs) + over_ref.ljust(width),
        "".join("-" if j is None else own[j] for _, j in pairs) + over_own.ljust(width),
    )
    return rows[0][way], rows[1][way]


def aligned_flanks(flanks: DataFrame) -> DataFrame:
    """(id, ref_row, read_row) of flanks (id, read, flank, at_end). Flanks that are alike are aligned once."""
    alike = ["flank", "read", "at_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(16)(aligned)
        for b in batches:
            rows = [once(r["read"] or "", r["flank"] or "", bool(r["at_end"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array([r for r, _ in rows], pa.string()), pa.array([r for _, r in rows], pa.string())], names=["id", "ref_row", "read_row"])

    return dealt(flanks.select("id", *alike), *alike).sortWithinPartitions(*alike).mapInArrow(run, "id long, ref_row string, read_row string")
