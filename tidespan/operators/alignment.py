"""Global alignment of two short sequences of anything comparable: edits, and the moves that make them."""

from __future__ import annotations

import numpy as np

BOTH, FIRST, SECOND = 0, 1, 2
STEPS = {BOTH: (1, 1), FIRST: (1, 0), SECOND: (0, 1)}


def edit_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between every start of a and every start of b. A row follows from the one before by two minima, and by a running one for gaps along it."""
    along = np.arange(len(b) + 1)
    out = np.empty((len(a) + 1, len(b) + 1), np.int64)
    out[0] = along
    for i, x in enumerate(a, 1):
        best = out[i - 1] + 1
        best[1:] = np.minimum(best[1:], out[i - 1, :-1] + (b != x))
        out[i] = np.minimum.accumulate(best - along) + along
    return out


def moves(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How each cell of an edit table is reached: a step along both if that is as good, else along the first, else the second."""
    out = np.full(table.shape, SECOND, np.int8)
    out[1:, 0] = FIRST
    if len(a) and len(b):
        inner = table[1:, 1:]
        both = table[:-1, :-1] + (a[:, None] != b[None, :]) == inner
        out[1:, 1:] = np.where(both, BOTH, np.where(table[:-1, 1:] + 1 == inner, FIRST, SECOND))
    return out


def paired(how: np.ndarray, end: tuple[int, int]) -> list[tuple[int | None, int | None]]:
    """The pairs of indices of an alignment up to end; None stands for a gap."""
    i, j = end
    out = []
    while (i, j) != (0, 0):
        di, dj = STEPS[int(how[i, j])]
        i, j = i - di, j - dj
        out.append((i if di else None, j if dj else None))
    return out[::-1]
