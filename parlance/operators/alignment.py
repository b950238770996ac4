"""Edit distances and alignments of long sequences, in memory that grows with their length.

The built-in distance fills a table of both lengths. Here a pair beyond
``CELLS`` cells goes to a bit-parallel distance, which holds ``STRIP`` tokens of
one side in the bits of a number and passes over the other side strip by strip;
what leaves a strip below is one step of -1, 0 or 1 per token. Shorter pairs stay
in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from parlance.functions import text as tx

#: Cells up to which the built-in distance is used.
CELLS = 1 << 22
#: Tokens per strip.
STRIP = 1 << 13
#: Cells of an alignment's table that may be held at once.
HELD = 1 << 20


def distance(a: Sequence, b: Sequence, *, strip: int = STRIP) -> int:
    """Levenshtein distance of two sequences of hashable tokens."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    steps = np.ones(len(b), np.int8)  # horizontal differences above the strip
    for at in range(0, len(a), strip):
        steps = _below(a[at : at + strip], b, steps)
    return len(a) + int(steps.sum())


def _below(rows: Sequence, columns: Sequence, steps: np.ndarray) -> np.ndarray:
    """The horizontal differences below ``rows``, from those above."""
    every, last = (1 << len(rows)) - 1, 1 << (len(rows) - 1)
    equal: dict = {}
    for k, token in enumerate(rows):
        equal[token] = equal.get(token, 0) | 1 << k
    up, down = every, 0  # rows whose vertical difference is 1 and -1
    out = bytearray(len(columns))
    for j, (token, step) in enumerate(zip(columns, steps.tolist(), strict=True)):
        same = equal.get(token, 0)
        kept = same | down
        if step < 0:
            same |= 1
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(level | up)), up & level
        if rise & last:
            out[j] = 1
        elif fall & last:
            out[j] = 255
        rise, fall = rise << 1 & every, fall << 1 & every
        if step < 0:
            fall |= 1
        elif step > 0:
            rise |= 1
        up, down = fall | (every & ~(kept | rise)), rise & kept
    return np.frombuffer(bytes(out), np.int8)


@F.pandas_udf(LongType())
def _word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else distance(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def _character_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else distance(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int64")


def edits(ref: Column, hyp: Column, unit: str = "word") -> Column:
    """Edits between two arrays of words, counted in words, or in the characters of their words."""
    if unit == "char":
        ref, hyp = F.array_join(ref, ""), F.array_join(hyp, "")
        size, short, long = F.length, lambda r, h: F.levenshtein(r, h).cast("long"), _character_distance
    else:
        size, short, long = F.size, tx.word_edits, _word_distance
    small = size(ref).cast("long") * size(hyp) <= CELLS
    large = long(F.when(~small, ref), F.when(~small, hyp))
    return F.when(small, short(ref, hyp)).otherwise(large)


def _rows(ref: np.ndarray, hyp: np.ndarray):
    """Rows of the table of edits, from row 0 on."""
    place = np.arange(len(hyp) + 1, dtype=np.int32)
    row = place
    yield row
    for i, word in enumerate(ref, 1):
        # A row without insertions, then insertions as a running minimum of value minus place.
        free = np.empty_like(row)
        free[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (hyp != word), out=free[1:])
        row = np.minimum.accumulate(free - place) + place
        yield row


def _back(above: np.ndarray, row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the way back leaves a row diagonally, and where it goes up; elsewhere it goes left. ``other``: unequal tokens."""
    diagonal = np.zeros(len(row), bool)
    diagonal[1:] = row[1:] == above[:-1] + other
    return diagonal, ~diagonal & (row == above + 1)


def _whole(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """The way back through a table that fits in memory."""
    grid = np.array(list(_rows(ref, hyp)))
    out = np.zeros(len(ref), bool)
    i, j = len(ref), len(hyp)
    while i and j:
        same = ref[i - 1] == hyp[j - 1]
        if grid[i, j] == grid[i - 1, j - 1] + (not same):
            out[i - 1] = same
            i, j = i - 1, j - 1
        elif grid[i, j] == grid[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def _crossing(ref: np.ndarray, hyp: np.ndarray, middle: int) -> int:
    """The column in which the way back from the last cell first meets row ``middle``.

    Every cell below the middle row takes over the column of the cell that its
    own way back goes to, so a row of columns moves along with the row of edits.
    """
    above, columns = None, np.arange(len(hyp) + 1)
    for i, row in enumerate(_rows(ref, hyp)):
        if i > middle:
            diagonal, up = _back(above, row, hyp != ref[i - 1])
            came = np.where(up, columns, np.concatenate(([0], columns[:-1])))
            # A cell that goes left has the column of the next cell on its left that does not; the first never goes left.
            stays = diagonal | up
            stays[0] = True
            came[0] = columns[0]
            columns = came[np.maximum.accumulate(np.where(stays, np.arange(len(row)), 0))]
        above = row
    return int(columns[-1])


def matched_tokens(ref: list, hyp: list, *, held: int = HELD) -> list[bool]:
    """For each reference token whether an alignment of least edits meets it with an equal token.

    Walking back, a diagonal step is preferred, then a deletion. A table beyond
    ``held`` cells is divided at its middle row, where the same way back crosses.
    """
    names = {w: k for k, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    a, b = (np.array([names[w] for w in side], np.int32) for side in (ref, hyp))
    out = np.zeros(len(a), bool)
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        top, bottom, left, right = open_.pop()
        while bottom > top and right > left and a[bottom - 1] == b[right - 1]:  # equal ends are always met
            out[bottom - 1] = True
            bottom, right = bottom - 1, right - 1
        if bottom == top or right == left:
            continue
        if (bottom - top + 1) * (right - left + 1) <= held or bottom - top == 1:
            out[top:bottom] = _whole(a[top:bottom], b[left:right])
            continue
        middle = (bottom - top) // 2
        column = left + _crossing(a[top:bottom], b[left:right], middle)
        open_ += [(top, top + middle, left, column), (top + middle, bottom, column, right)]
    return out.tolist()
