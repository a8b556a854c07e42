"""Terms of a masked product of matrices, found in cells of a grid.

Vertices are dealt to GRID parts by hash, so that rows, columns and the inner index cut the product into GRID cubed cells. A
cell needs one block of each operand: every entry is shuffled GRID times, however many neighbours a vertex has, and a path
of two edges becomes a row only if the mask has its ends.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of each index. A cell holds a GRID-squared-th of each operand.
GRID = 8
#: Paths that a cell looks at in one go.
STEP = 1 << 21
MASK, LEFT, RIGHT = 0, 1, 2

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row its places lo, lo + 1, ..., n of them."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _rank(among: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, -1 where it lacks them."""
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return np.where(among[at] == of, at, -1)


class _Block:
    """Entries (line, y) of one operand, sorted."""

    def __init__(self, line: np.ndarray, y: np.ndarray):
        self.lines, self.ys = np.unique(line), np.unique(y)
        key = _rank(self.lines, line) * len(self.ys) + _rank(self.ys, y)
        self.order = np.argsort(key, kind="stable")
        self.key, self.y = key[self.order], y[self.order]
        self.first = np.searchsorted(self.key, np.arange(len(self.lines) + 1) * len(self.ys))

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, 0, self.first[at + 1] - self.first[at])

    def find(self, line: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, place): the entries that there are, by ranks of line and y; repeated entries all."""
        key = line * len(self.ys) + y
        lo = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero((self.key[lo] == key) & (y >= 0))
        of, place = _ranges(lo[hit], np.searchsorted(self.key, key[hit], "right") - lo[hit])
        return hit[of], place


def _paths(mi: np.ndarray, mj: np.ndarray, left: _Block, right: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entry of the mask, of the left, of the right operand); left has rows as lines, right columns.

    From an entry of the mask the shorter of its row and its column is walked, STEP entries at a time, and the other is asked.
    """
    row, column = _rank(left.lines, mi), _rank(right.lines, mj)
    shorter = left.sizes(row) <= right.sizes(column)
    both = (row >= 0) & (column >= 0)
    for walked, asked, line, end, mine in ((left, right, row, column, both & shorter), (right, left, column, row, both & ~shorter)):
        todo = np.flatnonzero(mine)
        if not len(todo):
            continue
        todo = todo[np.argsort(end[todo], kind="stable")]  # questions to one line come together
        done, y = np.cumsum(walked.sizes(line[todo])), _rank(asked.ys, walked.y)
        for part in np.split(todo, np.unique(np.searchsorted(done, np.arange(STEP, done[-1], STEP)))):
            of, place = _ranges(walked.first[line[part]], walked.sizes(line[part]))
            hit, other = asked.find(end[part][of], y[place])
            m, w, o = part[of[hit]], walked.order[place[hit]], asked.order[other]
            yield (m, w, o) if walked is left else (m, o, w)


def terms(mask: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, _a, _b): for each (i, j) of mask, values of left (i, _k, _a) and right (_k, j, _b) with the same _k."""
    kinds = {"_a": dict(left.dtypes)["_a"], "_b": dict(right.dtypes)["_b"]}

    def part(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(GRID))

    def block(df: DataFrame, which: int, x: str, y: str, free: str) -> DataFrame:
        axes = {"i": GRID * GRID, "_k": GRID, "j": 1}
        own = sum((part(c) * axes[c] for c in (x, y)), F.lit(0))
        every = F.explode(F.array(*(F.lit(n * axes[free]) for n in range(GRID))))
        values = [F.col(c).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
        d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(own.alias("_own"), F.lit(which).cast("byte").alias("which"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), *values)
        return d.select("*", every.alias("_free")).select((F.col("_own") + F.col("_free")).cast("int").alias("cell"), "which", "x", "y", *kinds)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        which, x, y = (table[c].to_numpy() for c in ("which", "x", "y"))
        m, a, b = (np.flatnonzero(which == w) for w in (MASK, LEFT, RIGHT))
        if len(m) and len(a) and len(b):
            va, vb = (table[c].combine_chunks().take(pa.array(at)) for c, at in (("_a", a), ("_b", b)))
            for at, p, q in _paths(x[m], y[m], _Block(x[a], y[a]), _Block(y[b], x[b])):
                yield pa.RecordBatch.from_arrays([pa.array(x[m][at]), pa.array(y[m][at]), va.take(pa.array(p)), vb.take(pa.array(q))], ["i", "j", "_a", "_b"])

    rows = block(mask, MASK, "i", "j", "_k").unionByName(block(left, LEFT, "i", "_k", "j")).unionByName(block(right, RIGHT, "_k", "j", "i"))
    return rows.groupBy("cell").applyInArrow(solve, f"i long, j long, _a {kinds['_a']}, _b {kinds['_b']}")
