"""Count-min sketch that no task and no driver holds whole: its cells are owned by hash ranges.

A block of documents (one group of rows) lists the cells of its items, each once with a count, and sends every range
its part, as packed differences.  The range adds up what all blocks sent and answers each with one code for each
cell it asked about; the block takes the least of an item's rows.  Counts are only ever overestimates, so an item
that is called single is single.

Cells and ranges grow with the number of items, so the share of single items that pass doesn't: about one in
2 ** (spare * depth).  A task holds one block or one range; blocks and ranges exchange at most one row for each of
their pairs, and never more rows than items.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import pack, unpack

#: Items that a range is laid out for.
RANGE_ITEMS = 1 << 20
MOST = 255
#: Fixed odd multipliers, one for each row of the sketch.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
ASKED = "range long, block long, cells binary, counts binary"
ANSWERED = "range long, block long, codes binary"


def _log2(x: float) -> int:
    return max(0, int(np.ceil(np.log2(max(x, 1)))))


class Sketch:
    """Layout of a sketch for so many items; a few numbers, which travel with the functions.

    least_ranges spreads the ranges of small inputs over that many tasks.
    """

    def __init__(self, items: float, depth: int, spare: int, least_ranges: int = 1):
        self.depth = depth
        self.range_bits = max(_log2(items / RANGE_ITEMS), _log2(least_ranges / depth))
        self.bits = max(_log2(items) + spare, self.range_bits + 8)
        self.local = self.bits - self.range_bits

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (hashes * np.uint64(MULTIPLIERS[row])) >> np.uint64(64 - self.bits)

    def ask(self, block: int, hashes: np.ndarray) -> pa.Table:
        """Rows of ASKED from all items of a block; an item is given as often as it counts."""
        out: list[tuple] = []
        for row in range(self.depth if len(hashes) else 0):
            c, n = np.unique(self.cells(hashes, row), return_counts=True)
            at = (c >> np.uint64(self.local)).astype(np.int64)
            low = (c & np.uint64((1 << self.local) - 1)).astype(np.uint32)
            n = np.minimum(n, MOST).astype(np.uint8)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=True):
                out.append((row << self.range_bits | int(at[a]), pack(low[a:b]), zlib.compress(n[a:b].tobytes(), 1)))
        return pa.table({
            "range": pa.array([r[0] for r in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
            "cells": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary()),
        })

    def judge(self, code: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
        """For groups of ASKED by range: ANSWERED, where code turns totals (MOST and above are MOST) into small numbers."""

        def run(table: pa.Table) -> pa.Table:
            total, asked = np.zeros(1 << self.local, np.uint8), []
            for cells, counts in zip(table["cells"], table["counts"], strict=True):
                c = unpack(cells.as_py(), np.uint32)
                n = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                total[c] = np.minimum(MOST, total[c].astype(np.uint16) + n)  # the cells of a block are distinct
                asked.append(c)
            codes = [zlib.compress(code(total[c]).astype(np.uint8).tobytes(), 1) for c in asked]
            return pa.table({"range": table["range"], "block": table["block"], "codes": pa.array(codes, pa.binary())})

        return run

    def read(self, answers: pa.Table, hashes: np.ndarray) -> np.ndarray:
        """The code of each item of a block, from its rows of ANSWERED."""
        if not len(hashes):
            return np.zeros(0, np.uint8)
        by = sorted(zip(answers["range"].to_pylist(), answers["codes"].to_pylist(), strict=True), key=lambda r: r[0])
        out = None
        for row in range(self.depth):
            _, at = np.unique(self.cells(hashes, row), return_inverse=True)
            codes = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for k, b in by if k >> self.range_bits == row])
            out = codes[at] if out is None else np.minimum(out, codes[at])
        return out
