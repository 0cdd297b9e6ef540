"""Counts of hashed keys over all rows, in a table of one size at any scale.

A key's hash names one of 2**``BITS`` cells by its leading bits.  Tasks count their own cells, the
counts are summed by range of cells, and what reaches the driver is each cell's logarithmic class: a
byte a cell, compressed.  A cell's count is never less than that of any key in it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .graph import BLOBS, by_bucket, pack, unpack

BITS, RANGES = 23, 64
CELLS = 1 << BITS
_STEPS = 6  # classes for each doubling of a count
_WIDTH = CELLS // RANGES
_CELL = np.dtype([("cell", "<u4"), ("n", "<u4")])


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.uint32)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in logarithmic classes; class 0 is a count of at most one."""
    return np.minimum(255, np.floor(_STEPS * np.log2(np.maximum(counts, 1.0)))).astype(np.uint8)


def at_most(classes: np.ndarray) -> np.ndarray:
    """The largest count of each class."""
    return 2.0 ** ((classes.astype(np.float64) + 1) / _STEPS)


def cell_rows(found: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Blobs (range, counts) of cells, as lists of their numbers."""
    cell, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *found]), return_counts=True)
    counted = np.rec.fromarrays([cell, n.astype(np.uint32)], dtype=_CELL)
    return pack((counted["cell"] // np.uint32(_WIDTH)).astype(np.int64), counted)


def classes(blobs: DataFrame, least: int = 0) -> tuple[list[tuple[int, bytes]], int]:
    """(classes of the cells, packed by range; the sum of all counts) of the blobs below ``RANGES``;
    cells under ``least`` have class 0."""

    def add(table: pa.Table) -> pa.Table:
        c, k = unpack(table, _CELL), table["bucket"][0].as_py()
        total = np.bincount(c["cell"].astype(np.int64) - k * _WIDTH, weights=c["n"], minlength=_WIDTH)
        blob = struct.pack("<q", int(total.sum())) + zlib.compress(np.where(total >= least, rarity(total), 0).astype(np.uint8).tobytes(), 1)
        return pa.table({"bucket": pa.array([k], pa.int32()), "blob": pa.array([blob], pa.binary())})

    out, total = [], 0
    for r in by_bucket(blobs.where(f"bucket between 0 and {RANGES - 1}"), add, BLOBS).toLocalIterator():
        total += struct.unpack("<q", r.blob[:8])[0]
        out.append((r.bucket, bytes(r.blob[8:])))
    return out, total


def table(packed: list[tuple[int, bytes]]) -> np.ndarray:
    """The class of every cell."""
    out = np.zeros(CELLS, np.uint8)
    for k, blob in packed:
        out[k * _WIDTH : (k + 1) * _WIDTH] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return out


def class_above(count: float) -> int:
    """The first class of which every cell may have more than ``count``."""
    return int(np.searchsorted(at_most(np.arange(256)), count, side="right"))


def reaches(packed: list[tuple[int, bytes]], least: int) -> bool:
    """Whether any cell has class ``least`` or more."""
    return any((np.frombuffer(zlib.decompress(blob), np.uint8) >= least).any() for _, blob in packed)
