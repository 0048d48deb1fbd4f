"""Bit maps of a fixed size: what is certainly absent is left out before a shuffle.

A map is filled by Spark tasks, joined by OR in parts and broadcast. Its size does not
grow with the data; beyond it more bits are set by chance, which costs time and never
changes a result, because the caller decides exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantfold.llm import wordscan

BITS = 1 << 25
PARTS = 64


def filled(rows: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The map with the bits at ``places(batch)`` (0 to BITS - 1) set; empty if there are no rows."""

    def fill(batches):
        bits, some = np.zeros(BITS, bool), False
        for b in batches:
            if b.num_rows:
                bits[places(b)] = some = True
        if some:
            yield wordscan.pack(np.packbits(bits), PARTS)

    return wordscan.merged(rows.mapInArrow(fill, wordscan.PACKED), np.uint8, PARTS, np.bitwise_or)


def repeated(rows: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The map with the bits set that are in ``places(batch)`` at least twice over all rows; empty if there are no rows."""

    def fill(batches):
        once, twice, some = np.zeros(BITS, bool), np.zeros(BITS, bool), False
        for b in batches:
            if b.num_rows:
                found, k = np.unique(places(b), return_counts=True)
                twice[found[(k > 1) | once[found]]] = True
                once[found] = some = True
        if some:
            yield wordscan.pack(np.stack((np.packbits(once), np.packbits(twice)), axis=1).ravel(), PARTS)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a | b
        both[1::2] |= a[::2] & b[::2]
        return both

    return wordscan.merged(rows.mapInArrow(fill, wordscan.PACKED), np.uint8, PARTS, join)[1::2].copy()


def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place is set; nothing is in an empty map."""
    if not len(bits):
        return np.zeros(len(places), bool)
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
