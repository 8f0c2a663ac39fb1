"""Counts of 64-bit hashes over a whole table in a fixed number of slots.

A slot holds the sum of the counts of all hashes that fall in it, so it is never below the count of any of them: good for an order
by rarity, and for leaving out what is certainly rare. Tasks add up what they see and send the slots that are not zero, in slices;
slices are added where they meet. The table has SLOTS numbers at every size of the input, which bounds what reaches the
driver and is broadcast; more input makes it less sharp, not wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOTS, SLICE = 1 << 22, 1 << 12
PARTS = "slice int, at binary, n binary"


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def zeros() -> np.ndarray:
    return np.zeros(SLOTS, np.uint32)


def parts(counts: np.ndarray, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS for the slots of a task that are not zero."""
    for first in range(0, SLOTS, SLICE * rows):
        some = [(k, np.flatnonzero(x), x) for k in range(first // SLICE, first // SLICE + rows) if (x := counts[k * SLICE : (k + 1) * SLICE]).any()]
        if some:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k for k, _, _ in some], pa.int32()), "at": [at.astype(np.uint16).tobytes() for _, at, _ in some], "n": [x[at].astype(np.int64).tobytes() for _, at, x in some]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, at, n in zip(b["slice"].to_pylist(), b["at"].to_pylist(), b["n"].to_pylist(), strict=True):
            sums = held.setdefault(k, np.zeros(SLICE, np.int64))
            sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    for k, sums in held.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [sums[at].tobytes()]})


def merged(rows: DataFrame) -> np.ndarray:
    """The sums of all PARTS rows, as unsigned 32-bit numbers (larger sums count as the largest)."""
    out = np.zeros(SLOTS, np.uint32)
    for r in rows.repartition("slice").mapInArrow(_add, PARTS).collect():  # SLOTS numbers at most
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64) + r["slice"] * SLICE
        out[at] = np.minimum(np.frombuffer(r["n"], np.int64), np.iinfo(np.uint32).max)
    return out
