"""The least-covered choice over any number of rows: exactly the sequential one, made by blocks in parallel.

Each row takes, of its eligible kinds, the one with the fewest choices so far, the first of equals. What a block of rows chooses depends on
the counts at its start by their differences only. A run of a block from assumed counts is therefore right for more starts than its
own: for every decision "k before j" it notes how much larger the difference of k and j at the start could have been. These
limits (a difference-bound matrix) and what the block adds to the counts are a piece of the block's function, and where a start lies within a
piece, the counts after the block are known without a run.

Pieces are found by rounds. All blocks run from zero; then the counts are passed from block to block, by a piece that fits, and else
by a forecast; blocks without a fitting piece run from their forecast at once, in parallel, until all starts fit. The first such block of
each round has its true start, so it ends; as counts even out within a block, forecasts are right after a few rounds. A kind that is
rarely eligible lags ever further behind, which pieces take in, as it is chosen all the same.

The driver holds a matrix of the kinds for each piece; there are MOST_BLOCKS blocks at most, whatever the number of rows. Blocks are
streamed, so a task holds counts, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank
from .storing import stored

MOST_BLOCKS, MOST_KINDS = 1024, 64
FREE = np.int64(1) << 60


class Walk:
    """The choices of a block from given counts, and for which other counts they would be the same."""

    def __init__(self, start: list[int]):
        self.start, self.count = list(start), list(start)
        self.room = [[int(FREE)] * len(start) for _ in start]

    def choose(self, eligible: list[int]) -> int | None:
        """The kind of the next row; no eligible kind gives none and counts for nothing."""
        if not eligible:
            return None
        count, start = self.count, self.start
        best = min(eligible, key=count.__getitem__)
        room, own, earlier = self.room[best], count[best] - start[best], 1
        for k in eligible:
            if k == best:
                earlier = 0
            else:
                left = count[k] - start[k] - own - earlier
                if left < room[k]:
                    room[k] = left
        count[best] += 1
        return best


@dataclass
class Piece:
    start: np.ndarray
    room: np.ndarray
    shift: np.ndarray

    def fits(self, start: np.ndarray) -> bool:
        return bool((start[:, None] - start[None, :] <= self.room).all())


def forecast(pieces: list[Piece], start: np.ndarray) -> np.ndarray:
    """The counts after a block from a start that no piece fits, as the nearest piece has it.

    Kinds whose limits the start keeps are chosen as often as in the piece. The others even out within the block: together they
    are chosen as often, and end as far apart as in the piece.
    """
    level = lambda s: s - s.sum() // len(s)
    piece = min(pieces, key=lambda p: int(np.abs(level(start) - level(p.start)).sum()))
    over = start[:, None] - start[None, :] > piece.room
    loose = np.flatnonzero(over.any(0) | over.any(1))
    out, end = start + piece.shift, (piece.start + piece.shift)[loose]
    even, left = divmod(int(out[loose].sum() - end.sum()), len(loose))
    out[loose] = end + even
    out[loose[np.argsort(end, kind="stable")[:left]]] += 1
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("_block").sortWithinPartitions("_block", "_r")


def _pieces(rows: DataFrame, starts: dict[int, np.ndarray]) -> dict[int, Piece]:
    """A run of each block in starts."""
    at = {b: s.tolist() for b, s in starts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, walk = None, None

        def done() -> pa.RecordBatch:
            shift = [c - s for c, s in zip(walk.count, walk.start, strict=True)]
            return pa.RecordBatch.from_pydict({"block": [block], "room": [sum(walk.room, [])], "shift": [shift]})

        for b in batches:
            for own, kinds in zip(b["_block"].to_pylist(), b["_kinds"].to_pylist(), strict=True):
                if own != block:
                    if walk:
                        yield done()
                    block, walk = own, Walk(at[own])
                walk.choose(kinds or [])
        if walk:
            yield done()

    some = rows if len(starts) == 1 + max(starts) else rows.where(F.col("_block").isin(list(starts)))
    found = _dealt(some.select("_block", "_r", "_kinds")).mapInArrow(run, "block long, room array<long>, shift array<long>").collect()  # MOST_BLOCKS at most
    return {r["block"]: Piece(starts[r["block"]], np.array(r["room"], np.int64).reshape(len(r["shift"]), -1), np.array(r["shift"], np.int64)) for r in found}


def starts_of(rows: DataFrame, blocks: int, kinds: int) -> tuple[list[np.ndarray], int]:
    """The counts of each kind at the start of each block of rows (_block, _r, _kinds), and the rounds that it took."""
    zero = np.zeros(kinds, np.int64)
    if blocks < 2:
        return [zero] * blocks, 0
    known: dict[int, list[Piece]] = {b: [] for b in range(blocks)}
    missing, rounds = dict.fromkeys(range(blocks), zero), 0
    while missing:
        for b, piece in _pieces(rows, missing).items():
            known[b].append(piece)
        missing, out, now = {}, [], zero
        for b in range(blocks):
            out.append(now)
            piece = next((p for p in known[b] if p.fits(now)), None)
            if piece is None:
                missing[b] = now
                now = forecast(known[b], now)
            else:
                now = now + piece.shift
        missing.pop(blocks - 1, None)
        rounds += 1
    return out, rounds


def least_covered(rows: DataFrame, key: str, salt: int | str, most: int | None = None, block: int = 100_000, name: str = "rejected_type") -> DataFrame:
    """key and the kind chosen for it: of the eligible ones that with the fewest choices so far, the first of equals, in hash order.

    rows have key and `eligible` (array of names); `most` keeps the first so many in hash order. The result is that of the plain loop
    for any `block` (rows of a block; larger where there would be more than MOST_BLOCKS). A row without an eligible kind gets none.
    An empty table gives an empty result.
    """
    names = sorted(r[0] for r in rows.select(F.explode("eligible")).distinct().limit(MOST_KINDS + 1).collect())
    if len(names) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds")
    said = F.array(*map(F.lit, names)).cast("array<string>")
    ranked = global_rank(rows.select(key, F.transform("eligible", lambda n: (F.array_position(said, n) - 1).cast("int")).alias("_kinds")), key, salt, name="_r")
    if most is not None:
        ranked = ranked.where(F.col("_r") <= most)
    ranked = stored(ranked)
    n = ranked.count()
    size = max(block, -(-n // MOST_BLOCKS))
    ranked = ranked.withColumn("_block", F.floor((F.col("_r") - 1) / size))
    begin = [s.tolist() for s in starts_of(ranked, -(-n // size), len(names))[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, walk = None, None
        for b in batches:
            out = []
            for own, kinds in zip(b["_block"].to_pylist(), b["_kinds"].to_pylist(), strict=True):
                if own != block:
                    block, walk = own, Walk(begin[own])
                pick = walk.choose(kinds or [])
                out.append(None if pick is None else names[pick])
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.string())], [key, name])

    kind = rows.schema[key].dataType.simpleString()
    return _dealt(ranked).select(key, "_block", "_kinds").mapInArrow(run, f"{key} {kind}, {name} string")
