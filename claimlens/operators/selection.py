"""Greedy selection under quotas and shared caps, for any number of rows, by thresholds.

Rows are taken in hash order: first each kind up to its quota, one kind after the other, then any up to the total; no label is ever
taken more often than the cap. Rows of one kind and label are a stream; whatever the phase, what is taken of a stream is its
next rows, so a phase is known by one number for each stream. These numbers are found from counts by the head of the hash: heads that
can be taken whole are, the one head where a quota or a shared cap is reached is split by the next digits, down to heads of few
rows, which are read. Then rows are ranked within their streams and compared with the numbers, wherever they are.

The driver holds the counts of the heads that it splits, a few thousand numbers a stream, whatever the number of rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_order
from .ranking import global_rank
from .storing import stored

#: Hex digits by which a head is split, and rows of a head that are read instead.
DIGITS, FEW = 2, 2000

Stream = tuple[str | None, str | None]


class Heads:
    """Counts of rows (_h, key, kind, label) by stream and head of the hash, made when they are asked for."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key, self.seen, self.read = rows, key, {}, {}
        self.jobs = 0

    def split(self, head: str) -> list[tuple[str, Counter]]:
        """The heads one step longer that have rows, in order, with the rows of each stream."""
        if head not in self.seen:
            self.jobs += 1
            own = self.rows.where(F.startswith("_h", F.lit(head))) if head else self.rows
            found: dict[str, Counter] = defaultdict(Counter)
            for r in own.groupBy(F.substring("_h", 1, len(head) + DIGITS).alias("head"), "kind", "label").count().collect():
                found[r["head"]][r["kind"], r["label"]] = r["count"]
            self.seen[head] = sorted(found.items())
        return self.seen[head]

    def streams(self, head: str) -> list[Stream]:
        """The streams of the rows of a head, row by row in order."""
        if head not in self.read:
            self.jobs += 1
            rows = self.rows.where(F.startswith("_h", F.lit(head))).select("_h", self.key, "kind", "label").collect()
            self.read[head] = [(r["kind"], r["label"]) for r in sorted(rows, key=lambda r: (r["_h"], r[self.key]))]
        return self.read[head]


def take(heads: Heads, taken: Counter, kinds: set[str] | None, left: Counter, quota: int, cap: int) -> Counter:
    """What a phase takes of each stream: the next rows after `taken`, of some kinds (None: all), labels used up to the cap.

    left counts how often each label is used, and is brought up to date.
    """
    got: Counter = Counter()
    passed: Counter = Counter()  # rows of each stream before the head
    room = quota

    def fresh(stream: Stream, n: int) -> int:
        """Of the next n rows of a stream those that are not taken yet."""
        return max(0, passed[stream] + n - taken[stream]) - max(0, passed[stream] - taken[stream])

    def whole(counts: Counter) -> dict[Stream, int] | None:
        """What is taken of a head, if its counts tell it."""
        by_label: dict[str | None, list[Stream]] = defaultdict(list)
        for stream in counts:
            if (kinds is None or stream[0] in kinds) and left[stream[1]] < cap and fresh(stream, counts[stream]):
                by_label[stream[1]].append(stream)
        out: dict[Stream, int] = {}
        for label, streams in by_label.items():
            want = sum(fresh(s, counts[s]) for s in streams)
            may = cap - left[label]
            if want > may and len(streams) > 1:
                return None
            out |= {s: min(may, fresh(s, counts[s])) for s in streams}
        return out if sum(out.values()) <= room else None

    def go(head: str) -> None:
        nonlocal room
        for longer, counts in heads.split(head):
            if not room:
                return
            out = whole(counts)
            if out is None and sum(counts.values()) > FEW:
                go(longer)
                continue
            if out is None:
                out, seen = Counter(), Counter()
                for stream in heads.streams(longer):
                    seen[stream] += 1
                    is_new = passed[stream] + seen[stream] > taken[stream]
                    if is_new and (kinds is None or stream[0] in kinds) and left[stream[1]] < cap and room:
                        out[stream] += 1
                        left[stream[1]] += 1
                        room -= 1
            else:
                for stream, n in out.items():
                    left[stream[1]] += n
                    room -= n
            got.update(out)
            passed.update(counts)

    go("")
    return got


def select(rows: DataFrame, key: str, kind: str, label: str, quotas: dict[str, int], most: int, cap: int, salt: int | str) -> DataFrame:
    """key and place (from 1) of the rows taken, by phase and then by hash order.

    Rows that repeat a key count once (with the first kind and label by name). A null kind is in no quota and can be taken at the end, a null
    label is a label. Fewer than `most` rows are taken where caps or rows run out. An empty table gives an empty result.
    """
    one = rows.groupBy(F.col(key)).agg(F.min(F.struct(F.col(kind).alias("kind"), F.col(label).alias("label"))).alias("s"))
    slim = stored(one.select(key, "s.kind", "s.label").withColumn("_h", hash_order(key, salt)))
    heads, taken, left, total = Heads(slim, key), Counter(), Counter(), 0
    bounds: list[tuple[str | None, str | None, int, int, int]] = []  # kind, label, first and last rank, phase
    for phase, (own, quota) in enumerate([*quotas.items(), (None, most)]):
        got = take(heads, taken, None if own is None else {own}, left, min(quota, most - total), cap)
        bounds += [(*s, taken[s], taken[s] + n, phase) for s, n in got.items() if n]
        taken.update(got)
        total += sum(got.values())
    spark = rows.sparkSession
    few = F.broadcast(spark.createDataFrame(bounds, "_kind string, _label string, _from long, _to long, _phase int"))  # a row for each stream and phase
    ranked = global_rank(slim.select(key, "kind", "label"), key, salt, ["kind", "label"], "_r")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("label").eqNullSafe(F.col("_label")) & (F.col("_r") > F.col("_from")) & (F.col("_r") <= F.col("_to"))
    chosen = ranked.join(few, same).select(key, "_phase")
    sizes = Counter()
    for *_, a, b, phase in bounds:
        sizes[phase] += b - a
    before = [sum(n for p, n in sizes.items() if p < phase) for phase in range(len(quotas) + 1)]
    return global_rank(chosen, key, salt, ["_phase"], "_p").select(key, (F.col("_p") + F.get(F.array(*map(F.lit, before)), F.col("_phase"))).cast("long").alias("place"))
