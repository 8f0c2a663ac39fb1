"""Advantages of completions as a stateful stream: a case's group is told as soon as it is whole, or after a wait with what has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rewards import EPSILON

OUT = "case_id string, position int, reward double, advantage double, complete boolean"
STATE = "positions array<int>, rewards array<double>, done boolean"


def _told(case: str, got: dict[int, float], complete: bool) -> pd.DataFrame:
    """The rewards of a group less their mean, over their deviation; zeros where they are equal."""
    x = pd.DataFrame({"case_id": case, "position": sorted(got), "reward": [got[p] for p in sorted(got)]})
    spread = x["reward"].std(ddof=0)
    x["advantage"] = 0.0 if spread < EPSILON else (x["reward"] - x["reward"].mean()) / (spread + EPSILON)
    x["complete"] = complete
    return x.astype({"position": "int32"})


def group_advantages(completions: DataFrame, size: int, wait: str = "1 hour") -> DataFrame:
    """case_id, position, reward, advantage, complete of a stream of (case_id, position, reward, ts as TIMESTAMP).

    A position that comes again is ignored, whatever its reward. A group of `size` positions is told at once, and then kept as done until the
    watermark passes, so late repeats tell nothing; a group that is not whole `wait` after its last completion is told as it is, with complete false. Rows without a
    case, position or reward are left out. State is one short list for each open case and lies in the checkpoint, so a restart repeats and
    loses nothing.
    """
    rows = completions.where("case_id is not null and position is not null and reward is not null").withWatermark("ts", wait)
    gap = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        positions, known, done = state.get if state.exists else ([], [], False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield _told(key[0], dict(zip(positions, known, strict=True)), False)
            return
        got, last = dict(zip(positions, known, strict=True)), state.getCurrentWatermarkMs()
        for b in batches:
            for p, r, at in zip(b["position"].tolist(), b["reward"].tolist(), b["ts"], strict=True):
                got.setdefault(int(p), float(r))
                last = max(last, int(at.timestamp() * 1000))
        whole = not done and len(got) >= size
        state.update((list(got), list(got.values()), done or whole))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + gap)
        if whole:
            yield _told(key[0], got, True)

    return rows.groupBy("case_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
