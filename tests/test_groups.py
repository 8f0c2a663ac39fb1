"""Group advantages as a stream against the batch: whole groups, repeats, a wait that ends, and a restart."""

import json

from pyspark.sql import functions as F

from claimlens.operators import rewards
from claimlens.streaming import groups, progress


def test_stream_equals_batch_and_restarts_repeat_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = {f"c{k}": [(p, (k * 7 + p * p * 3) % 5 / 4 if k != 2 else 0.5) for p in range(4)] for k in range(6)}
    seen = []

    def write(name, items):
        (folder / name).write_text("".join(json.dumps({"case_id": c, "position": p, "reward": r, "t": t}) + "\n" for c, p, r, t in items))

    def run():
        stream = progress.followed(spark, f"file://{folder}", "case_id string, position int, reward double, t string").select("case_id", "position", "reward", F.to_timestamp("t").alias("ts"))
        q = groups.group_advantages(stream, 4, "10 minutes").writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    first = [(c, p, r, "2024-01-01 00:00:00") for c, ps in rows.items() for p, r in ps if (c, p) not in {("c4", 3), ("c5", 0), ("c5", 1)}]
    write("a.jsonl", [*first, ("c0", 1, 99.0, "2024-01-01 00:00:01"), (None, 1, 1.0, "2024-01-01 00:00:01")])
    run()
    assert {s[0] for s in seen} == {"c0", "c1", "c2", "c3"} and len(seen) == 16
    write("b.jsonl", [("c4", 3, rows["c4"][3][1], "2024-01-01 00:01:00"), ("c1", 0, 5.0, "2024-01-01 00:01:00")])
    run()
    assert len(seen) == 20
    write("c.jsonl", [("late", 0, 1.0, "2024-01-01 01:00:00")])
    run()
    write("d.jsonl", [("late", 1, 1.0, "2024-01-01 01:00:01")])
    run()
    assert len(seen) == 22 and {s[0] for s in seen[20:]} == {"c5"} and not any(s[4] for s in seen[20:])
    whole = {(c, p): a for c, p, _, a, complete in seen if complete}
    table = [(c, p, r) for c in ("c0", "c1", "c2", "c3", "c4") for p, r in rows[c]]
    batch = rewards.normalised(spark.createDataFrame(table, "case_id string, position int, reward double"), ["case_id"]).collect()
    assert {(r.case_id, r.position) for r in batch} == set(whole) and all(abs(r.advantage - whole[r.case_id, r.position]) < 1e-9 for r in batch)
