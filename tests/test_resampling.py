"""Bootstrap weights and errors, joins of ranks with many ranges, running totals, registries and lineages, against plain ones."""

import hashlib
import math
import random
import statistics

from pyspark.sql import functions as F

from claimlens.operators import audits, holdout, ranking, resampling, rewards


def plain_weights(key, n, seed=42):
    digits = [hashlib.sha256(f"{seed}:{key}:boot{b}".encode()).hexdigest() for b in range(-(-n // 16))]
    return [sum(digits[k // 16][k % 16 * 4 :][:4] >= s for s in resampling.STEPS) for k in range(n)]


def test_weights_are_poisson_and_the_same_for_equal_keys(spark):
    got = {r.id: r.w for r in spark.range(500).select("id", resampling.weights("id", 40).alias("w")).collect()}
    assert all(got[k] == plain_weights(k, 40) for k in (0, 7, 499))
    every = [w for ws in got.values() for w in ws]
    assert abs(statistics.mean(every) - 1) < 0.03 and abs(statistics.variance(every) - 1) < 0.06


def test_errors_of_a_share_and_of_paired_values(spark):
    rng = random.Random(1)
    rows = []
    for k in range(3000):
        base = rng.random() < 0.3
        rows += [(k, "a", float(base)), (k, "b", float(base or rng.random() < 0.05))]
    df = spark.createDataFrame([*rows, (9000, "a", None), (9001, "a", 1.0)], "k long, model string, v double")
    one = {r.model: r for r in resampling.bootstrap(df, ["model"], "k", "v", 128).collect()}
    assert one["b"].n == 3000 and abs(one["b"].se / math.sqrt(one["b"].mean * (1 - one["b"].mean) / 3000) - 1) < 0.3
    d = resampling.paired_difference(df, [], "k", "model", "v", "b", "a", 128).first()
    diffs = [b[2] - a[2] for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert d.n == 3000 and abs(d["mean"] - statistics.mean(diffs)) < 1e-12
    assert abs(d.se / (statistics.stdev(diffs) / math.sqrt(3000)) - 1) < 0.3
    assert d.se < 0.7 * math.hypot(one["a"].se, one["b"].se)  # pairing counts: errors of unpaired values would be far larger
    ws = {k: plain_weights(k, 128) for k in range(3000)}
    means = [sum(ws[k][b] * x for k, x in enumerate(diffs)) / sum(ws[k][b] for k in range(3000)) for b in range(128)]
    assert abs(d.se - statistics.stdev(means)) < 1e-9
    assert resampling.bootstrap(df.limit(0), ["model"], "k", "v").count() == 0


def test_ranks_and_many_ranges(spark):
    rng, at, ranges = random.Random(2), 0, []
    for k in range(400):
        size = rng.choice([0, 0, 1, 2, 5, 40])
        ranges.append((k, at, at + size))
        at += size + rng.choice([0, 0, 3])
    df = spark.createDataFrame(ranges, "k long, lo long, hi long")
    ranked = spark.range(1, at + 20).withColumnRenamed("id", "rank")
    want = {(r, k) for k, lo, hi in ranges for r in range(lo + 1, hi + 1)}
    for width in (1, 7, 100, 10**6):
        out = ranking.by_ranges(ranked, df, width=width)
        assert {(r.rank, r.k) for r in out.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking.by_ranges(ranked, df, width=7)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_million_quotas(spark):
    """A range of three for each of a million: every rank meets one range."""
    n = 1_000_000
    ranges = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 3).alias("hi"))
    out = ranking.by_ranges(spark.range(1, 3 * n + 1, 50).withColumnRenamed("id", "rank"), ranges)
    assert out.agg(F.count("*"), F.count_if(F.col("k") != F.floor((F.col("rank") - 1) / 3))).first()[:] == (3 * n // 50, 0)


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(k * 37 % 5003 - 2000, rng.randint(-3, 9)) for k in range(1500)]
    got = {r.k: r.total for r in ranking.running_total(spark.createDataFrame(rows, "k long, v long"), "k", "v", width=100).collect()}
    total = 0
    for k, v in sorted(rows):
        total += v
        assert got[k] == total


def test_registry_is_the_plain_digest(spark):
    rng = random.Random(4)
    ids = [(rng.choice(["a", "b", None]), f"é{rng.randrange(300)}") for _ in range(900)] + [("a", None), ("lone", "x")]
    got = {r.g: (r.n, r.digest) for r in holdout.registry_digest(spark.createDataFrame(ids, "g string, id string").repartition(7), ["g"]).collect()}
    for g in {g for g, _ in ids}:
        own = sorted({i for h, i in ids if h == g and i is not None}, key=str.encode)
        assert got[g] == (len(own), hashlib.sha256("".join(f"{i}\n" for i in own).encode()).hexdigest())
    assert holdout.registry_digest(spark.createDataFrame([], "g string, id string"), ["g"]).count() == 0


def test_long_lineage_and_circles(spark):
    chain = [(f"m{k}", f"m{k - 1}" if k else None) for k in range(70)] + [("lost", "gone"), ("child", "lost"), ("x", "y"), ("y", "x")]
    got = {r.model_id: r.depth for r in audits.ancestry(spark.createDataFrame(chain, "model_id string, parent_model_id string")).collect()}
    assert got == {**{f"m{k}": k for k in range(70)}, "lost": 0, "child": 1}


def test_batches_of_any_size(spark):
    rows = [(k % 3 if k % 7 else None, w) for k, w in enumerate([0.0, 1.0, 5.0, -2.0, 2.5] * 20)]
    got = rewards.batch_weights(spark.createDataFrame(rows, "b int, final_weight double"), ["b"]).collect()
    assert len(got) == 100
    for b in {0, 1, 2, None}:
        own = [r for r in got if r.b == b]
        mean = statistics.mean(min(max(w, 0.0), 3.0) for x, w in rows if x == b)
        assert all(abs(r.weight - min(max(r.final_weight, 0.0), 3.0) / mean) < 1e-12 for r in own) and abs(statistics.mean(r.weight for r in own) - 1) < 1e-9
