"""Bootstrap errors by weights that a hash of key and replicate gives, the same in every engine and for every model of a case.

In each replicate a row counts as often as a Poisson draw of mean 1 says, read from four hex digits of a SHA-256. A group is one pair of running
sums for each replicate, which tasks add up before anything is sent, so no table is made anew and groups of any size merge. As
weights depend on the key alone, two models' values of one case are drawn together, and their difference has the error of paired values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, factorial, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

REPLICATES, EACH = 64, 16
#: A draw is how many of these its digits reach: the shares of Poisson draws of up to 0, 1, 2 ... in four hex digits.
STEPS = [f"{floor(65536 * sum(exp(-1) / factorial(j) for j in range(k + 1))):04x}" for k in range(8)]


def weights(key: str, replicates: int = REPLICATES, seed: int = 42) -> Column:
    """array<int>: the draw of each replicate."""
    def draws(block: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":boot"), block.cast("string")), 256)
        at = lambda d: F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), lambda j: F.substring(d, j * 4 + 1, F.lit(4)))
        reached = lambda u: sum(((u >= s).cast("int") for s in STEPS), F.lit(0))
        return F.transform(F.element_at(F.transform(F.array(digest), at), 1), reached)

    blocks = -(-replicates // EACH)
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), draws)), 1, replicates)


def weights_sql(key: str, b: str, seed: int = 42) -> str:
    """The draw of replicate b in DuckDB."""
    u = f"substr(sha256('{seed}:' || {key} || ':boot' || ({b} // {EACH})), ({b} % {EACH}) * 4 + 1, 4)"
    return f"list_sum(list_transform([{', '.join(repr(s) for s in STEPS)}], lambda s: ({u} >= s)::INT))"


def _errors(rows: DataFrame, by: list[str], key: str, value: Column, replicates: int, seed: int) -> DataFrame:
    """by, n, mean, se; the draws of weights(), made for whole batches: a batch sends one row of sums for each group and replicate.

    A null key weighs nothing, as digits of zeros do.
    """
    digests = [F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(f":boot{k}")), 256)) for k in range(-(-replicates // EACH))]
    x = rows.select(*by, value.cast("double").alias("_v"), F.coalesce(F.concat(*digests), F.lit(bytes(32 * len(digests)))).alias("_d"))
    steps, wide = np.array([int(s, 16) for s in STEPS]), 2 * EACH * len(digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = np.zeros(b.num_rows, np.int64)
            for c in by:
                at = b[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * (int(at.max()) + 1) + at, return_inverse=True)[1].astype(np.int64)
            order = np.argsort(group, kind="stable")
            begin = np.flatnonzero(np.diff(group[order], prepend=-1))
            drawn = np.frombuffer(b"".join(b["_d"].to_pylist()), ">u2").reshape(b.num_rows, wide // 2)[order, :replicates]
            w = np.searchsorted(steps, drawn.ravel(), side="right").reshape(drawn.shape)
            v = b["_v"].to_numpy(zero_copy_only=False)[order]
            add = lambda m: np.add.reduceat(m, begin, axis=0)
            first = pa.array(np.repeat(order[begin], replicates))
            yield pa.RecordBatch.from_arrays(
                [*(b[c].take(first) for c in by), pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(begin))), pa.array(add(w).ravel()), pa.array(add(w * v[:, None]).ravel()),
                 pa.array(np.repeat(add(v), replicates)), pa.array(np.repeat(np.diff(begin, append=len(v)), replicates))],
                names=[*by, "_b", "_sw", "_swv", "_sv", "_n"])

    told = reduce(lambda t, c: t.add(c[0], c[1]), (("_b", IntegerType()), ("_sw", LongType()), ("_swv", DoubleType()), ("_sv", DoubleType()), ("_n", LongType())), x.select(*by).schema)
    sums = x.mapInArrow(run, told).groupBy(*by, "_b").agg(*(F.sum(c).alias(c) for c in ("_sw", "_swv", "_sv", "_n")))
    means = sums.withColumn("_m", F.try_divide("_swv", F.col("_sw").cast("double")))
    return means.groupBy(*by).agg(F.max("_n").alias("n"), (F.max("_sv") / F.max("_n")).alias("mean"), F.coalesce(F.stddev_samp("_m"), F.lit(0.0)).alias("se"))


def bootstrap(rows: DataFrame, by: list[str], key: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """by, n, mean, se of a value over rows, one for each key and group; null values are left out, an empty table gives no row (one of nulls without groups)."""
    return _errors(rows.where(F.col(value).isNotNull()), by, key, F.col(value), replicates, seed)


def paired_difference(rows: DataFrame, by: list[str], key: str, model: str, value: str, one: str, other: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """by, n, mean, se of the difference one - other over the keys that both models have (the largest value of a key that repeats)."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(value).cast("double")))
    both = rows.groupBy(*by, key).agg((of(one) - of(other)).alias("_d")).where("_d is not null")
    return _errors(both, by, key, F.col("_d"), replicates, seed)
