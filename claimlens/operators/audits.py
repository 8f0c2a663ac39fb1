"""Id registries, overlaps, shard merges, resumption and model lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storing import stored


def registry(sources: dict[str, DataFrame], id_col: str) -> DataFrame:
    """source, id: the distinct ids of each source."""
    parts = (df.select(F.lit(name).alias("source"), F.col(id_col).cast("string").alias("id")).where("id is not null").distinct() for name, df in sources.items())
    return reduce(DataFrame.unionByName, parts)


def overlap_matrix(ids: DataFrame) -> DataFrame:
    """a, b, n of rows (source, id), each once: ids that two different sources share; a < b."""
    left, right = (ids.select(F.col("source").alias(c), "id") for c in "ab")
    return left.join(right, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def merge_audit(expected: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """One row: missing, extra and repeated keys of the shards against what was expected."""
    have = shards.groupBy(key).agg(F.count("*").alias("_n"))
    both = expected.select(key, F.lit(True).alias("_want")).distinct().join(have, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("repeated"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    )


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key is not done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def orphans(models: DataFrame) -> DataFrame:
    """Models that name a parent that is not there."""
    parents = models.select(F.col("model_id").alias("parent_model_id")).distinct()
    return models.where("parent_model_id is not null").join(parents, "parent_model_id", "left_anti")


def ancestry(models: DataFrame) -> DataFrame:
    """model_id, depth: steps to a model without a known parent; of a chain of any length. Models that are their own ancestors have none.

    Each round joins every model that has not arrived with the ancestor reached so far and doubles the reach, so chains of n models take
    log2(n) rounds; each is written once. Rounds end when all have arrived, or none is left but circles.
    """
    own = models.select("model_id", "parent_model_id")
    known = own.select(F.col("model_id").alias("_known"))
    up = stored(own.join(known, F.col("parent_model_id") == F.col("_known"), "left").select("model_id", F.col("_known").alias("up"), F.when(F.col("_known").isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(max(1, own.count()).bit_length()):
        if not up.where("up is not null").limit(1).count():
            break
        above = up.select(F.col("model_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        up = stored(up.join(above, F.col("up") == F.col("_id"), "left").select("model_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    return up.where("up is null").select("model_id", "depth")
