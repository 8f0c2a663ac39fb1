"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, scratch, stored, with_counted


def _large(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
    return with_counted(both, least, ["a"]).where("b > a and b > m").select(F.col("m").alias("a"), "b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; links are a < b."""
    least = stored(links.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
    joined = with_counted(links, least, ["b"])
    return joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root for every node of links (a, b longs, a <> b); root is the smallest node reachable.

    Each round writes the links to the shared folder, so lineage stays short and a lost executor
    costs one round. Only two numbers a round come to the driver. No links give no rows.
    """
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    told = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    seen = now.agg(told.alias("m")).first()["m"]
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        with scratch() as made:
            new = stored(_small(stored(_large(now))))
        drop_stored(now, *(x for x in made if x is not new))
        now, last, seen = new, seen, new.agg(told.alias("m")).first()["m"]
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
