"""Global ranks, allocation and sampling that need no single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_order


def digits_for(rows: int | None, each: int = 100_000) -> int:
    """Hex digits of a hash head that deal rows to buckets of about `each`: three (4096 buckets) to five (a million)."""
    return 3 if not rows else min(5, max(3, math.ceil(math.log(max(rows / each, 1), 16))))


def global_rank(
    df: DataFrame, key: str, salt: int | str, by: list[str] | None = None, name: str = "rank", flag: Column | None = None,
    counted: DataFrame | None = None, rows: int | None = None,
) -> DataFrame:
    """A 1-based rank by hash_order(key, salt), in each group of `by` (or over all rows).

    Rows are dealt to buckets by the head of the hash, ranked within their bucket, and moved up by the
    sizes of the buckets before; only those sizes are ordered together. With `flag`, {name}_flagged is
    how many flagged rows there are up to a row, itself included. `counted`, a cheaper frame with
    the same keys (and `by`), is what the buckets are counted on; `rows` sets how many buckets there are.
    """
    by, digits = by or [], digits_for(rows)
    mark = F.coalesce(flag, F.lit(False)).cast("bigint") if flag is not None else F.lit(0).cast("bigint")
    dealt = lambda x: x.withColumn("_h", hash_order(key, salt)).withColumn("_b", F.substring("_h", 1, digits)).withColumn("_f", mark)
    before = Window.partitionBy(*[f"_by{k}" for k in range(len(by))]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt(df if counted is None else counted).groupBy(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_b").alias("_bucket")).agg(F.count("*").alias("_n"), F.sum("_f").alias("_m"))
    sizes = sizes.select(*[f"_by{k}" for k in range(len(by))], "_bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_m")))
    same = F.col("_b") == F.col("_bucket")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    own = Window.partitionBy(*by, "_b").orderBy("_h", key)
    joined = dealt(df).join(sizes if by else F.broadcast(sizes), same)
    out = joined.withColumn(name, F.row_number().over(own) + F.col("_n_before"))
    if flag is not None:
        out = out.withColumn(f"{name}_flagged", F.sum("_f").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_m_before"))
    return out.drop("_h", "_b", "_f", "_bucket", "_n_before", "_m_before", *[f"_by{k}" for k in range(len(by))])


def largest_remainder(total: int, weights: dict[str, int]) -> dict[str, int]:
    """total dealt out by whole-number weights; ties go to the larger weight, then the earlier name."""
    whole = sum(weights.values())
    if total <= 0 or whole <= 0:
        return dict.fromkeys(weights, 0)
    counts = {k: total * w // whole for k, w in weights.items()}
    left = total - sum(counts.values())
    order = sorted(weights, key=lambda k: (total * weights[k] % whole, weights[k]), reverse=True)
    for k in order[:left]:
        counts[k] += 1
    return counts


def quota_table(totals: DataFrame, weights: dict[str, int], n: str = "n") -> DataFrame:
    """label, pos, quota, lo, hi for a one-row table with the total n, by largest remainder, as a plan.

    The same as largest_remainder, without bringing n to the driver.
    """
    spark = totals.sparkSession
    whole = sum(weights.values())
    names = spark.createDataFrame([(k, i, w) for i, (k, w) in enumerate(weights.items())], "label string, pos int, w bigint")
    x = names.crossJoin(F.broadcast(totals.select(F.col(n).alias("_n"))))
    x = x.withColumns({"base": F.expr(f"_n * w div {whole}"), "frac": F.expr(f"_n * w % {whole}")})
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.desc("frac"), F.desc("w"), "pos"))
    x = x.withColumn("quota", F.col("base") + (rank <= F.col("_n") - F.sum("base").over(every)).cast("bigint"))
    upto = every.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota")).select("label", "pos", "quota", "lo", "hi")


def by_quota(ranked: DataFrame, quotas: DataFrame, rank: str = "rank", label: str = "label") -> DataFrame:
    """ranked rows with the label whose range (lo, hi] holds their rank; quotas is a handful of rows."""
    q = F.broadcast(quotas.select(F.col("label").alias(label), "lo", "hi"))
    return ranked.join(q, (F.col(rank) > F.col("lo")) & (F.col(rank) <= F.col("hi"))).drop("lo", "hi")


def by_ranges(ranked: DataFrame, ranges: DataFrame, rank: str = "rank", width: int = 100_000) -> DataFrame:
    """ranked rows with the columns of the range (lo, hi] that holds their rank, for any number of ranges that do not overlap.

    Ranks are dealt to buckets of `width`; a range is cut at the bounds of buckets and joined on the bucket, so neither side is
    broadcast for its size and no bucket has more ranks or ranges than width. Empty ranges hold nothing; ranks outside all ranges go.
    """
    first, last = (F.floor((c - F.lit(1)) / width) for c in (F.col("lo") + 1, F.col("hi")))
    cut = ranges.where("hi > lo").withColumn("_bucket", F.explode(F.sequence(first, last)))
    inside = (F.col("_at") == F.col("_bucket")) & (F.col(rank) > F.col("lo")) & (F.col(rank) <= F.col("hi"))
    return ranked.withColumn("_at", F.floor((F.col(rank) - 1) / width)).join(cut, inside).drop("_at", "_bucket")


def running_total(df: DataFrame, order: str, value: str, name: str = "total", width: int = 100_000) -> DataFrame:
    """df with the sum of value up to each row in the order of a whole-number key, itself included; by buckets of keys, without a single-task sort."""
    dealt = df.withColumn("_b", F.floor(F.col(order) / width))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("_b").alias("_bucket")).agg(F.sum(value).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(sizes, F.col("_b") == F.col("_bucket")).withColumn(name, F.sum(value).over(own) + F.col("_before")).drop("_b", "_bucket", "_before")


def stratified(df: DataFrame, key: str, strata: list[str], n: int | str, salt: int | str, within: list[str] | None = None) -> DataFrame:
    """n rows spread over the strata in proportion to their size, by largest remainder, hash-ordered.

    Of equal remainders the stratum that sorts last gets one more; no stratum gives more than it has, and if n is at least
    all rows, all are taken. With `within`, that is done in each of its groups, and n may be a column of them.
    """
    within = within or []
    wanted = F.col(n) if isinstance(n, str) else F.lit(n)
    each = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    sizes = df.groupBy(*within, *strata, *([n] if isinstance(n, str) else [])).agg(F.count("*").alias("_size")).withColumn("_all", F.sum("_size").over(each))
    q = sizes.withColumn("_n", F.least(wanted, "_all")).withColumns({"_base": F.expr("_n * _size div _all"), "_frac": F.expr("_n * _size % _all")})
    last = F.row_number().over(each.orderBy(F.desc("_frac"), *(F.desc(s) for s in strata))) <= F.col("_n") - F.sum("_base").over(each)
    q = q.withColumn("_quota", F.col("_base") + last.cast("bigint")).select(*(F.col(c).alias(f"_q_{c}") for c in within + strata), "_quota")
    ranked = global_rank(df, key, salt, within + strata, "_rank")
    same = F.lit(True)
    for c in within + strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return ranked.join(q, same).where("_rank <= _quota").drop("_rank", "_quota", *(f"_q_{c}" for c in within + strata))


def equal_quotas(groups: DataFrame, within: list[str], label: str, n: int, name: str = "quota") -> DataFrame:
    """groups (one row for each `within` and label) with n dealt evenly, the remainder to the labels that sort first."""
    each = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    k, idx = F.count("*").over(each), F.row_number().over(each.orderBy(label)) - 1
    return groups.withColumn(name, F.expr("0L") + F.floor(F.lit(n) / k) + (idx < F.pmod(F.lit(n), k)).cast("bigint"))


def round_robin(df: DataFrame, key: str, strata: list[str], n: int, salt: int | str, name: str = "turn", within: list[str] | None = None) -> DataFrame:
    """The n rows (of each group of `within`) drawn first if the strata, in their order, give one row each in turn, hash-ordered.

    No stratum is asked more than n times, so what is ordered together is at most n rows of each; `name` is the turn.
    """
    within = within or []
    ranked = global_rank(df, key, salt, within + strata, name).where(F.col(name) <= n)
    if not within:
        return ranked.orderBy(name, *strata, key).limit(n)
    return ranked.withColumn("_p", F.row_number().over(Window.partitionBy(*within).orderBy(name, *strata, key))).where(F.col("_p") <= n).drop("_p")


def sharded(df: DataFrame, position: str, n: int, name: str = "shard") -> DataFrame:
    """Shard of a 1-based position, round robin."""
    return df.withColumn(name, F.pmod(F.col(position) - 1, F.lit(n)).cast("int"))


def spread_over_two(df: DataFrame, key: str, strata: list[str], quota: int, salt: int | str, name: str = "part") -> DataFrame:
    """Two disjoint sets of up to quota rows, drawn by turns from the strata: 1 takes odd ranks, 2 even ones; then 2 is topped up."""
    ranked = global_rank(df, key, salt, strata, "_r").where(F.col("_r") <= 2 * quota)
    first = ranked.where("_r % 2 = 1").orderBy("_r", *strata, key).limit(quota).withColumn(name, F.lit(1))
    rest = ranked.join(first.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    second = rest.orderBy((F.col("_r") % 2), "_r", *strata, key).limit(quota).withColumn(name, F.lit(2))
    return first.unionByName(second).drop("_r")


def by_bucket_quota(df: DataFrame, key: str, bucket: str, quotas: dict[str, int], salt: int | str, total: int | None = None) -> DataFrame:
    """Rows by hash order up to each bucket's quota; what is short of `total` is filled from what is left, bucket by bucket.

    Each bucket gives at most `total` rows, so the fill orders a bounded table. Adds `filled`.
    """
    total = sum(quotas.values()) if total is None else total
    names = list(quotas)
    at = F.create_map(*(x for k, b in enumerate(names) for x in (F.lit(b), F.lit(k))))
    quota = F.create_map(*(x for b, q in quotas.items() for x in (F.lit(b), F.lit(q))))
    ranked = global_rank(df.where(F.col(bucket).isin(names)), key, salt, [bucket], "_r").where(F.col("_r") <= total)
    ranked = ranked.withColumns({"filled": F.col("_r") > F.element_at(quota, F.col(bucket)), "_at": F.element_at(at, F.col(bucket))})
    return ranked.orderBy("filled", "_at", "_r").limit(total).drop("_r", "_at")
