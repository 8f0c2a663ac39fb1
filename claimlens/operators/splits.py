"""Leak-free splits: hard negatives first, the rest cut by hash rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_rank, quota_table

#: Requested sizes of the splits, their template groups, and the labels of hard negatives.
SPLITS = {
    "train": 30000, "val_in_template": 2000, "val_unseen_template": 1000, "test_clean": 2000, "test_robust": 2000,
    "test_unseen_template": 2000, "test_hard_negative": 2000,
}
GROUPS = {
    "train": "train", "val_in_template": "train", "val_unseen_template": "val", "test_clean": "standard_test", "test_robust": "standard_test",
    "test_unseen_template": "strong_generalization_test", "test_hard_negative": "standard_test",
}
HARD_SPLIT = "test_hard_negative"
HARD_LABELS = ["amount_mismatch", "merchant_mismatch", "applicant_mismatch", "order_id_mismatch"]
SALT = 343


def template_group(split: str = "split"):
    pairs = [x for k, v in GROUPS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(split))


def assign_splits(labels: DataFrame, weights: dict[str, int] = SPLITS, salt: int | str = SALT, rows: int | None = None) -> DataFrame:
    """case_id, label and split of rows (case_id, label): hard labels fill the hard split up to its quota, then the rest is cut in order.

    Too few hard labels are made up from the head of the rest. Quotas follow largest remainders. One ranking does: with r a
    row's rank and h the hard labels up to it, the first `quota` hard labels are picked, and the rank among the rest is r
    less the picked ones before it, the lesser of h and the quota.
    """
    rows = labels.count() if rows is None else rows
    n_hard = labels.agg(F.count_if(F.col("label").isin(HARD_LABELS)).alias("_got"))
    quotas = quota_table(labels.sparkSession.range(1).select(F.lit(rows).cast("bigint").alias("n")), weights)
    hard = F.broadcast(quotas.where(F.col("label") == HARD_SPLIT).select(F.col("quota").alias("_hard_quota")))
    slim = labels.select("case_id", "label")
    able = F.coalesce(F.col("label").isin(HARD_LABELS), F.lit(False))
    ranked = global_rank(slim, "case_id", salt, name="_r", flag=able, rows=rows).crossJoin(hard)
    picked = able & (F.col("_r_flagged") <= F.col("_hard_quota"))
    ranked = ranked.withColumn("_at", F.when(picked, F.lit(-1)).otherwise(F.col("_r") - F.least("_r_flagged", "_hard_quota")))
    each = quotas.crossJoin(F.broadcast(n_hard)).select(
        "label", F.when(F.col("label") == HARD_SPLIT, -1).otherwise(F.col("pos")).alias("pos"),
        F.when(F.col("label") == HARD_SPLIT, F.greatest(F.col("quota") - F.col("_got"), F.lit(0))).otherwise(F.col("quota")).alias("quota"),
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranges = each.withColumn("hi", F.sum("quota").over(upto)).select(F.col("label").alias("split"), (F.col("hi") - F.col("quota")).alias("lo"), "hi")
    taken = labels.sparkSession.createDataFrame([(HARD_SPLIT, -2, -1)], "split string, lo bigint, hi bigint")
    cuts = F.broadcast(ranges.union(taken))
    return ranked.join(cuts, (F.col("_at") > F.col("lo")) & (F.col("_at") <= F.col("hi"))).select("case_id", "label", "split")
