"""Repair packs and mixes: anomaly families, candidate scores, quotas with fills, roles, audits and the preflight."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import reasons
from .ranking import by_bucket_quota, global_rank
from .storing import stored

#: Families in the order in which quotas go to them, and those that always score.
FAMILIES = ["amount_abnormal", "order_id_inconsistent", "evidence_or_document_insufficient", "date_mismatch", "person_mismatch", "merchant_mismatch", "duplicate_in_batch"]
CORE_FAMILIES = FAMILIES[:3]
STRATEGIES = {
    "amount_abnormal": "SFT reinforce amount cross-check: invoice/payment/order/reimbursement amounts must agree before pass.",
    "order_id_inconsistent": "SFT reinforce order-id and order-document consistency with explicit reject/manual-review evidence.",
    "evidence_or_document_insufficient": "Rule-constrained SFT: missing/unsupported evidence must not be promoted to pass.",
}
STRATEGY_REJECT = "SFT reinforce high-risk reject decision with complete evidence and bbox references."
STRATEGY_OTHER = "SFT reinforce anomaly-to-risk-to-audit decision consistency."
PERSONS = ["person_mismatch", "applicant_mismatch", "payer_mismatch", "order_user_mismatch"]


def anomaly_family(answer: Column, primary: Column | None = None) -> Column:
    """The family of an answer's anomalies and flags, the first that fits; unknown without an answer."""
    none = F.array().cast("array<string>")
    own = F.coalesce(answer["anomaly_types"], none)
    named = F.when(F.coalesce(primary, F.lit("none")).isin("none", ""), none).otherwise(F.array(primary)) if primary is not None else none
    tags = F.array_union(own, named)
    like = lambda word: F.exists(tags, lambda t: F.contains(t, F.lit(word)))
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    flag = lambda name, value: F.coalesce(answer["consistency_check"][name] == value, F.lit(False))
    return (
        F.when(answer.isNull(), "unknown").when(like("amount") | has("over_reimbursement") | flag("amount_consistent", False), "amount_abnormal")
        .when(like("order") | flag("order_id_consistent", False), "order_id_inconsistent")
        .when(has("missing_document", "unreadable_image") | like("evidence") | flag("document_complete", False), "evidence_or_document_insufficient")
        .when(has("date_mismatch") | flag("date_reasonable", False), "date_mismatch").when(has("merchant_mismatch") | flag("merchant_consistent", False), "merchant_mismatch")
        .when(has(*PERSONS) | flag("person_consistent", False), "person_mismatch").when(has("duplicate_in_batch") | flag("duplicate_in_batch", True), "duplicate_in_batch")
        .when(F.size(tags) == 0, "clean_or_low_risk").otherwise(F.array_min(tags))
    )


def repair_strategy(family: Column, audit_result: Column) -> Column:
    out = F.when(family == CORE_FAMILIES[0], STRATEGIES[CORE_FAMILIES[0]])
    for f in CORE_FAMILIES[1:]:
        out = out.when(family == f, STRATEGIES[f])
    return out.when(audit_result == "reject_recommendation", STRATEGY_REJECT).otherwise(STRATEGY_OTHER)


def candidate_score(answer: Column, family: Column, targets: list[str]) -> Column:
    """How much an answer has to teach: high risk, rejection, family, and evidence that has boxes and documents."""
    whole = (F.size(answer["evidence"]) > 0) & F.forall(answer["evidence"], lambda e: e["bbox"].isNotNull() & e["source_doc_type"].isNotNull())
    return (
        F.when(answer["risk_level"] == "high", 5).otherwise(0)
        + F.when(answer["audit_result"] == "reject_recommendation", 5).when(answer["audit_result"].isin("manual_review", "missing_info"), 3).otherwise(0)
        + F.when(family.isin(list(targets)), 3).otherwise(0) + F.when(family.isin(CORE_FAMILIES), 2).otherwise(0) + F.when(F.coalesce(whole, F.lit(False)), 2).otherwise(0)
    )


def excluded_ids(sources: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """source, key: the ids that must not be used, by where they are used already."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct() for name, df in sources.items()))


def without(rows: DataFrame, excluded: DataFrame, key: str = "case_id") -> DataFrame:
    """rows whose id is in none of the excluded sources."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def repair_pack(rows: DataFrame, excluded: DataFrame, most: int, targets: list[str] | None = None) -> DataFrame:
    """case_id, family, score, strategy, evidence_count of the chosen high-risk rows (case_id, source_split, answer).

    Rows from train that are high, not passed, have evidence and are not excluded are candidates. Each family, in order, gives
    its best up to an even share; the best of the rest fill up to `most`. At most `most` of each family are ordered together.
    """
    pool = without(rows, excluded).where((F.col("source_split") == "train") & (F.col("answer.risk_level") == "high") & (F.col("answer.audit_result") != "pass") & (F.size("answer.evidence") > 0))
    pool = pool.withColumn("family", anomaly_family(F.col("answer")))
    pool = stored(pool.select(
        "case_id", "family", candidate_score(F.col("answer"), F.col("family"), targets or CORE_FAMILIES).alias("score"),
        repair_strategy(F.col("family"), F.col("answer.audit_result")).alias("repair_strategy"), F.size("answer.evidence").alias("evidence_count"),
    ))  # a few columns, read twice below, instead of answers made twice
    own = Window.partitionBy("family").orderBy(F.desc("score"), "case_id")
    ranked = pool.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most)
    there = pool.where(F.col("family").isin(FAMILIES)).agg(F.count_distinct("family").alias("_k"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.col("_k"), F.lit(1))))
    at = F.coalesce(*(F.when(F.col("family") == f, k) for k, f in enumerate(FAMILIES)), F.lit(len(FAMILIES)))
    x = ranked.crossJoin(F.broadcast(there)).withColumn("_fill", ~(F.col("family").isin(FAMILIES) & (F.col("_r") <= quota)))
    order = [F.col("_fill"), F.when(F.col("_fill"), 0).otherwise(at), F.when(F.col("_fill"), -F.col("score")).otherwise(F.col("_r")), F.when(F.col("_fill"), F.col("family")), "case_id"]
    return x.orderBy(*order).limit(most).select("case_id", "family", "score", "repair_strategy", "evidence_count", F.col("_fill").alias("filled"))


def calibration_bucket(answer: Column, missing_info: bool = False) -> Column:
    """low_pass, medium_or_manual_review or null; the later mixes count missing_info as the second."""
    results = ["manual_review", "missing_info"] if missing_info else ["manual_review"]
    return F.when((answer["risk_level"] == "low") & (answer["audit_result"] == "pass"), "low_pass").when(
        (answer["risk_level"] == "medium") | answer["audit_result"].isin(results), "medium_or_manual_review")


def with_role(rows: DataFrame, mix: str, role: str, bucket: str | None = None) -> DataFrame:
    """rows with repair_mix_metadata: mix, role and bucket, added to what the struct holds already."""
    fields = {"mix": F.lit(mix), "role": F.lit(role), "bucket": F.col(bucket) if bucket else F.lit(None).cast("string")}
    if "repair_mix_metadata" not in rows.columns:
        return rows.withColumn("repair_mix_metadata", F.struct(*(v.alias(k) for k, v in fields.items())))
    x = F.col("repair_mix_metadata")
    for k, v in fields.items():
        x = x.withField(k, v)
    return rows.withColumn("repair_mix_metadata", x)


def repair_mix(pack: DataFrame, rows: DataFrame, excluded: DataFrame, n: int, salt: int | str, mix: str, missing_info: bool = False) -> DataFrame:
    """case_id, repair_mix_metadata, filled: the pack's cases, and n calibration cases: two thirds low, one third medium, filled where short."""
    low = round(n * 2 / 3)
    pool = without(rows, excluded).join(pack.select("case_id"), "case_id", "left_anti").withColumn("bucket", calibration_bucket(F.col("answer"), missing_info)).where("bucket is not null")
    picked = by_bucket_quota(pool.select("case_id", "bucket"), "case_id", "bucket", {"low_pass": low, "medium_or_manual_review": n - low}, salt, n)
    calibration = with_role(picked, mix, "calibration", "bucket").select("case_id", "repair_mix_metadata", "filled")
    return with_role(pack, mix, "repair").select("case_id", "repair_mix_metadata", F.lit(False).alias("filled")).unionByName(calibration)


def in_roles(parts: list[tuple[str, DataFrame]], key: str = "case_id") -> DataFrame:
    """All rows of the parts with role and their place: parts in order, within a part by key; a key stays in its first part only."""
    every = reduce(DataFrame.unionByName, (df.select(key, F.lit(k).alias("_part"), F.lit(role).alias("role")) for k, (role, df) in enumerate(parts)))
    first = every.groupBy(key).agg(F.min_by("role", "_part").alias("role"), F.min("_part").alias("part"))
    return first.select(key, "role", "part")


def repair_audit(rows: DataFrame, valid: Column, boundaries: dict[str, DataFrame], train: DataFrame, key: str = "case_id") -> DataFrame:
    """check, n of a repair set: rows, different ids, repeated ids, invalid answers, ids in each boundary, ids that are not in train."""
    ids = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~valid).alias("bad"))
    base = ids.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.sum("bad").alias("invalid_answers"))
    out = base.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n")) for c in base.columns))))
    for name, other in boundaries.items():
        out = out.unionByName(ids.join(other.select(key).distinct(), key, "left_semi").agg(F.lit(f"in_{name}").alias("check"), F.count("*").alias("n")))
    return out.unionByName(ids.join(train.select(key).distinct(), key, "left_anti").agg(F.lit("not_train").alias("check"), F.count("*").alias("n")))


def preflight(audit: DataFrame, rows: int, world: int = 1, batch: int = 1, accumulate: int = 1, epochs: float = 1, adapter_there: bool = True, overwrites: bool = False) -> DataFrame:
    """One row: status, hard_failures and optimizer_updates before a repair run, from repair_audit's checks."""
    facts = audit.agg(
        F.sum(F.when(F.col("check") == "repeated_ids", F.col("n"))).alias("repeated"), F.sum(F.when(F.col("check") == "invalid_answers", F.col("n"))).alias("invalid"),
        F.sum(F.when(F.startswith("check", F.lit("in_")), F.col("n"))).alias("leaks"), F.sum(F.when(F.col("check") == "not_train", F.col("n"))).alias("foreign"), F.sum(F.when(F.col("check") == "missing_images", F.col("n"))).alias("images"),
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    failures = reasons(
        (F.lit(not adapter_there), "ADAPTER_MISSING"), (F.lit(overwrites), "OUTPUT_DIR_WOULD_OVERWRITE"), (some("images"), "REPAIR_DATA_MISSING_IMAGES"), (some("repeated"), "REPAIR_DATA_DUPLICATE_IDS"),
        (some("invalid"), "REPAIR_DATA_INVALID_JSON_OR_SCHEMA"), (some("leaks"), "REPAIR_DATA_LEAKAGE"), (some("foreign"), "REPAIR_DATA_NOT_TRAIN_ONLY"),
    )
    updates = math.ceil(rows / max(1, world * batch * accumulate)) * epochs if rows else 0
    return facts.select(failures.alias("hard_failures")).select(
        F.when(F.size("hard_failures") == 0, "READY").otherwise("NOT_READY").alias("status"), "hard_failures", F.lit(float(updates)).alias("optimizer_updates"), F.lit(30 <= updates <= 60).alias("in_target_range"))


def sampled(rows: DataFrame, key: str, n: int, salt: int | str) -> DataFrame:
    """n rows in hash order of their key."""
    return global_rank(rows, key, salt, name="_r").where(F.col("_r") <= n).drop("_r")
