"""Rewards of completions against true answers, their normalisation in groups, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, held, rate, same_set
from .scoring import score

#: What each part of a reward weighs.
WEIGHTS = {
    "r_field": 0.15, "r_consistency": 0.15, "r_anomaly": 0.20, "r_audit": 0.15, "r_evidence": 0.15, "r_json": 0.10, "r_uncertainty": 0.10, "r_order_id_pair": 0.25,
    "p_hallucination": -0.20, "p_high_risk_miss": -0.40, "p_missing_order_id_pair": -0.50, "p_false_escalation": -0.40,
}
#: Below this standard deviation a group's rewards are taken as equal; it is also added to the divisor.
EPSILON = 1e-6


def order_id_pair(evidence: Column) -> Column:
    """struct<o, r>: the first order id that is not empty in the evidence of the order and of the reimbursement form."""
    first = lambda d: F.get(F.filter(evidence, lambda x: (x["field"] == "order_id") & (x["source_doc_type"] == d) & (F.coalesce(x["value"], F.lit("")) != "")), F.lit(0))["value"]
    return F.struct(first("order").alias("o"), first("reimbursement_form").alias("r"))


def uncertainty_score(truth: Column, pred: Column) -> Column:
    """Share of the three parts of uncertainty that agree."""
    t, p = truth["uncertainty"], pred["uncertainty"]
    return (
        t["has_uncertain_fields"].eqNullSafe(p["has_uncertain_fields"]).cast("int") + same_set(t["uncertain_fields"], p["uncertain_fields"]).cast("int")
        + t["requires_manual_review"].eqNullSafe(p["requires_manual_review"]).cast("int")
    ) / F.lit(3.0)


def false_escalation() -> Column:
    """A low claim that should pass is called high or rejected; the scorer's own definition is any result but pass."""
    return (F.col("true_risk") == "low") & (F.col("true_audit") == "pass") & F.coalesce((F.col("pred_risk") == "high") | (F.col("pred_audit") == "reject_recommendation"), F.lit(False))


def weighted(details: dict[str, Column]) -> Column:
    return clip(sum((F.lit(w) * details[k] for k, w in WEIGHTS.items()), F.lit(0.0)))


def reward(pairs: DataFrame, *keep: str) -> DataFrame:
    """case_id, model, the kept columns, reward and its twelve parts, of rows as score() takes them.

    -1, with only r_json where the text parses, for what is no JSON, does not meet the contract, lets a high risk pass, or a
    missing document pass, in that order. Elsewhere the weighted sum within -1 to 1; at most 0 if an order id mismatch is not
    shown by both order ids.
    """
    t, p = F.col("answer"), F.col("pred")
    x = held(pairs.withColumns({"_to": order_id_pair(t["evidence"]), "_po": order_id_pair(p["evidence"])}))
    mismatch = F.array_contains(t["anomaly_types"], "order_id_mismatch")
    shown = mismatch & F.coalesce(F.col("_to.o") != F.col("_to.r"), F.lit(False))
    x = x.withColumns({
        "_unsure": uncertainty_score(t, p), "_same": same_set(t["anomaly_types"], p["anomaly_types"]).cast("double"), "_mismatch": mismatch,
        "_pair": (shown & F.coalesce((F.col("_to.o") == F.col("_po.o")) & (F.col("_to.r") == F.col("_po.r")), F.lit(False))).cast("double"),
        "_missing": F.array_contains(t["anomaly_types"], "missing_document"),
    })
    work = ["_unsure", "_same", "_mismatch", "_pair", "_missing"]
    s = score(x, *keep, *work)
    passed, high, valid = F.coalesce(F.col("pred_audit") == "pass", F.lit(False)), F.col("true_risk") == "high", F.col("schema_valid")
    stopped = ~valid | (high & passed) | (F.col("_missing") & passed)
    mean = (rate("support_correct", "support_total") + rate("value_correct", "value_total") + rate("source_correct", "source_total") + rate("bbox_relaxed_correct", "bbox_total")) / 4
    flag = lambda c: c.cast("double")
    full = {
        "r_field": rate("field_correct", "field_total"), "r_consistency": rate("consistency_correct", "consistency_total"), "r_anomaly": F.col("_same"),
        "r_audit": flag(F.col("risk_correct") & F.col("audit_correct")), "r_evidence": mean, "r_uncertainty": F.col("_unsure"), "r_order_id_pair": F.col("_pair"),
        "p_hallucination": rate("hallucinated", "hallucination_total"), "p_high_risk_miss": flag(F.col("high_risk_miss")),
        "p_missing_order_id_pair": flag(F.col("_mismatch") & (F.col("_pair") < 1)), "p_false_escalation": flag(false_escalation()),
    }
    part = {k: F.when(stopped, F.lit(0.0)).otherwise(v) for k, v in full.items()}
    part["r_json"] = flag(F.col("json_valid"))
    part["p_high_risk_miss"] = F.when(stopped, flag(valid & high & passed)).otherwise(full["p_high_risk_miss"])
    s = held(s.select("case_id", "model", *keep, "json_valid", "schema_valid", stopped.alias("_stopped"), *(part[k].alias(k) for k in WEIGHTS)))
    total = weighted({k: F.col(k) for k in WEIGHTS})
    total = F.when(F.col("p_missing_order_id_pair") > 0, F.least(F.lit(0.0), total)).otherwise(total)
    return s.withColumn("reward", F.when(F.col("_stopped"), F.lit(-1.0)).otherwise(total)).drop("_stopped")


def normalised(rewards: DataFrame, group: list[str], value: str = "reward", name: str = "advantage") -> DataFrame:
    """rewards with (value - mean) / (population deviation + EPSILON) of the group; 0 in a group without deviation.

    Means and deviations are aggregates that are joined back, so a group of any size is no single task.
    """
    stats = rewards.groupBy(*group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    both = rewards.alias("r").join(stats.alias("s"), same)
    out = F.when(F.col("_std") < EPSILON, 0.0).otherwise((F.col(f"r.{value}") - F.col("_mean")) / (F.col("_std") + EPSILON))
    return both.select("r.*", out.alias(name))


def summary(rewards: DataFrame, *by: str) -> DataFrame:
    """Count and means of rewards and their parts; no rows give zeros over all."""
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return rewards.groupBy(*by).agg(
        F.count("*").alias("count"), mean("reward", "mean_reward"), mean("r_json", "json_valid_rate"), mean("p_high_risk_miss", "high_risk_miss_rate"), mean("p_hallucination", "hallucination_penalty"),
        mean("r_order_id_pair", "order_id_pair_rate"), mean("p_missing_order_id_pair", "missing_order_id_pair_rate"), mean("p_false_escalation", "false_escalation_rate"),
    )


def preference_audit(pairs: DataFrame, chosen: str = "chosen_reward", rejected: str = "rejected_reward") -> DataFrame:
    """One row: pairs, mean rewards of both sides, the mean gap, and the share of positive gaps."""
    gap = F.col(chosen) - F.col(rejected)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.agg(
        F.count("*").alias("examples"), zero(F.avg(chosen)).alias("mean_chosen"), zero(F.avg(rejected)).alias("mean_rejected"), zero(F.avg(gap)).alias("mean_reward_gap"),
        rate(F.count_if(gap > 0), F.count("*")).alias("positive_reward_gap_rate"),
    )


def batch_weights(rows: DataFrame, batch: list[str], weight: str = "final_weight", most: float = 3.0, name: str = "weight") -> DataFrame:
    """Weights clamped to 0 and most, divided by their batch's mean; a batch may be of any size."""
    clamped = F.least(F.greatest(F.col(weight).cast("double"), F.lit(0.0)), F.lit(most))
    means = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in batch)).agg(F.greatest(F.avg(clamped), F.lit(EPSILON)).alias("_mean"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in batch))
    return rows.join(means, same).withColumn(name, clamped / F.col("_mean")).drop("_mean", *(f"_{c}" for c in batch))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: sum of value times weight over the sum of weights."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.sum(v * w) / F.greatest(F.sum(w), F.lit(EPSILON))


def preference_quality(bucket: str = "bucket") -> Column:
    """A score of 0 to 1 for mining pairs, by bucket, from a reward's parts; it does not saturate as the reward does."""
    say = lambda **weights: sum((F.lit(w) * (1 - F.col(k[4:]) if k.startswith("not_") else F.col(k)) for k, w in weights.items()), F.lit(0.0))
    order = say(r_json=0.40, r_order_id_pair=0.15, r_audit=0.15, r_anomaly=0.10, r_evidence=0.10, r_field=0.05, r_consistency=0.05)
    low = say(r_json=0.40, r_audit=0.25, not_p_false_escalation=0.20, r_anomaly=0.10, r_evidence=0.05)
    other = say(r_json=0.40, r_audit=0.25, r_anomaly=0.15, r_evidence=0.10, r_field=0.05, r_consistency=0.05)
    return clip(F.when(F.col(bucket) == "order_id_mismatch", order).when(F.col(bucket) == "low_pass", low).otherwise(other), 0.0, 1.0)


def core_ok(bucket: str = "bucket") -> Column:
    """Whether a completion is good enough to be chosen."""
    one = lambda c: F.col(c) == 1.0
    return (
        F.when(F.col(bucket) == "order_id_mismatch", one("r_order_id_pair") & one("r_audit") & one("r_anomaly"))
        .when(F.col(bucket) == "other_high_risk", one("r_audit") & one("r_anomaly") & (F.col("r_evidence") >= 0.70))
        .otherwise(one("r_audit") & (F.col("p_false_escalation") == 0))
    )


def order_failure() -> Column:
    return (F.col("r_order_id_pair") < 1) | (F.col("r_audit") < 1) | (F.col("r_anomaly") < 1) | (F.col("p_high_risk_miss") > 0)
