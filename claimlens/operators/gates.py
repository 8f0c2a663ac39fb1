"""Metric gates: candidate against baseline, the decision after them, gates of training stages, checkpoint choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rate

#: The two repair gates (least change of each metric, most or least change of misses) and the decision's limits.
FAST = {"json_validity": -0.01, "schema_compliance": -0.03, "audit_accuracy": -0.03, "evidence_support_rate": -0.03, "miss_rise": 0.03}
MAIN = {"json_validity": -0.01, "schema_compliance": -0.02, "audit_accuracy": -0.01, "evidence_support_rate": -0.01, "miss_drop": 0.03}
DECISION = {"errors": 5, "candidates": 0.60, "primary": 0.50}
#: What a mining run needs fixed and may lose, and what an alignment must bring.
SFT_DROP, SFT_FIXED, ALIGN_FIXED, ALIGN_DROP, ALIGN_SUPPORT = 0.01, 3, 2, -0.02, -0.01
#: Differences of rates are compared after rounding, so that equal sums in another order pass alike.
DIGITS = 9


def repair_gate_rows(limits: dict[str, float], name: str) -> Column:
    """array of gate, check, passed of rows with base and cand metric structs, then all; a limit that is not named passes."""
    change = lambda k: F.round(F.col(f"cand.{k}") - F.col(f"base.{k}"), DIGITS)
    checks: dict[str, Column] = {k: change(k) >= limits.get(k, -1.0) for k in ("json_validity", "schema_compliance", "audit_accuracy", "evidence_support_rate")}
    if "miss_drop" in limits:
        checks["high_risk_miss_improvement"] = -change("high_risk_miss_rate") >= limits["miss_drop"]
    else:
        checks["high_risk_miss_delta"] = change("high_risk_miss_rate") <= limits.get("miss_rise", 1.0)
    row = lambda k, v: F.struct(F.lit(name).alias("gate"), F.lit(k).alias("check"), v.alias("passed"))
    rows = F.array(*(row(k, v) for k, v in checks.items()))
    return F.array_append(rows, row("all", F.forall(rows, lambda x: x["passed"])))


def repair_gate(pair: DataFrame, limits: dict[str, float], name: str) -> DataFrame:
    """gate, check, passed of one row with base and cand metric structs."""
    return pair.select(F.inline(repair_gate_rows(limits, name)))


def attribution_summary(attributed: DataFrame, *by: str) -> DataFrame:
    """Residual errors, decision candidates and primary decision errors, with their shares."""
    error = (F.size("error_tags") > 0) | (F.size("problem_classes") > 0)
    g = attributed.groupBy(*by).agg(
        F.count("*").alias("total_rows"), F.count_if(error).alias("residual_error_cases"), F.count_if("decision_candidate").alias("decision_candidates"),
        F.count_if(F.col("primary_error_source") == "decision_error").alias("decision_primary"),
    )
    return g.withColumns({
        "decision_candidate_ratio": rate("decision_candidates", "residual_error_cases"), "decision_primary_ratio": rate("decision_primary", "residual_error_cases"),
    })


def training_decision(gate: DataFrame, attribution: DataFrame, limits: dict[str, float] = DECISION) -> DataFrame:
    """check, passed and the status: whether a main gate's rows and one attribution row are ready for reinforcement."""
    main = gate.agg(F.coalesce(F.max(F.when(F.col("check") == "all", F.col("passed"))), F.lit(False)).alias("main_gate_passed"))
    one = attribution.select("residual_error_cases", "decision_candidate_ratio", "decision_primary_ratio").crossJoin(main)
    checks = {
        "main_gate_passed": F.col("main_gate_passed"), "enough_residual_errors": F.col("residual_error_cases") >= limits.get("errors", 1),
        "decision_candidate_ratio": F.col("decision_candidate_ratio") >= limits.get("candidates", 0.5), "decision_primary_ratio": F.col("decision_primary_ratio") >= limits.get("primary", 0.5),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()))
    status = F.when(F.forall(rows, lambda x: x["passed"]), "READY_FOR_RL").otherwise("RL_NOT_RECOMMENDED")
    return one.select(rows.alias("_rows"), status.alias("status")).select(F.inline("_rows"), "status")


def assert_ready(decision: DataFrame) -> None:
    """Raises unless the decision's rows all say READY_FOR_RL."""
    if not decision.count() or decision.where("status <> 'READY_FOR_RL'").limit(1).count():
        raise RuntimeError("not ready for reinforcement")


def mining_status(fixed: str = "fixed") -> tuple[Column, Column]:
    """Status, and whether mining is allowed, of rows with base and cand metric structs and how many known misses are fixed."""
    kept = lambda k: F.round(F.col(f"cand.{k}") - F.col(f"base.{k}"), DIGITS) >= -SFT_DROP
    safe = (F.col("cand.json_validity") == 1) & (F.col("cand.schema_compliance") == 1) & kept("audit_accuracy") & kept("evidence_support_rate")
    allowed = safe & (F.col("cand.high_risk_miss_rate") < F.col("base.high_risk_miss_rate"))
    return F.when(allowed & (F.col(fixed) >= SFT_FIXED), "PASS").when(allowed, "PASS_WITH_TARGET_WARNING").otherwise("FAIL"), allowed


def alignment_status(selected: str = "selection", fixed: str = "fixed", introduced: str = "introduced") -> Column:
    """Status of rows with base and cand metric structs, the checkpoint's selection, and how many misses are fixed and introduced."""
    change = lambda k: F.round(F.col(f"cand.{k}") - F.col(f"base.{k}"), DIGITS)
    works = (
        (F.col(selected) == "ELIGIBLE") & (F.col(fixed) >= ALIGN_FIXED) & (F.col(introduced) == 0) & (F.col("cand.json_validity") == 1) & (F.col("cand.schema_compliance") == 1)
        & (change("audit_accuracy") >= 0) & (change("false_manual_review_rate") <= 1 / F.col("cand.total_cases")) & (change("evidence_support_rate") >= ALIGN_SUPPORT)
        & ((change("high_risk_miss_rate") <= ALIGN_DROP) | (F.col(fixed) >= ALIGN_FIXED))
    )
    return F.when(F.coalesce(works, F.lit(False)), "EFFECTIVE_ALIGNMENT").otherwise("ALIGNMENT_GATE_NOT_MET")


def best_checkpoint(steps: DataFrame) -> DataFrame:
    """The earliest eligible step, or else that with the best (reward, order, earliest)."""
    return steps.orderBy(
        F.desc("eligible"), F.when(F.col("eligible"), F.col("step")).otherwise(0), F.desc("reward_gain"), F.desc("order_gain"), "step"
    ).limit(1)
