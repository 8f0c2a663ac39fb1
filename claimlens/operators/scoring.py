"""Scores of predicted answers against true ones, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import held, jaccard, rate, reasons
from ..plans.outputs import CHECKS, FIELDS
from . import evidence

RISKS = ["low", "medium", "high"]
#: Thresholds of error attribution, and the order in which its tags and classes count.
THRESHOLDS = {"field": 0.95, "anomaly": 0.90, "evidence": 1.0, "bbox": 1.0}
SOURCES = ["output_contract_error", "perception_error", "consistency_error", "decision_error", "evidence_error"]
CLASSES = ["schema_contract_failure", "model_missed_high_risk", "recognized_risk_but_decision_released", "evidence_not_trustworthy"]

#: What metrics() reads of scores.
MEASURED = [
    "json_valid", "schema_valid", "true_risk", "pred_risk", "true_audit", "audit_correct", "high_risk_miss", "false_manual_review", "field_correct", "field_total", "consistency_correct", "consistency_total",
    *(f"{k}_correct" for k in ("support", "value", "source", "bbox_strict", "bbox_relaxed")), *(f"{k}_total" for k in ("support", "value", "source", "bbox")), "hallucinated", "hallucination_total", "issues",
]

NOTHING = "array<struct<source_image_id:string,source_doc_type:string,field:string,value:string,bbox:array<int>,evidence_text:string>>"


def evidence_counts() -> Column:
    """struct of nine counts of true evidence found again: support, value, source and boxes; of _found, _n_true and _n_pred.

    A prediction that is not valid has no evidence. Without true evidence each pair is 1 of 1 if nothing is
    predicted, else 0 of 1.
    """
    empty, alone = F.col("_n_true") == 0, (F.col("_n_pred") == 0).cast("long")
    each = {"support_correct": "support", "value_correct": "value", "source_correct": "source", "bbox_strict_correct": "strict", "bbox_relaxed_correct": "relaxed"}
    total = F.when(empty, F.lit(1).cast("long")).otherwise(F.col("_n_true"))
    return F.struct(*(F.when(empty, alone).otherwise(F.col(f"_found.{v}")).alias(k) for k, v in each.items()), *(total.alias(f"{k}_total") for k in ("support", "value", "source", "bbox")))


def fields_correct(truth: Column, pred: Column) -> Column:
    """How many of the twenty fields are as they should be; two nulls are equal."""
    return sum((truth[f].eqNullSafe(pred[f]).cast("long") for f in FIELDS), F.lit(0).cast("long"))


def checks_correct(truth: Column, pred: Column) -> Column:
    return sum((truth[c].eqNullSafe(pred[c]).cast("long") for c in CHECKS), F.lit(0).cast("long"))


def last_prediction(truth: DataFrame, predictions: DataFrame, by: list[str], order: str) -> DataFrame:
    """truth with the columns of its last prediction (of the highest order); no prediction leaves them null, others are ignored."""
    rest = [c for c in predictions.columns if c not in by]
    last = predictions.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return truth.join(last, by, "left").select(*truth.columns, *(F.col(f"_last.{c}").alias(c) for c in rest if c != order and c not in truth.columns))


def last_scored(scores: DataFrame, by: list[str], order: str) -> DataFrame:
    """The scores of each case's last prediction (of the highest order; null, where a prediction is lost, is the lowest).

    Where predictions stand beside their truth this is last_prediction() after scoring: scores are sent to be grouped, not answers and texts.
    """
    rest = [c for c in scores.columns if c not in (*by, order)]
    return scores.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_last")).select(*by, "_last.*")


def score(pairs: DataFrame, *keep: str) -> DataFrame:
    """Case scores of rows (case_id, model, answer, images, json_valid, schema_valid, pred), and the columns to keep.

    answer and pred are nested answers; pred counts only where schema_valid. Numerators of other rows
    are 0, denominators those of the truth; a missing prediction is one with both flags false.
    """
    valid = F.coalesce(F.col("schema_valid"), F.lit(False))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    base = pairs.select(
        "case_id", "model", *keep, F.col("answer").alias("_true"), F.col("images").alias("_images"), F.coalesce("json_valid", F.lit(False)).alias("json_valid"), valid.alias("schema_valid"),
        F.when(valid, F.col("pred")).alias("_said"),
    )
    t, p = F.col("_true"), F.col("_said")
    base = held(base)
    te, pe = (F.coalesce(x["evidence"], F.array().cast(NOTHING)) for x in (t, p))
    valid = F.col("schema_valid")
    known = {"_images": F.col("_images.image_id"), "_documents": F.col("_images.doc_type"), "_unreadable": F.coalesce(t["uncertainty"]["uncertain_fields"], none)}
    lists = [*known, *(f"{name}_{k}" for name in ("_t", "_p") for k in (*evidence.PARTS, "bbox"))]
    # In steps: the JVM only compiles methods of up to 8,000 bytes, and one step that does all of this is longer.
    ids = ["case_id", "model", *keep, "json_valid", "schema_valid"]
    base = held(base.withColumn("field_correct", F.when(valid, fields_correct(t["field_extraction"], p["field_extraction"])).otherwise(zero)))
    base = held(base.select(
        *ids, "field_correct", t["anomaly_types"].alias("true_anomalies"), p["anomaly_types"].alias("pred_anomalies"),
        t["risk_level"].alias("true_risk"), t["audit_result"].alias("true_audit"), p["risk_level"].alias("pred_risk"), p["audit_result"].alias("pred_audit"),
        F.when(valid, checks_correct(t["consistency_check"], p["consistency_check"])).otherwise(zero).alias("consistency_correct"),
        F.size(te).cast("long").alias("_n_true"), F.size(pe).cast("long").alias("_n_pred"), p["reason"].alias("_reason"),
        te.alias("_te"), pe.alias("_pe"), *(v.alias(k) for k, v in known.items()),
    ))
    rest = [c for c in base.columns if c not in ("_te", "_pe")]
    base = held(base.select(*rest, *(v.alias(k) for x in "tp" for k, v in evidence.parts(F.col(f"_{x}e"), f"_{x}").items())))
    base = base.withColumns({"field_total": F.lit(len(FIELDS)).cast("long"), "consistency_total": F.lit(len(CHECKS)).cast("long")})
    # Of what evidence is compared by, only the counts go on; where none of them is asked for, nothing is compared.
    told = [c for c in base.columns if c not in lists]
    base = base.select(*told, evidence.found("_t", "_p", "_images", "_documents", "_unreadable").alias("_found"))
    base = base.withColumns({"e": evidence_counts(), "hallucinated": F.when(valid, F.col("_found.wrong")).otherwise(zero), "hallucination_total": F.col("_n_pred")}).select(
        *[c for c in told if c not in ("_n_true", "_n_pred")], "hallucinated", "hallucination_total", "e.*", jaccard(F.col("true_anomalies"), F.coalesce("pred_anomalies", none)).alias("anomaly_score"))
    high, seen = F.col("true_risk") == "high", F.col("schema_valid")
    missed = ~F.coalesce(F.col("pred_risk") == "high", F.lit(False)) | F.coalesce(F.col("pred_audit") == "pass", F.lit(False))
    right = F.coalesce(F.col("pred_audit") == F.col("true_audit"), F.lit(False))
    passes = F.col("true_audit") == "pass"
    out = base.withColumns({
        "audit_correct": right, "risk_correct": F.coalesce(F.col("pred_risk") == F.col("true_risk"), F.lit(False)), "high_risk_miss": high & missed,
        "false_manual_review": passes & F.coalesce(F.col("pred_audit") == "manual_review", F.lit(False)),
        "false_escalation": passes & F.coalesce(F.col("pred_audit") != "pass", F.lit(False)),
        "issues": reasons(
            (~F.col("json_valid"), "json_invalid"), (~seen, "schema_invalid"), (~seen, "business_metrics_zeroed"), (seen & high & missed, "high_risk_miss"),
            (seen & ~right, "audit_mismatch"), (seen & F.col("_reason").rlike("直觉|无法提供证据"), "unsupported_conclusion"), (seen & (F.col("hallucinated") > 0), "hallucination"),
            (seen & (F.col("support_correct") < F.col("support_total")), "unsupported_evidence"), (seen & (F.col("bbox_strict_correct") < F.col("bbox_total")), "bbox_strict_error"),
        ),
    })
    return out.drop("_reason")


def macro_f1(true: str, pred: str, labels: list[str]) -> Column:
    """Aggregate: mean F1 over the labels; an absent label scores 0, a null prediction only misses."""
    parts = []
    for v in labels:
        is_true, is_pred = F.coalesce(F.col(true) == v, F.lit(False)), F.coalesce(F.col(pred) == v, F.lit(False))
        tp, fp, fn = F.count_if(is_true & is_pred), F.count_if(~is_true & is_pred), F.count_if(is_true & ~is_pred)
        parts.append(rate(2 * tp, 2 * tp + fp + fn))
    return sum(parts[1:], parts[0]) / len(parts)


def metrics(scores: DataFrame, *by: str) -> DataFrame:
    """The sixteen metrics of each group; a rate with nothing below it is 0."""
    n, ratio = F.count("*"), lambda a, b: rate(F.sum(a), F.sum(b))
    share = lambda c: rate(F.count_if(c), F.count("*"))
    return scores.groupBy(*by).agg(
        n.alias("total_cases"), share("json_valid").alias("json_validity"), share("schema_valid").alias("schema_compliance"),
        ratio("field_correct", "field_total").alias("field_em"), ratio("consistency_correct", "consistency_total").alias("consistency_em"),
        macro_f1("true_risk", "pred_risk", RISKS).alias("risk_type_macro_f1"), share("audit_correct").alias("audit_accuracy"),
        rate(F.count_if("high_risk_miss"), F.count_if(F.col("true_risk") == "high")).alias("high_risk_miss_rate"),
        rate(F.count_if("false_manual_review"), F.count_if(F.col("true_audit") == "pass")).alias("false_manual_review_rate"),
        ratio("support_correct", "support_total").alias("evidence_support_rate"), ratio("value_correct", "value_total").alias("evidence_value_accuracy"),
        ratio("source_correct", "source_total").alias("evidence_source_accuracy"), ratio("bbox_strict_correct", "bbox_total").alias("evidence_bbox_accuracy_strict"),
        ratio("bbox_relaxed_correct", "bbox_total").alias("evidence_bbox_accuracy_relaxed"), ratio("hallucinated", "hallucination_total").alias("hallucination_rate"),
        F.count_if(F.size("issues") > 0).alias("error_cases"),
    )


def attributed(scores: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """scores with error_tags, primary_error_source, problem_classes, primary_problem_class and decision_candidate."""
    seen, fields = F.col("schema_valid"), rate("field_correct", "field_total") >= limits["field"]
    named, wrong = F.col("anomaly_score") >= limits["anomaly"], ~F.col("audit_correct") | F.col("high_risk_miss")
    support = rate("support_correct", "support_total")
    candidate = F.col("json_valid") & seen & fields & named & wrong
    tags = reasons(
        (~F.col("json_valid") | ~seen, SOURCES[0]), (seen & ~fields, SOURCES[1]),
        (seen & fields & (~named | (F.col("consistency_correct") < F.col("consistency_total"))), SOURCES[2]),
        (seen & fields & named & wrong, SOURCES[3]), (F.col("audit_correct") & (support < limits["evidence"]), SOURCES[4]),
    )
    released = seen & (F.col("true_risk") == "high") & (F.col("pred_risk") == "high") & (F.col("true_audit") == "reject_recommendation") & F.col("pred_audit").isin("pass", "manual_review")
    weak = seen & ((support < limits["evidence"]) | ((F.col("bbox_total") > 0) & (rate("bbox_relaxed_correct", "bbox_total") < limits["bbox"])))
    classes = reasons((~F.col("json_valid") | ~seen, CLASSES[0]), (F.col("high_risk_miss"), CLASSES[1]), (released, CLASSES[2]), (weak, CLASSES[3]))
    return scores.withColumns({"error_tags": tags, "problem_classes": classes, "decision_candidate": candidate}).withColumns(
        {"primary_error_source": F.get("error_tags", F.lit(0)), "primary_problem_class": F.get("problem_classes", F.lit(0))}
    )


def transition(base: str, candidate: str) -> Column:
    b, c = F.col(base), F.col(candidate)
    return F.when(b & c, "both_correct").when(b, "baseline_correct_candidate_wrong").when(c, "baseline_wrong_candidate_correct").otherwise("both_wrong")


def migration_issues() -> Column:
    """Issues as compared between models: sorted, with risk_mismatch, without the conclusion's wording."""
    seen = F.col("schema_valid")
    more = F.when(seen & ~F.col("risk_correct"), F.array(F.lit("risk_mismatch"))).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.concat(F.array_remove("issues", "unsupported_conclusion"), more)))
