"""Comparing models: transitions, changes, taxonomies of problems, bootstrap errors, paired answers, means and gates over metric rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rate, reasons
from .storing import stored

#: Where an answer, a decision and a risk are looked for, in this order.
ANSWER_PATHS = ["prediction", "parsed_prediction", "output", "response", "answer", "pred"]
DECISION_PATHS = ["audit_result", "decision", "audit_decision", "risk_decision", "final_decision", "parsed.audit_result", "parsed.decision", "prediction.audit_result", "prediction.decision"]
RISK_PATHS = ["risk_type", "risk_level", "risk.type", "risk.risk_type", "parsed.risk_type", "prediction.risk_type"]
#: The keys with which those of decisions and risks begin.
HEADS = sorted({p.split(".")[0] for p in DECISION_PATHS + RISK_PATHS})


def any_issue(*names: str, issues: str = "issues") -> Column:
    return F.arrays_overlap(issues, F.array(*map(F.lit, names)))


def legacy_issues(rows: DataFrame) -> Column:
    """The issues of a row, which older files call issue_codes; none if neither is there."""
    there = [F.col(c) for c in ("issues", "issue_codes") if c in rows.columns]
    return F.coalesce(*there, F.array().cast("array<string>"))


def problem_classes() -> Column:
    """All problem classes of an error row (issues, true and predicted risk and result); other if there is none."""
    high = F.col("true_risk") == "high"
    seen = F.coalesce(F.col("pred_risk") == "high", F.lit(False))
    found = reasons(
        (any_issue("json_invalid", "schema_invalid", "business_metrics_zeroed"), "schema_contract_failure"),
        (high & (~seen | F.coalesce(F.col("pred_audit") == "pass", F.lit(False))), "model_missed_high_risk"),
        (high & seen & ~F.col("true_audit").eqNullSafe(F.col("pred_audit")), "recognized_risk_but_decision_released"),
        (any_issue("unsupported_evidence", "bbox_strict_error", "hallucination"), "evidence_not_trustworthy"), (any_issue("audit_mismatch", "risk_mismatch"), "decision_or_risk_mismatch"),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def problem_class(family: Column) -> Column:
    """The one problem class of an error row, the first that fits; family is that of its true answer."""
    return (
        F.when(any_issue("schema_invalid", "json_invalid"), "schema_contract_failure").when(any_issue("high_risk_miss"), "model_missed_high_risk")
        .when(any_issue("audit_mismatch") & (F.col("true_risk") == "high"), "recognized_risk_but_decision_released")
        .when(any_issue("unsupported_evidence", "bbox_strict_error"), "evidence_not_trustworthy").when(family == "evidence_or_document_insufficient", "evidence_or_document_insufficient")
        .otherwise("other_business_error")
    )


def false_checks(answer: Column, checks: list[str]) -> Column:
    """Names of the flags that are false."""
    return reasons(*((answer["consistency_check"][c] == F.lit(False), c) for c in checks))


def field_differences(truth: Column, pred: Column, fields: list[str]) -> Column:
    """array of field, truth and pred where the two differ, by name."""
    each = [F.when(~truth["field_extraction"][f].eqNullSafe(pred["field_extraction"][f]), F.struct(F.lit(f).alias("field"), truth["field_extraction"][f].alias("truth"), pred["field_extraction"][f].alias("pred"))) for f in sorted(fields)]
    return F.array_compact(F.array(*each))


def prompt_guard_class(truth: Column, pred: Column) -> Column:
    """The class of an error under the order id prompt."""
    cited = F.exists(pred["evidence"], lambda e: e["field"] == "order_id")
    told = F.array_contains(pred["anomaly_types"], "order_id_mismatch") | (pred["consistency_check"]["order_id_consistent"] == F.lit(False))
    return (
        F.when((F.size(F.array_distinct("issues")) == 1) & any_issue("bbox_strict_error"), "bbox_only").when(~any_issue("high_risk_miss"), "other")
        .when(~F.coalesce(cited, F.lit(False)) & F.array_contains(truth["anomaly_types"], "order_id_mismatch"), "missing_order_id_evidence")
        .when(F.coalesce(told, F.lit(False)), "recognized_risk_but_decision_released").otherwise("model_missed_high_risk")
    )


def both_wrong_class(truth: Column, pred: Column, checks: list[str]) -> Column:
    """How a model erred where both models did."""
    high = pred["risk_level"] == "high"
    signal = (F.size(pred["anomaly_types"]) > 0) | (F.size(false_checks(pred, checks)) > 0)
    return (
        F.when(high & (pred["audit_result"] == "pass"), "recognized_risk_but_decision_released").when(high & ~pred["audit_result"].eqNullSafe(truth["audit_result"]), "recognized_risk_but_wrong_decision")
        .when(F.coalesce(signal, F.lit(False)), "recognized_some_signal_but_underestimated").otherwise("model_missed_high_risk")
    )


def decision_view(answer: Column) -> Column:
    """What a case study shows of an answer, with whether the evidence holds both order ids."""
    where = F.transform(F.filter(answer["evidence"], lambda e: e["field"] == "order_id"), lambda e: e["source_doc_type"])
    return F.struct(
        answer["risk_level"].alias("risk_level"), answer["audit_result"].alias("audit_result"), answer["anomaly_types"].alias("anomaly_types"),
        (F.array_contains(where, "order") & F.array_contains(where, "reimbursement_form")).alias("has_two_sided_order_id_evidence"), answer["reason"].alias("reason"), answer["evidence"].alias("evidence"),
    )


def examples(rows: DataFrame, by: list[str], key: str, n: int = 10) -> DataFrame:
    """by, n, examples: the rows of each group and its first keys; only the first n of a group are gathered."""
    rows = stored(rows.select(*by, key))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_r") <= n)
    return rows.groupBy(*by).agg(F.count("*").alias("n")).join(first.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(key)), " ").alias("examples")), by)


def most_common(rows: DataFrame, by: list[str], values: dict[str, Column], n: int = 5) -> DataFrame:
    """by, and for each name the n most frequent of its values as 'value:count; ...'; of equal counts the name that sorts first.

    values are array columns. All names are counted in one pass.
    """
    def told_as(name: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(name).alias("name"), x.alias("value")))

    every = F.flatten(F.array(*(told_as(name, v) for name, v in values.items())))
    counts = rows.select(*by, F.explode(every).alias("_x")).groupBy(*by, "_x.name", "_x.value").agg(F.count("*").alias("_n"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "name").orderBy(F.desc("_n"), "value"))).where(F.col("_r") <= n)
    told = F.struct("_r", F.concat(F.col("value"), F.lit(":"), F.col("_n").cast("string")).alias("s"))
    return top.groupBy(*by).agg(*(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == name, told))), lambda x: x["s"]), "; ").alias(name) for name in values))


def bootstrap_error(rows: DataFrame, value: str, *by: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """by, n, mean, se: the standard error of a group's mean over resamples of its rows.

    A resample of n rows is a multinomial draw of how often each different value occurs, so the rows are counted by value once,
    wherever they are, and only those counts (few for flags) meet in a task; no replicate of the table is made. No rows give 0.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def draw(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_v")
        v, n = batch["_v"].to_numpy(float), batch["_n"].to_numpy()
        total = int(n.sum())
        drawn = np.random.default_rng(seed).multinomial(total, n / total, samples) @ v / total if samples else np.zeros(1)
        se = float(np.sqrt(((drawn - drawn.mean()) ** 2).sum() / max(1, len(drawn) - 1)))
        return pd.DataFrame([{**{c: batch[c].iloc[0] for c in by}, "n": total, "mean": float(n @ v / total), "se": se}])

    group = counts.groupBy(*by) if by else counts.groupBy(F.lit(0).alias("_all"))
    return group.applyInPandas(draw, f"{kinds}{', ' if kinds else ''}n long, mean double, se double")


def at_paths(json: Column, paths: list[str]) -> Column:
    """The text at the first path that is there."""
    return F.coalesce(*(F.get_json_object(json, f"$.{p}") for p in paths))


def paired(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """One row on two prediction tables (key, answer as canonical JSON): shared and lone cases, and the rates of equal answers, decisions and risks."""
    side = lambda df, n: df.select(key, F.sha2("answer", 256).alias(f"{n}_digest"), at_paths(F.col("answer"), DECISION_PATHS).alias(f"{n}_decision"), at_paths(F.col("answer"), RISK_PATHS).alias(f"{n}_risk"), F.lit(True).alias(f"in_{n}"))
    x = side(a, "a").join(side(b, "b"), key, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = lambda c: both & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    n = F.count_if(both)
    return x.agg(
        n.alias("common_cases"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(same("digest")).alias("same_answers"),
        rate(F.count_if(same("digest")), n).alias("same_answer_rate"), rate(F.count_if(same("decision")), n).alias("same_decision_rate"), rate(F.count_if(same("risk")), n).alias("same_risk_rate"),
    )


def paired_models(rows: DataFrame, one: str, other: str, key: str = "case_id") -> DataFrame:
    """paired() of two models of one table (key, model, told as contract.told() gives it): texts are read once, and digests meet in one aggregate."""
    t = rows.select(key, "model", F.struct(F.col("told.digest").alias("digest"), at_paths(F.col("told.heads"), DECISION_PATHS).alias("decision"), at_paths(F.col("told.heads"), RISK_PATHS).alias("risk")).alias("_t"))
    side = lambda m, name: F.max(F.when(F.col("model") == m, F.col("_t"))).alias(name)
    x = t.where(F.col("model").isin(one, other)).groupBy(key).agg(side(one, "_a"), side(other, "_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = lambda c: both & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    n = F.count_if(both)
    return x.agg(
        n.alias("common_cases"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(same("digest")).alias("same_answers"),
        rate(F.count_if(same("digest")), n).alias("same_answer_rate"), rate(F.count_if(same("decision")), n).alias("same_decision_rate"), rate(F.count_if(same("risk")), n).alias("same_risk_rate"),
    )


def one_metric_row(metrics: DataFrame, model: str, split: str | None = None) -> DataFrame:
    """The one row of a model (and split); none or several are an error."""
    x = metrics.where(F.col("model") == model)
    x = x.where(F.col("split") == split) if split is not None else x
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    counted = x.withColumn("_n", n)
    empty = metrics.sparkSession.range(1).select(F.lit(0).alias("_one"))
    joined = empty.join(counted, F.lit(True), "left")
    wrong = F.coalesce(F.col("_n"), F.lit(0)) != 1
    return joined.withColumn("model", F.when(wrong, F.raise_error(F.lit(f"expected one metric row of {model}"))).otherwise(F.col("model"))).drop("_n", "_one")


def means(metrics: DataFrame, fields: list[str], *by: str, weight: str | None = None) -> DataFrame:
    """Means of split rates: each split alike, or weighted by its cases; the two differ where splits do in size."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return metrics.groupBy(*by).agg(F.count("*").alias("splits"), *(rate(F.sum(F.col(f) * w), F.sum(w)).alias(f) for f in fields))


def deltas(candidate: DataFrame, others: DataFrame, fields: list[str], model: str = "model") -> DataFrame:
    """Each other model's row beside the candidate's one: candidate less baseline."""
    c = F.broadcast(candidate.select(F.col(model).alias("candidate"), *(F.col(f).alias(f"_{f}") for f in fields)))
    return others.crossJoin(c).select(F.col(model).alias("baseline"), "candidate", *((F.col(f"_{f}") - F.col(f)).alias(f"{f}_delta") for f in fields))


def last_record(history: DataFrame, by: list[str], step: str = "global_step") -> DataFrame:
    """The record of the highest step of each group."""
    rest = [c for c in history.columns if c not in by]
    return history.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(step)).alias("_v")).select(*by, "_v.*")


def changed_ids(before: DataFrame, after: DataFrame, key: str = "case_id") -> DataFrame:
    """key, change: fixed is in before only, introduced in after only."""
    both = before.select(key, F.lit(True).alias("_old")).unionByName(after.select(key, F.lit(False).alias("_old")))
    sides = both.groupBy(key).agg(F.bool_or("_old").alias("_before"), F.bool_and("_old").alias("_only"))
    return sides.where("_only or not _before").select(key, F.when(F.col("_only"), "fixed").otherwise("introduced").alias("change"))


def markdown(rows: list[dict], fields: list[str], digits: int = 4) -> str:
    """A report table of a few rows; numbers with fixed digits, from 10 on with one."""
    def text(v) -> str:
        return "" if v is None else str(v).replace("\n", " ") if not isinstance(v, float) else f"{v:.1f}" if v >= 10 else f"{v:.{digits}f}"

    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(fields), line(["---"] * len(fields)), *(line([text(r.get(f)) for f in fields]) for r in rows)])
