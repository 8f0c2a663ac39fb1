"""Preference pairs: rejected answers by rule, checks, weights, splits, selection under quotas, and pairs mined from completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import answer_valid
from ..functions.exprs import held, reasons
from ..plans.outputs import FIELDS, answer_json
from . import selection
from .ranking import global_rank
from .rewards import core_ok, order_failure, preference_quality, reward

#: The kinds of rejected answers of the first builder, and what they write.
REJECTED = [
    "high_risk_pass", "wrong_anomaly_type", "wrong_risk_level", "wrong_evidence_source", "wrong_bbox", "unsupported_reason", "json_invalid", "hallucinated_field",
    "unreadable_but_guess", "missing_doc_but_pass",
]
BROKEN_JSON, WRONG_IMAGE, WRONG_BOX, FAKE_PAYMENT = '{"case_id": "broken", "audit_result": pass', "wrong_image_id", [0, 0, 10, 10], "PAY99999999999999"
SAYS = {
    "high_risk_pass": "未发现异常，建议通过。", "unsupported_reason": "因为系统直觉判断异常，所以给出该结论。", "hallucinated_field": "补全了未可靠出现的支付流水号。", "missing_doc_but_pass": "材料完整，建议通过。",
}
#: The pair types of the second builder with their shares in hundredths, the anomalies that it protects, and its texts.
PAIR_SHARES = {"hard_rejected": 35, "high_risk_miss": 30, "protective": 20, "normal_calibration": 15}
PROTECTED = ["amount_mismatch", "over_reimbursement", "order_id_mismatch", "merchant_mismatch", "applicant_mismatch", "missing_document", "unreadable_image"]
PAIR_SAYS = {
    "miss": "未发现高风险异常，材料可自动通过。", "evidence": "该字段已被读取，但结论未充分比较跨凭证差异。", "amount": "金额差异较小，可先按中风险转人工复核。", "order": "订单号虽然显示不同，但可视为同一订单的展示差异。",
    "complete": "证据看似完整，暂不建议拒绝。", "over": "正常或低风险样本被错误提升为高风险拒绝。", "downgrade": "高风险证据存在，但被错误降级为人工复核。", "pass": "材料看似完整，因此错误建议通过。",
    "manual": "证据不足，错误转为人工复核。",
}
SEVERITY = {
    "high_risk_pass": 3.0, "high_risk_downgrade": 2.5, "audit_result_wrong": 2.0, "risk_level_wrong": 1.8, "missing_key_anomaly": 1.5, "evidence_wrong": 1.2, "normal_over_reject": 1.5, "schema_minor": 0.8,
}
#: Both order ids' reason, and how a false escalation is made.
ORDER_REASON = ("检测到order_id_mismatch：订单截图订单号", "与报销申请单订单号", "不一致，建议拒绝报销。")
REPAIR_REASON = ("检测到order_id_mismatch：订单截图订单号", "与报销申请单订单号", "不一致，风险等级为high，审核建议为reject_recommendation。")
ESCALATED = "Calibration negative: incorrectly escalates a low-risk case."
MIN_GAP, MAX_GAP, SLACK = 0.15, 0.60, 1e-9
#: Buckets that give mined pairs, and what a claim has to say for its pairs.
MINED_BUCKETS = ["order_id_mismatch", "low_pass"]
PAIR_FACTS = ["case_id", "label", "risk_level", "audit_result", "anomaly_types", "evidence_sufficient"]
BUCKET_WEIGHTS = {"order_id_mismatch": 2.0, "other_high_risk": 1.5, "low_pass": 1.0}


def _case(of: str | Column, values: dict[str, Column | str | float], default: Column | None = None) -> Column:
    c = F.col(of) if isinstance(of, str) else of
    out = None
    for k, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if default is None else out.otherwise(default)


def _first(items: Column, **change: Column) -> Column:
    def changed(x: Column) -> Column:
        for k, v in change.items():
            x = x.withField(k, v)
        return x

    return F.transform(items, lambda x, k: F.when(k == 0, changed(x)).otherwise(x))


# --- first builder -----------------------------------------------------------------------------


def eligible_rejections() -> Column:
    """array of the kinds that fit a claim: eight always (a pass of a high risk among them), two by its anomalies."""
    return F.concat(
        F.array(*map(F.lit, REJECTED[:8])), F.when(F.array_contains("anomaly_types", "unreadable_image"), F.array(F.lit(REJECTED[8]))).otherwise(F.array().cast("array<string>")),
        F.when(F.array_contains("anomaly_types", "missing_document"), F.array(F.lit(REJECTED[9]))).otherwise(F.array().cast("array<string>")),
    )


def rejected_answer(answer: Column, kind: Column, claim_text: dict[str, Column]) -> Column:
    """The text of an answer with one fault; claim_text has what the claim says for each field."""
    a, unsure = answer, answer["uncertainty"]["uncertain_fields"]
    passes = lambda k: a.withField("risk_level", F.lit("low")).withField("audit_result", F.lit("pass")).withField("reason", F.lit(SAYS[k]))
    other = F.when(F.array_contains(a["anomaly_types"], "merchant_mismatch"), F.array(F.lit("amount_mismatch"))).otherwise(F.array(F.lit("merchant_mismatch")))
    guessed = F.when(F.size(unsure) > 0, unsure).otherwise(F.array(F.lit("invoice_amount")))
    fields = F.struct(*(F.when(F.array_contains(guessed, f), F.coalesce(claim_text[f], F.lit("UNKNOWN"))).otherwise(a["field_extraction"][f]).alias(f) for f in FIELDS))
    sure = F.struct(F.lit(False).alias("has_uncertain_fields"), F.array().cast("array<string>").alias("uncertain_fields"), F.lit(False).alias("requires_manual_review"))
    made = _case(kind, {
        "high_risk_pass": passes("high_risk_pass"), "wrong_anomaly_type": a.withField("anomaly_types", other),
        "wrong_risk_level": a.withField("risk_level", F.when(a["risk_level"] == "low", "high").otherwise("low")),
        "wrong_evidence_source": a.withField("evidence", _first(a["evidence"], source_image_id=F.lit(WRONG_IMAGE), source_doc_type=F.lit("invoice"))),
        "wrong_bbox": a.withField("evidence", _first(a["evidence"], bbox=F.array(*map(F.lit, WRONG_BOX)))), "unsupported_reason": a.withField("reason", F.lit(SAYS["unsupported_reason"])),
        "hallucinated_field": a.withField("field_extraction.payment_id", F.lit(FAKE_PAYMENT)).withField("reason", F.lit(SAYS["hallucinated_field"])),
        "unreadable_but_guess": a.withField("field_extraction", fields).withField("uncertainty", sure),
        "missing_doc_but_pass": passes("missing_doc_but_pass").withField("consistency_check.document_complete", F.lit(True)),
    })
    return F.when(kind == "json_invalid", BROKEN_JSON).otherwise(answer_json(made))


# --- second builder ----------------------------------------------------------------------------


def eligible_pair_types() -> Column:
    """array of the pair types that a claim (risk_level, audit_result, anomaly_types) is eligible for."""
    high = F.col("risk_level") == "high"
    return reasons(
        (F.lit(True), "hard_rejected"), (high, "high_risk_miss"), (high & F.arrays_overlap("anomaly_types", F.array(*map(F.lit, PROTECTED))), "protective"),
        (F.col("risk_level").isin("low", "medium") | F.col("audit_result").isin("pass", "manual_review", "missing_info"), "normal_calibration"),
    )


def error_type(pair_type: str = "pair_type", label: str = "label") -> Column:
    """The kind of error that a pair's rejected answer makes."""
    t, high, passes = F.col(pair_type), F.col("risk_level") == "high", F.col("audit_result") == "pass"
    protective = F.when(F.col(label).isin("amount_mismatch", "over_reimbursement"), "high_risk_downgrade").when(F.col(label) == "order_id_mismatch", "audit_result_wrong").otherwise("risk_level_wrong")
    hard = F.when(high, "high_risk_downgrade").when(~passes, "audit_result_wrong").otherwise("risk_level_wrong")
    return F.when(t == "high_risk_miss", "high_risk_pass").when(t == "protective", protective).when(t == "normal_calibration", "normal_over_reject").otherwise(hard)


def rejected_pair_answer(answer: Column, pair_type: str = "pair_type", label: str = "label") -> Column:
    """The rejected answer of a pair type, of rows with risk_level and audit_result."""
    a, t, high = answer, F.col(pair_type), F.col("risk_level") == "high"
    judge = lambda risk, result, why: a.withField("risk_level", risk if isinstance(risk, Column) else F.lit(risk)).withField("audit_result", result if isinstance(result, Column) else F.lit(result)).withField("reason", F.lit(PAIR_SAYS[why]))
    unprotected = F.array_except(a["anomaly_types"], F.array(*map(F.lit, PROTECTED)))
    miss = judge("low", "pass", "miss").withField("anomaly_types", unprotected).withField("evidence", _first(a["evidence"], evidence_text=F.lit(PAIR_SAYS["evidence"])))
    lower = judge(F.when(high, "medium").otherwise("low"), F.when(high, "manual_review").otherwise("pass"), "complete")
    protective = F.when(F.col(label).isin("amount_mismatch", "over_reimbursement"), judge("medium", "manual_review", "amount")).when(F.col(label) == "order_id_mismatch", judge("low", "pass", "order")).otherwise(lower)
    over = judge("high", "reject_recommendation", "over").withField("anomaly_types", F.when(F.size(a["anomaly_types"]) == 0, F.array(F.lit("amount_mismatch"))).otherwise(a["anomaly_types"]))
    hard = F.when(high, judge("medium", "manual_review", "downgrade")).when(F.col("audit_result") != "pass", judge("low", "pass", "pass")).otherwise(judge("medium", "manual_review", "manual"))
    return F.when(t == "high_risk_miss", miss).when(t == "protective", protective).when(t == "normal_calibration", over).otherwise(hard)


def boxes_valid(answer: Column) -> Column:
    """Whether every evidence box has four values within 0 to 1000, in order."""
    return F.forall(answer["evidence"], lambda e: (
        (F.size(e["bbox"]) == 4) & F.coalesce(F.forall(e["bbox"], lambda v: (v >= 0) & (v <= 1000)), F.lit(False))
        & F.coalesce((F.get(e["bbox"], F.lit(0)) <= F.get(e["bbox"], F.lit(2))) & (F.get(e["bbox"], F.lit(1)) <= F.get(e["bbox"], F.lit(3))), F.lit(False))
    ))


def references_valid(answer: Column, images: Column) -> Column:
    """Whether all evidence names a known image, of its document if it names one."""
    known = F.transform(images, lambda i: i["image_id"])
    typed = F.transform(images, lambda i: F.concat_ws("\x01", i["image_id"], i["doc_type"]))
    return F.forall(answer["evidence"], lambda e: F.array_contains(known, F.coalesce(e["source_image_id"], F.lit(""))) & (
        (F.coalesce(e["source_doc_type"], F.lit("")) == "") | F.array_contains(typed, F.concat_ws("\x01", e["source_image_id"], e["source_doc_type"]))))


def images_exist(rows: DataFrame, files: DataFrame, key: str, name: str = "images_exist") -> DataFrame:
    """rows with whether all their images (at least one) are among files (path): a join, not a look-up for each row."""
    wanted = rows.select(key, F.explode("images.image_path").alias("path"))
    there = files.select("path").distinct().withColumn("_there", F.lit(1))
    ok = wanted.join(there, "path", "left").groupBy(key).agg((F.count("_there") == F.count("*")).alias(name))
    return rows.join(ok, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def quality_checks(chosen_valid: Column, rejected_valid: Column) -> Column:
    """The seven checks of rows with chosen, rejected (nested), images and images_exist."""
    c, r, images = F.col("chosen"), F.col("rejected"), F.col("images")
    both = lambda f: f(c) & f(r)
    return F.struct(
        F.lit(True).alias("chosen_json_valid"), F.lit(True).alias("rejected_json_valid"), chosen_valid.alias("chosen_schema_valid"), rejected_valid.alias("rejected_schema_valid"),
        F.col("images_exist"), both(lambda a: references_valid(a, images)).alias("evidence_refs_valid"), both(boxes_valid).alias("bbox_range_valid"),
    )


def skip_reason(checks: str = "quality_checks") -> Column:
    """Why a pair is left out, the first reason; null if it stays."""
    q = F.col(checks)
    return F.when(~q["images_exist"], "missing_images").when(~q["chosen_schema_valid"] | ~q["rejected_schema_valid"], "schema_invalid").when(
        ~q["evidence_refs_valid"], "evidence_refs_invalid").when(~q["bbox_range_valid"], "bbox_range_invalid")


def with_weights(pairs: DataFrame, most: float = 3.0) -> DataFrame:
    """pairs with severity, hardness, reliability and final weight, and the weight of the supervised loss."""
    hard = F.col("pair_type").isin("hard_rejected", "protective") & F.col("rejected_error_type").isin("audit_result_wrong", "risk_level_wrong", "high_risk_downgrade")
    x = pairs.withColumns({
        "severity_weight": _case("rejected_error_type", SEVERITY, F.lit(1.0)), "hardness_weight": F.when(hard, 1.5).when(F.col("pair_type") == "high_risk_miss", 1.4).otherwise(1.0),
        "reliability_weight": F.when(F.coalesce(F.col("evidence_sufficient"), F.lit(True)), 1.0).otherwise(0.5),
        "sft_loss_weight": F.when(F.col("pair_type").isin("hard_rejected", "high_risk_miss", "protective"), 1.0).otherwise(0.5),
    })
    return x.withColumn("final_weight", F.least(F.lit(most), F.col("severity_weight") * F.col("hardness_weight") * F.col("reliability_weight")))


def pair_keys(claims: DataFrame) -> DataFrame:
    """The rows of pair_candidates with their ids, error types and weights, without answers and checks, which take most of the work."""
    x = claims.select("case_id", "label", "risk_level", "audit_result", "anomaly_types", "evidence_sufficient").withColumn("pair_type", F.explode(eligible_pair_types()))
    x = x.withColumn("rejected_error_type", error_type())
    return with_weights(x.withColumn("pair_id", F.concat_ws("_", "case_id", "pair_type", "rejected_error_type")))


def pair_candidates(claims: DataFrame, answers: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each claim and pair type it is eligible for: chosen and rejected answers, error type, checks, skip reason, weights.

    files lists the image files that exist (path); without it all are taken to be there. A claim without an answer is an error.
    """
    joined = claims.select(*PAIR_FACTS).join(answers.select("case_id", "answer", "images"), "case_id", "left")
    joined = joined.withColumn("answer", F.when(F.col("answer").isNull(), F.raise_error(F.concat(F.lit("no answer for "), "case_id"))).otherwise(F.col("answer")))
    return answered_candidates(joined, files)


def answered_candidates(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """pair_candidates of rows that hold PAIR_FACTS, answer and images already, so answers are not sent to be joined; other columns are kept."""
    x = held(rows.withColumn("pair_type", F.explode(eligible_pair_types())))
    x = x.withColumns({"chosen": F.col("answer"), "rejected": rejected_pair_answer(F.col("answer")), "rejected_error_type": error_type()}).drop("answer")
    x = x.withColumn("images_exist", F.size("images") > 0) if files is None else images_exist(x.withColumn("pair_key", F.concat_ws("_", "case_id", "pair_type")), files, "pair_key").drop("pair_key")
    x = held(x)
    x = held(x.withColumn("quality_checks", quality_checks(answer_valid(F.col("chosen")), answer_valid(F.col("rejected")))))
    return with_weights(x.withColumns({"skip": skip_reason(), "pair_id": F.concat_ws("_", "case_id", "pair_type", "rejected_error_type")}))


def three_way_split(rows: DataFrame, key: str, salt: int | str, holdout_percent: int = 10, decode: int = 200, name: str = "role", counted: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """key and role: the first share of keys in hash order is holdout (at least one), the next `decode` are decode_dev, the rest train.

    counted, a cheaper frame with the same keys, is what rows are counted on; keep names more columns of rows, which then need no join.
    """
    n = (rows if counted is None else counted).count()
    first = max(1, n * holdout_percent // 100) if n else 0
    second = min(max(0, decode), max(0, n - first))
    r = F.col("_r")
    return global_rank(rows.select(key, *(keep or [])), key, salt, name="_r", counted=counted, rows=n).select(key, *(keep or []), F.when(r <= first, "holdout").when(r <= first + second, "decode_dev").otherwise("train").alias(name))


def quotas(n: int, shares: dict[str, int] = PAIR_SHARES) -> dict[str, int]:
    """n by shares in hundredths, each rounded half even, the last with what is left."""
    out, left = {}, n
    for k, share in list(shares.items())[:-1]:
        out[k] = round(n * share / 100)
        left -= out[k]
    return out | {list(shares)[-1]: left}


def select_pairs(pairs: DataFrame, most: int, salt: int | str, cap_percent: int = 25) -> DataFrame:
    """pairs chosen under the quotas of their types and one cap for each anomaly, with their place: each type's quota in turn, then any up to `most`."""
    got = selection.select(pairs, "pair_id", "pair_type", "label", quotas(most), most, max(1, most * cap_percent // 100), salt)
    return pairs.join(got, "pair_id")


# --- mined pairs -------------------------------------------------------------------------------


def mining_bucket(answer: Column) -> Column:
    """order_id_mismatch, other_high_risk or low_pass; null for other answers."""
    rejected = (answer["risk_level"] == "high") & (answer["audit_result"] == "reject_recommendation")
    return F.when(rejected & F.array_contains(answer["anomaly_types"], "order_id_mismatch"), "order_id_mismatch").when(rejected, "other_high_risk").when(
        (answer["risk_level"] == "low") & (answer["audit_result"] == "pass"), "low_pass")


def structured_order_ids(answer: Column, words: tuple[str, str, str] = ORDER_REASON) -> Column:
    """The answer with both order ids as its first evidence and the decision they make; null unless there are two different ones.

    The two builders that do this differ in the reason's words (ORDER_REASON, REPAIR_REASON).
    """
    mine = lambda e, d: (e["field"] == "order_id") & (e["source_doc_type"] == d)
    item = lambda d: F.get(F.filter(answer["evidence"], lambda e: mine(e, d)), F.lit(0))
    a, b = item("order"), item("reimbursement_form")
    rest = F.filter(answer["evidence"], lambda e: ~F.coalesce(mine(e, "order") | mine(e, "reimbursement_form"), F.lit(False)))
    anomalies = F.when(F.array_contains(answer["anomaly_types"], "order_id_mismatch"), answer["anomaly_types"]).otherwise(F.array_append(answer["anomaly_types"], F.lit("order_id_mismatch")))
    made = (
        answer.withField("consistency_check.order_id_consistent", F.lit(False)).withField("anomaly_types", anomalies).withField("risk_level", F.lit("high"))
        .withField("audit_result", F.lit("reject_recommendation")).withField("reason", F.concat(F.lit(words[0]), a["value"], F.lit(words[1]), b["value"], F.lit(words[2])))
        .withField("evidence", F.concat(F.array(a, b), rest))
    )
    return F.when((F.coalesce(a["value"], F.lit("")) != "") & (F.coalesce(b["value"], F.lit("")) != "") & (a["value"] != b["value"]), made)


def escalated(answer: Column) -> Column:
    """A low claim's answer that wrongly rejects it for a missing document."""
    anomalies = F.array_append(F.array_remove(answer["anomaly_types"], "missing_document"), F.lit("missing_document"))
    return (
        answer.withField("risk_level", F.lit("high")).withField("audit_result", F.lit("reject_recommendation")).withField("anomaly_types", anomalies)
        .withField("consistency_check.document_complete", F.lit(False)).withField("reason", F.lit(ESCALATED))
    )


def mined_pairs(completions: DataFrame, min_gap: float = MIN_GAP, max_gap: float = MAX_GAP, expert: bool = True) -> DataFrame:
    """pair_type, sources, rewards and gap of the pairs that completions give, by case.

    completions: case_id, model (any name), position (from 0), answer, images, pred, json_valid, schema_valid. An order id case pairs its
    best good completion, or the expert's answer, with its best failing one (a good one never fails); a low case pairs its best good
    completion with an escalated copy; other cases give none; the earliest of equals is the best. The gap of preference scores must be within
    the limits. The expert's answer and the escalated copies are scored beside the completions, so the table is read once, and a
    case's few scores meet in one aggregate.
    """
    x = held(completions.withColumn("bucket", mining_bucket(F.col("answer")))).where(F.col("bucket").isin(*MINED_BUCKETS))
    is_order = F.col("bucket") == "order_id_mismatch"
    x = held(x.withColumn("answer", F.when(is_order, structured_order_ids(F.col("answer"))).otherwise(F.col("answer")))).where("answer is not null")
    made = lambda kind, pred, ok: F.when(ok, F.struct(F.lit(kind).alias("kind"), pred.alias("pred")))
    valid = F.coalesce(F.col("schema_valid"), F.lit(False))
    variants = F.array_compact(F.array(
        made("own", F.col("pred"), valid), made("escalated", escalated(F.col("pred")), valid & ~is_order), made("expert", F.col("answer"), is_order & (F.col("position") == 0) & F.lit(expert))))
    x = x.withColumn("_v", F.explode(variants)).withColumns({"kind": F.col("_v.kind"), "pred": F.col("_v.pred"), "json_valid": F.lit(True), "schema_valid": F.lit(True)})
    scored = held(reward(x, "bucket", "position", "kind").withColumns({"quality": preference_quality(), "ok": core_ok(), "failed": order_failure()}))
    said = F.struct("quality", "reward", "position")
    best = lambda c: F.max_by(F.when(c, said), F.when(c, F.struct("quality", -F.col("position"))))
    own = F.col("kind") == "own"
    cases = scored.groupBy("case_id", "bucket").agg(
        best(own & F.col("ok")).alias("good"), best(own & F.col("failed")).alias("bad"), best(F.col("kind") == "expert").alias("expert"), F.collect_list(F.when(F.col("kind") == "escalated", said)).alias("fakes"))
    is_order = F.col("bucket") == "order_id_mismatch"
    fake = F.get(F.filter("fakes", lambda f: f["position"] == F.col("good.position")), F.lit(0))
    cases = cases.withColumns({"chosen": F.coalesce("good", F.when(is_order, F.col("expert"))), "rejected": F.when(is_order, F.col("bad")).otherwise(fake)})
    both = cases.where("chosen is not null and rejected is not null").select(
        "case_id", F.col("bucket").alias("pair_type"), F.when(F.col("good").isNotNull(), "model_generated").otherwise("expert_corrected_target").alias("chosen_source"),
        F.when(is_order, "model_generated").otherwise("synthetic_false_escalation_calibration").alias("rejected_source"), F.col("chosen.quality").alias("chosen_reward"), F.col("rejected.quality").alias("rejected_reward"),
        (F.col("chosen.quality") - F.col("rejected.quality")).alias("reward_gap"), F.col("chosen.reward").alias("chosen_task_reward"), F.col("rejected.reward").alias("rejected_task_reward"), _case("bucket", BUCKET_WEIGHTS).alias("final_weight"),
    )
    return both.where((F.col("reward_gap") + SLACK >= min_gap) & (F.col("reward_gap") - SLACK <= max_gap))


def take_holdout(pairs: DataFrame, n: int, salt: int | str, name: str = "part") -> DataFrame:
    """pairs with part holdout or train: three quarters of the holdout are order id pairs, the rest low ones, by hash order."""
    order = n * 3 // 4
    quota = _case("pair_type", {"order_id_mismatch": order, "low_pass": n - order}, F.lit(0))
    return global_rank(pairs, "case_id", salt, ["pair_type"], "_r").withColumn(name, F.when(F.col("_r") <= quota, "holdout").otherwise("train")).drop("_r")


def pair_audit(pairs: DataFrame, min_gap: float = MIN_GAP, max_gap: float = MAX_GAP) -> DataFrame:
    """One row on pairs (case_id, part, reward_gap, task rewards, sources, final_weight): counts, ranges, and whether all rules hold."""
    cases = pairs.groupBy("case_id").agg(F.count_distinct("part").alias("parts")).agg(F.count_if(F.col("parts") > 1).alias("overlap"))
    gap, out = F.col("reward_gap"), F.col("chosen_task_reward") - F.col("rejected_task_reward")
    n = lambda c: F.count_if(c)
    stats = pairs.agg(
        n(F.col("part") == "train").alias("train_pairs"), n(F.col("part") == "holdout").alias("holdout_pairs"), n((gap + SLACK < min_gap) | (gap - SLACK > max_gap)).alias("gaps_out_of_range"),
        n(out <= 0).alias("nonpositive_task_gaps"), n(F.col("chosen_source") == "expert_corrected_target").alias("expert_chosen"), F.min("reward_gap").alias("gap_min"), F.max("reward_gap").alias("gap_max"),
        F.avg("reward_gap").alias("gap_mean"), F.min("final_weight").alias("weight_min"), F.max("final_weight").alias("weight_max"), F.avg("final_weight").alias("weight_mean"),
    )
    ok = (F.col("overlap") == 0) & (F.col("gaps_out_of_range") == 0) & (F.col("nonpositive_task_gaps") == 0)
    return stats.crossJoin(F.broadcast(cases)).withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def trainable(rows: DataFrame) -> DataFrame:
    """Rows that can train: prompt, chosen and rejected not empty, at least one image."""
    said = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return rows.where(said("prompt") & said("chosen") & said("rejected") & (F.size("images") > 0))
