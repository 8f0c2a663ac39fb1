"""Model predictions made from true answers: right ones, wrapped in three ways, and ten kinds of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SEED, held
from .outputs import FIELDS, answer_json

RIGHT = ["plain", "fenced", "in_words"]
#: The kinds of faults, and what they write.
FAULTS = [
    "json_invalid", "schema_invalid", "high_risk_pass", "false_manual_review", "wrong_evidence_source", "wrong_bbox", "unsupported_conclusion",
    "hallucinated_field", "missing_doc_fake_bbox", "unreadable_but_guess",
]
BROKEN_JSON = '{"case_id": "broken", "audit_result": pass'
GHOST, FAKE_PAYMENT, GUESS, FAKE_BOX = "MV_DEBUG_FAKE_IMAGE", "PAY99999999999999", "999.99", [0, 0, 10, 10]
FAKE_EVIDENCE = {
    "hallucinated_field": (GHOST, "payment", "payment_id", FAKE_PAYMENT, [1, 1, 20, 20], "伪造流水号"),
    "missing_doc_fake_bbox": ("MISSING_DOC_IMAGE", "reimbursement_form", "reimbursement_amount", GUESS, [100, 100, 200, 140], "缺失材料伪证据"),
}
REASONS = {
    "high_risk_pass": "未发现异常，建议通过。", "false_manual_review": "证据已充分但仍要求人工复核。", "unsupported_conclusion": "根据模型直觉判断该审核结论正确，无法提供证据。",
}
AROUND = ("审核结果如下：\n", "\n请以 JSON 为准。")
MODES = RIGHT + FAULTS


def _draw(tag: str) -> Column:
    key = F.concat(F.lit(f"{SEED}:"), F.col("case_id"), F.lit(f":{tag}-"), F.col("model"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def mode_of(answer: Column) -> Column:
    """The fault that falls to a case and model; one that the answer has no room for becomes another."""
    drawn = F.element_at(F.array(*map(F.lit, MODES)), (F.pmod(_draw("mode"), F.lit(len(MODES))) + 1).cast("int"))
    other = F.when(F.pmod(_draw("other"), F.lit(2)) == 0, "wrong_evidence_source").otherwise("hallucinated_field")
    return (
        F.when((drawn == "high_risk_pass") & (answer["risk_level"] != "high"), "wrong_bbox")
        .when((drawn == "false_manual_review") & (answer["audit_result"] != "pass"), "wrong_evidence_source")
        .when((drawn == "unreadable_but_guess") & (F.size(answer["uncertainty"]["uncertain_fields"]) == 0), other).otherwise(drawn)
    )


def _evidence(values: tuple) -> Column:
    image, document, field, value, box, text = values
    return F.struct(*(F.lit(v).alias(n) for n, v in (("source_image_id", image), ("source_doc_type", document), ("field", field), ("value", value))), F.array(*map(F.lit, box)).alias("bbox"), F.lit(text).alias("evidence_text"))


def predictions(answers: DataFrame, models: list[str]) -> DataFrame:
    """answers, once for each model, with model, mode, json_valid, schema_valid and pred."""
    rows = answers.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    rows = held(rows.withColumn("mode", mode_of(F.col("answer"))))
    a, is_ = F.col("answer"), lambda *m: F.col("mode").isin(*m)
    items, checks, unsure = a["evidence"], a["consistency_check"], a["uncertainty"]["uncertain_fields"]
    first = lambda change: F.when(F.size(items) > 0, F.concat(F.array(change(F.get(items, F.lit(0)))), F.slice(items, F.lit(2), F.size(items)))).otherwise(items)
    evidence = (
        F.when(is_("wrong_evidence_source"), first(lambda x: x.withField("source_image_id", F.lit(GHOST))))
        .when(is_("wrong_bbox"), first(lambda x: x.withField("bbox", F.array(*map(F.lit, FAKE_BOX)))))
        .when(is_("hallucinated_field"), F.array_append(items, _evidence(FAKE_EVIDENCE["hallucinated_field"])))
        .when(is_("missing_doc_fake_bbox"), F.array_append(items, _evidence(FAKE_EVIDENCE["missing_doc_fake_bbox"]))).otherwise(items)
    )
    reason = F.coalesce(*(F.when(is_(m), t) for m, t in REASONS.items()), a["reason"])
    # In steps: the JVM only compiles methods of up to 8,000 bytes, and one step that makes all of a prediction is longer.
    columns = rows.columns
    rows = held(rows.withColumns({"_evidence": evidence, "_reason": reason}))
    guess = lambda f: F.when(is_("unreadable_but_guess") & F.array_contains(unsure, f), GUESS)
    fields = F.struct(*(
        (F.when(is_("hallucinated_field"), FAKE_PAYMENT).otherwise(a["field_extraction"][f]) if f == "payment_id" else guess(f).otherwise(a["field_extraction"][f])).alias(f) for f in FIELDS
    ))
    sure = F.struct(F.lit(False).alias("has_uncertain_fields"), F.array().cast("array<string>").alias("uncertain_fields"), F.lit(False).alias("requires_manual_review"))
    pred = F.struct(
        a["case_id"].alias("case_id"), fields.alias("field_extraction"), checks.withField("document_complete", checks["document_complete"] | is_("missing_doc_fake_bbox")).alias("consistency_check"),
        a["anomaly_types"].alias("anomaly_types"), F.when(is_("high_risk_pass"), "low").otherwise(a["risk_level"]).alias("risk_level"),
        F.when(is_("high_risk_pass"), "pass").when(is_("false_manual_review"), "manual_review").otherwise(a["audit_result"]).alias("audit_result"),
        F.col("_reason").alias("reason"), F.col("_evidence").alias("evidence"), F.when(is_("unreadable_but_guess"), sure).otherwise(a["uncertainty"]).alias("uncertainty"),
    )
    broken = is_("json_invalid", "schema_invalid")
    return rows.select(*columns, (~is_("json_invalid")).alias("json_valid"), (~broken).alias("schema_valid"), F.when(~broken, pred).alias("pred"))


def raw_output() -> Column:
    """What the model says: the prediction as JSON, plain, fenced or among words, or not as the contract wants it."""
    text = answer_json(F.coalesce("pred", "answer"))
    return (
        F.when(F.col("mode") == "json_invalid", BROKEN_JSON)
        .when(F.col("mode") == "schema_invalid", F.concat(F.lit('{"primary_anomaly_type":"none",'), F.substring(text, 2, 1 << 30)))
        .when(F.col("mode") == "fenced", F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(F.col("mode") == "in_words", F.concat(F.lit(AROUND[0]), text, F.lit(AROUND[1]))).otherwise(text)
    )
