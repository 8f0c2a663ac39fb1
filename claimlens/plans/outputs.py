"""Annotations and nested answers of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import held, money_text, scaled_box, some_of

#: Fields of each document in the order they are printed, and the canvas in pixels.
LAYOUT = {
    "invoice": ["invoice_id", "invoice_date", "invoice_merchant", "invoice_amount", "tax_amount", "expense_type"],
    "payment": ["payment_id", "payment_date", "payment_merchant", "payment_amount", "payer"],
    "reimbursement_form": ["applicant", "expense_type", "reimbursement_amount", "application_date", "order_id"],
    "order": ["order_id", "order_date", "order_merchant", "order_amount", "order_user", "expense_type"],
}
WIDTH, HEIGHT, LEFT, TOP, LINE, CHAR, GLYPH = 900, 640, 240, 160, 52, 13, 26
#: Money fields, and all fields of an answer, in their order.
MONEY = ["invoice_amount", "payment_amount", "reimbursement_amount", "order_amount", "tax_amount"]
FIELDS = [
    *MONEY, "invoice_merchant", "payment_merchant", "order_merchant", "merchant", "applicant", "payer", "order_user", "invoice_date", "payment_date",
    "order_date", "application_date", "invoice_id", "order_id", "payment_id", "expense_type",
]
#: Fields that back each anomaly as evidence, and those always wanted.
EVIDENCE = {
    "amount_mismatch": ["invoice_amount", "payment_amount", "reimbursement_amount", "order_amount"],
    "over_reimbursement": ["invoice_amount", "payment_amount", "reimbursement_amount"],
    "date_mismatch": ["order_date", "payment_date", "invoice_date", "application_date"],
    "merchant_mismatch": ["invoice_merchant", "payment_merchant", "order_merchant"],
    "applicant_mismatch": ["applicant", "payer", "order_user"],
    "order_id_mismatch": ["order_id"],
    "duplicate_in_batch": ["invoice_id", "order_id"],
}
ALWAYS = ["invoice_amount", "payment_amount", "reimbursement_amount", "order_amount", "applicant", "payment_id"]
MAX_EVIDENCE = 24
#: The flags of an answer, anomalies of training priority, names of documents, and the texts of prompts and reasons.
CHECKS = ["amount_consistent", "merchant_consistent", "person_consistent", "date_reasonable", "order_id_consistent", "payment_id_present", "document_complete", "duplicate_in_batch"]
PRIORITY = ["over_reimbursement", "merchant_mismatch", "applicant_mismatch", "order_id_mismatch", "missing_document", "unreadable_image"]
DOCUMENT_NAMES = {"invoice": "发票", "payment": "支付截图", "reimbursement_form": "报销申请单", "order": "订单截图"}
PROMPT_HEAD = (
    "你是企业费用报销一致性审计助手。请只输出一个合法 JSON，不要输出解释性段落。\n"
    "必须使用字段 case_id、field_extraction、consistency_check、anomaly_types、risk_level、audit_result、reason、evidence、uncertainty。\n"
    "不得输出 primary_anomaly_type 或 evidence_sufficient。\n"
    "检查订单号时必须分别读取订单截图(order)和报销申请单(reimbursement_form)中的 order_id；"
    "如果两者可见且不同，必须设置 consistency_check.order_id_consistent=false，"
    "anomaly_types 包含 order_id_mismatch，risk_level=high，audit_result=reject_recommendation，"
    "并在 evidence 中同时给出这两处 order_id 证据。\n"
    "bbox 必须使用 0 到 1000 的 [x1, y1, x2, y2] 归一化坐标。\n"
    "输入图片如下：\n"
)
TASK = "完成多凭证一致性审核，输出完整 Evidence-Grounded JSON。"
ALL_AGREE = "材料完整且金额、商户、人员、日期与订单号一致，建议通过。"
REASON_MISSING = ("缺少", "，证据不足，需要补充材料。")
REASON_UNREADABLE = ("存在不可读字段：", "，无法可靠完成自动审核。")
REASON_FOUND = ("检测到", "，风险等级为", "，审核建议为", "。")


def field_text(field: str, doc_type: str | None = None) -> Column:
    """What a document prints for a field."""
    if field in MONEY:
        return money_text(field)
    if field == "order_id" and doc_type == "order":
        return F.col("shown_order_id")
    return F.col(field).cast("string")


def annotations(claims: DataFrame) -> DataFrame:
    """One row per printed field: image, document, field, value, boxes, readable; copies of duplicates too."""
    rows = F.array(*(
        F.struct(F.lit(d).alias("doc_type"), F.lit(f).alias("field"), field_text(f, d).alias("value"), F.lit(k).alias("line"))
        for d, fields in LAYOUT.items() for k, f in enumerate(fields)
    ))
    shown = claims.select("case_id", "documents", "unreadable_fields", "duplicate_document", F.inline(rows)).where(F.array_contains("documents", F.col("doc_type")))
    twice = F.when(F.col("doc_type") == F.col("duplicate_document"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x2 = F.lit(LEFT) + F.length("value") * CHAR
    y1 = F.lit(TOP) + F.col("line") * LINE
    return shown.withColumn("copy", F.explode(twice)).select(
        "case_id", F.concat_ws("_", "case_id", "doc_type", F.lpad(F.col("copy").cast("string"), 2, "0")).alias("image_id"), "doc_type", "field", "value",
        F.array(F.lit(LEFT), y1, x2, y1 + GLYPH).alias("bbox_abs"),
        F.array(scaled_box(F.lit(LEFT), WIDTH), scaled_box(y1, HEIGHT), scaled_box(x2, WIDTH), scaled_box(y1 + GLYPH, HEIGHT)).alias("bbox"),
        (~F.array_contains("unreadable_fields", F.col("field"))).alias("readable"),
        F.when(F.col("copy") == 1, F.concat_ws("_", "case_id", "doc_type", F.lit("00"))).alias("duplicate_of_image_id"),
    )


def field_extraction(claims: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, field, value: the canonical merchant always, other fields if some record of theirs is readable."""
    readable = records.groupBy("case_id").agg(F.collect_set(F.when(F.col("readable"), F.col("field"))).alias("_readable"))
    has = lambda f: F.coalesce(F.array_contains("_readable", f) & ~F.array_contains("unreadable_fields", f), F.lit(False))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), (field_text(f) if f == "merchant" else F.when(has(f), field_text(f))).alias("value")) for f in FIELDS))
    return claims.join(readable, "case_id", "left").select("case_id", F.inline(cells))


def extracted_cells(claims: DataFrame) -> DataFrame:
    """field_extraction of claims and their own annotations, from the layout of the documents: within the row, no record is made or grouped."""
    seen = lambda f: F.arrays_overlap("documents", F.array(*(F.lit(d) for d, fields in LAYOUT.items() if f in fields))) & ~F.array_contains("unreadable_fields", f)
    cells = F.array(*(F.struct(F.lit(f).alias("field"), (field_text(f) if f == "merchant" else F.when(F.coalesce(seen(f), F.lit(False)), field_text(f))).alias("value")) for f in FIELDS))
    return claims.select("case_id", F.inline(cells))


def consistency_checks() -> list[Column]:
    """The eight flags of an answer."""
    has = lambda *labels: F.arrays_overlap("anomaly_types", F.array(*map(F.lit, labels)))
    return [
        (~has("amount_mismatch", "over_reimbursement")).alias("amount_consistent"), (~has("merchant_mismatch")).alias("merchant_consistent"),
        (~has("applicant_mismatch")).alias("person_consistent"), (~has("date_mismatch")).alias("date_reasonable"),
        (~has("order_id_mismatch")).alias("order_id_consistent"), F.array_contains("documents", "payment").alias("payment_id_present"),
        (~has("missing_document")).alias("document_complete"), has("duplicate_in_batch").alias("duplicate_in_batch"),
    ]


def evidence(claims: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, pos and the record: readable originals of the wanted fields, ordered, the first 24 of a case."""
    usable = records.where("readable and duplicate_of_image_id is null")
    joined = usable.join(claims.select("case_id", wanted_fields().alias("_wanted")), "case_id").where(F.array_contains("_wanted", F.col("field"))).drop("_wanted")
    order = Window.partitionBy("case_id").orderBy("doc_type", "field", "image_id")
    return joined.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= MAX_EVIDENCE).select("case_id", "pos", "image_id", "doc_type", "field", "value", "bbox")


def wanted_fields() -> Column:
    """Fields that a claim's anomalies call for, and those always wanted, but for unreadable ones."""
    pairs = [x for k, v in EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    called = F.flatten(F.transform("anomaly_types", lambda a: F.coalesce(F.try_element_at(F.create_map(*pairs), a), F.array().cast("array<string>"))))
    return F.array_except(F.array_union(called, F.array(*map(F.lit, ALWAYS))), F.col("unreadable_fields"))


def _name_of(document: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in DOCUMENT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, document), document)


def reason_text() -> Column:
    """Why a claim is judged as it is, in words."""
    say = lambda words, *parts: F.concat(*(x for w, p in zip(words, [*parts, None], strict=True) for x in ((F.lit(w), p) if p is not None else (F.lit(w),))))
    missing = _name_of(F.get(F.array_except(F.array(*map(F.lit, LAYOUT)), F.col("documents")), F.lit(0)))
    return (
        F.when(F.size("anomaly_types") == 0, ALL_AGREE)
        .when(F.array_contains("anomaly_types", "missing_document"), say(REASON_MISSING, F.coalesce(missing, F.lit("unknown"))))
        .when(F.array_contains("anomaly_types", "unreadable_image"), say(REASON_UNREADABLE, F.array_join("unreadable_fields", "、")))
        .otherwise(say(REASON_FOUND, F.array_join("anomaly_types", "、"), F.col("risk_level"), F.col("audit_result")))
    )


def uncertainty() -> Column:
    """Unreadable fields, and whether a person must look."""
    return F.struct(
        ((F.size("unreadable_fields") > 0) | ~F.col("evidence_sufficient")).alias("has_uncertain_fields"), F.col("unreadable_fields").alias("uncertain_fields"),
        F.col("audit_result").isin("manual_review", "missing_info").alias("requires_manual_review"),
    )


def image_items() -> Column:
    """array of image_id, doc_type and image_path: a claim's documents, then the copy of a duplicate."""
    item = lambda d, k: F.struct(F.concat_ws("_", "case_id", d, F.lit(k)).alias("image_id"), d.alias("doc_type"), F.concat(F.lit("images/"), F.concat_ws("_", "case_id", d, F.lit(k)), F.lit(".png")).alias("image_path"))
    copies = F.filter("documents", lambda d: F.coalesce(d == F.col("duplicate_document"), F.lit(False)))
    return F.concat(F.transform("documents", lambda d: item(d, "00")), F.transform(copies, lambda d: item(d, "01")))


def answers(claims: DataFrame, *keep: str) -> DataFrame:
    """case_id, label, answer, images and the columns to keep: the nested answer of each claim, by the output contract; made within the row, no shuffle.

    Evidence is laid out in its order (document, field) already, so nothing is sorted: each of the printed fields is there or not.
    """
    printed = sorted((d, f, k) for d, fields in LAYOUT.items() for k, f in enumerate(fields))
    place = {f: [d for d, fields in LAYOUT.items() if f in fields] for f in FIELDS}
    facts = ["case_id", "label", "documents", "anomaly_types", "unreadable_fields", "evidence_sufficient", "risk_level", "audit_result", "duplicate_document"]
    x = held(claims.select(
        *facts, *(c for c in keep if c not in facts),
        *(field_text(f).alias(f"_{f}") for f in FIELDS), F.col("shown_order_id"), wanted_fields().alias("_wanted"),
        *(F.array_contains("documents", d).alias(f"_has_{d}") for d in LAYOUT),
    ))
    shown = lambda d, f: F.col("shown_order_id") if (d, f) == ("order", "order_id") else F.col(f"_{f}")
    line = lambda k: (scaled_box(F.lit(TOP + LINE * k), HEIGHT), scaled_box(F.lit(TOP + LINE * k + GLYPH), HEIGHT))
    items = some_of(*(
        (F.col(f"_has_{d}") & F.array_contains("_wanted", f), F.struct(
            F.concat_ws("_", "case_id", F.lit(d), F.lit("00")).alias("source_image_id"), F.lit(d).alias("source_doc_type"), F.lit(f).alias("field"), shown(d, f).alias("value"),
            F.array(scaled_box(F.lit(LEFT), WIDTH), line(k)[0], scaled_box(F.lit(LEFT) + F.length(shown(d, f)) * CHAR, WIDTH), line(k)[1]).alias("bbox"),
            F.concat(F.lit(f"{f}: "), shown(d, f)).alias("evidence_text"),
        )) for d, f, k in printed
    ), kind="struct<source_image_id:string,source_doc_type:string,field:string,value:string,bbox:array<int>,evidence_text:string>")
    seen = lambda f: reduce(lambda a, b: a | b, (F.col(f"_has_{d}") for d in place[f])) & ~F.array_contains("unreadable_fields", f)
    fields = F.struct(*((F.col(f"_{f}") if f == "merchant" else F.when(seen(f), F.col(f"_{f}"))).alias(f) for f in FIELDS))
    return held(x.select(
        "case_id", "label", F.struct(
            "case_id", fields.alias("field_extraction"), F.struct(*consistency_checks()).alias("consistency_check"), "anomaly_types", "risk_level", "audit_result",
            reason_text().alias("reason"), F.slice(items, 1, MAX_EVIDENCE).alias("evidence"), uncertainty().alias("uncertainty"),
        ).alias("answer"),
        image_items().alias("images"), *keep,
    ))


def prompt(case_id: str = "case_id", images: str = "images", task: str = TASK) -> Column:
    """The prompt of a claim: the rules, one line for each image, the task."""
    lines = F.transform(images, lambda i: F.concat(F.lit("- "), i["image_id"], F.lit(": "), _name_of(i["doc_type"]), F.lit(" ("), i["doc_type"], F.lit("), path="), i["image_path"]))
    return F.concat(F.lit(PROMPT_HEAD), F.array_join(lines, "\n"), F.lit(f"\n\n任务：{task}\ncase_id="), F.col(case_id))


def answer_json(answer: str | Column = "answer") -> Column:
    """An answer as compact JSON, nulls kept."""
    return F.to_json(answer, {"ignoreNullFields": "false"})


def messages(prompt: Column, answer: Column) -> Column:
    """The user's and the assistant's message."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(say("user", prompt), say("assistant", answer))


def grpo_prompts(claims: DataFrame, records: DataFrame, most: int | None = None) -> DataFrame:
    """id, case_id, images, prompt, ground_truth (output and readable original records), reward_tags; by falling priority, the first `most`."""
    score = F.when(F.col("risk_level") == "high", 100).otherwise(0) + F.when(F.arrays_overlap("anomaly_types", F.array(*map(F.lit, PRIORITY))), 50).otherwise(0) + F.when(F.col("audit_result") != "pass", 20).otherwise(0)
    if most is not None:
        claims = claims.withColumn("_score", score).orderBy(F.desc("_score"), "case_id").limit(most).drop("_score")
    usable = records.where("readable and duplicate_of_image_id is null").groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("image_id", "doc_type", "field", "value", F.col("bbox").alias("bbox_norm")))).alias("bbox_records"))
    tags = F.struct(
        (F.col("answer.risk_level") == "high").alias("high_risk"), F.arrays_overlap("answer.anomaly_types", F.array(*map(F.lit, PRIORITY))).alias("priority_anomaly"),
        F.array_contains("answer.anomaly_types", "missing_document").alias("missing_document"), F.array_contains("answer.anomaly_types", "unreadable_image").alias("unreadable_image"),
    )
    return answers(claims).join(usable, "case_id", "left").select(
        F.concat("case_id", F.lit("_grpo")).alias("id"), "case_id", "images", prompt().alias("prompt"),
        F.struct(F.col("answer").alias("output"), "bbox_records").alias("ground_truth"), tags.alias("reward_tags"),
    )


def augmentation(split: str, case_key: str, seed: int = 42) -> Column:
    """robust for test_robust, light for a third of train by a stable hash, none for the rest."""
    seed_of = F.conv(F.substring(F.sha2(F.col(case_key), 256), 1, 8), 16, 10).cast("bigint") + F.lit(seed)
    return F.when(F.col(split) == "test_robust", "robust").when((F.col(split) == "train") & (F.pmod(seed_of, F.lit(3)) == 0), "light").otherwise("none")
