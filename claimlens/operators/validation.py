"""Constraint checks as columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema
from ..functions.contract import ANOMALIES, RESULTS, RISKS
from ..functions.exprs import reasons
from ..plans.claims import DOCUMENTS

#: What a case says, and how.
PEOPLE = ["applicant", "payer", "order_user", "merchant_canonical", "invoice_merchant", "payment_merchant", "order_merchant", "expense_type"]
AMOUNTS = ["invoice_amount", "payment_amount", "reimbursement_amount", "order_amount", "tax_amount"]
DATES = ["order_date", "payment_date", "invoice_date", "application_date"]
NUMBERS = {"invoice_id": "INV", "order_id": "ORD", "payment_id": "PAY"}
MONEY, DATE, CASE_ID = r"^[0-9]+\.[0-9]{2}$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^MV_[A-Za-z0-9]+_[0-9]{6,}$"
GROUPS = ["train", "val", "standard_test", "strong_generalization_test"]


def case_schema() -> dict:
    """The JSON Schema of a case."""
    some, like, one_of = {"type": "string", "minLength": 1}, lambda p: {"type": "string", "pattern": p}, lambda names: {"type": "string", "enum": names}
    parts = {
        "case_id": like(CASE_ID), **dict.fromkeys(PEOPLE, some), "merchant_aliases": {"type": "array", "items": some, "uniqueItems": True}, **dict.fromkeys(AMOUNTS, like(MONEY)), **dict.fromkeys(DATES, like(DATE)),
        **{k: like(f"^{head}[0-9]{{8}}[0-9]{{6}}$") for k, head in NUMBERS.items()}, "documents": {"type": "array", "items": one_of(DOCUMENTS), "uniqueItems": True, "minItems": 1, "maxItems": 4},
        "primary_anomaly_type": one_of(["none", *ANOMALIES]), "anomaly_types": {"type": "array", "items": one_of(ANOMALIES), "uniqueItems": True}, "evidence_sufficient": {"type": "boolean"},
        "risk_level": one_of(RISKS), "audit_result": one_of(RESULTS),
    }
    more = {"split_name": some, "source": some, "template_group": one_of(GROUPS), "seed": {"type": "integer"}, "city": {"type": "string"}, "merchant_category": {"type": "string"}}
    parts["metadata"] = {"type": "object", "additionalProperties": True, "required": list(more)[:4], "properties": more}
    return {"type": "object", "additionalProperties": False, "required": list(parts), "properties": parts}


def case_errors(text: str | Column, document: dict | None = None) -> Column:
    """array<string>: what is wrong with a case given as JSON text, by path: by its schema, or else by what dates and normal cases have to keep.

    A text that is no JSON (or null) has the one error `<root>: no JSON`. The rules after the schema apply only to cases that meet it.
    """
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(F.try_parse_json(F.col(text) if isinstance(text, str) else text), lambda v: once(schema.errors(document or case_schema())(v), lambda found: _all_errors(v, found)))


def _all_errors(v: Column, found: Column) -> Column:
    """What is wrong with a parsed case, from what its schema finds; both are named many times, so they are values that are there already."""
    of = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    day = {d: F.try_to_date(of(d), "yyyy-MM-dd") for d in DATES}
    normal = F.coalesce(of("primary_anomaly_type") == "none", F.lit(False))
    same = lambda names: F.size(F.array_distinct(F.array(*map(of, names)))) > 1
    ordered = (day["order_date"] <= day["payment_date"]) & (day["payment_date"] <= day["invoice_date"]) & (day["invoice_date"] <= day["application_date"])
    rules = reasons(
        *((day[d].isNull(), f"{d}: no date") for d in DATES), (normal & same(AMOUNTS[:4]), "<root>: amounts of a normal case differ"), (normal & same(PEOPLE[:3]), "<root>: persons of a normal case differ"),
        (normal & ~F.coalesce(ordered, F.lit(True)), "<root>: dates of a normal case are out of order"),
        (normal & (F.size(F.try_variant_get(v, "$.anomaly_types", "array<string>")) > 0), "<root>: a normal case has anomalies"), (normal & ((of("risk_level") != "low") | (of("audit_result") != "pass")), "<root>: a normal case is not low and passed"),
        (normal & (of("evidence_sufficient") != "true"), "<root>: a normal case lacks evidence"),
    )
    return F.when(v.isNull(), F.array(F.lit("<root>: no JSON"))).when(F.size(found) > 0, found).otherwise(rules)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many; empty if the key is one."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def claim_violations() -> Column:
    """array<string> of the rules that a claim breaks."""
    amounts = F.array("invoice_amount", "payment_amount", "reimbursement_amount", "order_amount")
    agree = (
        (F.array_max(amounts) == F.array_min(amounts)) & F.col("payer").eqNullSafe(F.col("applicant")) & F.col("order_user").eqNullSafe(F.col("applicant"))
        & F.col("payment_merchant").eqNullSafe(F.col("merchant")) & (F.size("documents") == len(DOCUMENTS)) & F.col("evidence_sufficient")
    )
    return reasons(
        (F.array_min(amounts) < 0, "negative_amount"),
        (F.col("tax_amount") > F.col("invoice_amount"), "tax_above_amount"),
        (F.col("application_date") < F.col("payment_date"), "application_before_payment"),
        (F.col("invoice_date") < F.col("order_date"), "invoice_before_order"),
        (~F.col("case_id").rlike("^MV_[A-Z0-9_]+_[0-9]{6,}$"), "case_id"),
        ((F.size("documents") != F.size(F.array_distinct("documents"))) | (F.size("documents") == 0), "documents"),
        ((F.size("anomaly_types") == 0) & ~agree, "normal_case"),
    )


def money_errors(column: str) -> Column:
    """Why a text is no money value: not_text, not_number, negative, too_precise; null if it is one."""
    number = F.expr(f"try_cast({column} as decimal(30,8))")
    return (
        F.when(F.col(column).isNull(), "not_text").when(number.isNull(), "not_number").when(number < 0, "negative")
        .when(number != F.round(number, 2), "too_precise")
    )
