"""Claims made from orders, customers and suppliers; anomalies injected by quota; rules applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import draw, held, reasons
from ..operators.ranking import by_quota, global_rank, quota_table

#: The anomaly labels with their shares in hundredths, in their order.
SHARES = {
    "none": 30, "amount_mismatch": 12, "over_reimbursement": 8, "date_mismatch": 8, "merchant_mismatch": 8, "applicant_mismatch": 8,
    "order_id_mismatch": 8, "missing_document": 8, "duplicate_in_batch": 5, "unreadable_image": 5,
}
#: The documents of a claim, and the fields whose loss is a core loss.
DOCUMENTS = ["invoice", "payment", "reimbursement_form", "order"]
CORE_FIELDS = [
    "invoice_amount", "payment_amount", "reimbursement_amount", "order_amount", "invoice_merchant", "payment_merchant", "order_merchant",
    "applicant", "payer", "order_user", "order_id", "payment_id",
]
LABEL_SALT = 342
#: Orders that one task makes into claims, and the most tasks.
ORDERS_OF_TASK, MOST_TASKS = 20_000, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_id(key: Column) -> Column:
    return F.concat(F.lit("MV_ORD_"), F.lpad(key.cast("string"), 9, "0"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with case_id and the anomaly label that its hash rank falls to; orders are read alone, before any join."""
    orders = table(spark, sf_dir, "orders").withColumn("case_id", case_id(F.col("o_orderkey")))
    n = orders.count()
    ranked = global_rank(orders, "case_id", LABEL_SALT, name="label_rank", counted=orders.select("case_id"), rows=n)
    return by_quota(ranked, quota_table(spark.range(1).select(F.lit(n).cast("bigint").alias("n")), SHARES), "label_rank")


def base_claims(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One consistent claim for each order; columns that the orders have beside those of their table (label, label_rank and others) are kept."""
    own = table(spark, sf_dir, "orders")
    orders = own if orders is None else orders
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").join(
        F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")
    )
    n = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count("*").alias("_suppliers"), F.min("s_suppkey").alias("_first")))
    id_ = F.col("o_orderkey")
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // ORDERS_OF_TASK)))
    x = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").crossJoin(n)
        .withColumn("_supp", F.col("_first") + F.pmod(draw(id_, "supplier"), F.col("_suppliers")))
        .join(suppliers, F.col("_supp") == F.col("s_suppkey"), "left")
    )
    # A claim is short here and long work later, which the size of its shuffle does not tell: tasks are set by the number of orders.
    x = x.repartition(tasks, "o_orderkey")
    day = lambda d, tag, m: F.date_add(d, F.pmod(draw(id_, tag), F.lit(m)).cast("int"))
    x = x.withColumns({"order_date": F.to_date("o_orderdate"), "amount": (F.round(F.col("o_totalprice").cast("decimal(20,6)"), 2) * 100).cast("bigint")})
    x = x.withColumn("payment_date", day(F.col("order_date"), "payment", 4))
    x = x.withColumn("invoice_date", day(F.col("payment_date"), "invoice", 6))
    x = x.withColumn("application_date", day(F.col("invoice_date"), "application", 15))
    tail = F.concat(F.date_format("order_date", "yyyyMMdd"), F.lpad((id_ % 1_000_000).cast("string"), 6, "0"))
    return x.select(
        id_.alias("id"), case_id(id_).alias("case_id"), *(c for c in orders.columns if c not in (*own.columns, "case_id")),
        *(F.col("c_name").alias(c) for c in ("applicant", "payer", "order_user")),
        *(F.col("s_name").alias(c) for c in ("merchant", "invoice_merchant", "payment_merchant", "order_merchant")),
        F.array(F.concat(F.col("s_name"), F.lit(" "), F.col("n_name"))).alias("aliases"), F.col("o_orderpriority").alias("expense_type"),
        *(F.col("amount").alias(c) for c in ("invoice_amount", "payment_amount", "reimbursement_amount", "order_amount")),
        F.expr("(amount * 6 + 50) div 100").alias("tax_amount"), "order_date", "payment_date", "invoice_date", "application_date",
        *(F.concat(F.lit(p), tail).alias(c) for p, c in (("INV", "invoice_id"), ("ORD", "order_id"), ("PAY", "payment_id"))),
    )


def delta(amount: Column, small: Column) -> Column:
    """Cents by which an amount is off: 3 % within 1 to 80, or 12 % and at least 150."""
    return F.when(small, F.greatest(F.lit(100), F.least(F.lit(8000), F.expr("(invoice_amount * 3 + 50) div 100")))).otherwise(
        F.greatest(F.lit(15000), F.expr("(invoice_amount * 12 + 50) div 100"))
    )


def anomaly_types(label: str = "label") -> Column:
    """What a label says is wrong with a claim."""
    return F.when(F.col(label) == "none", F.array().cast("array<string>")).otherwise(F.array(label))


def injected(claims: DataFrame) -> DataFrame:
    """Labelled claims, changed as their label says; one projection."""
    u = lambda tag, n: F.pmod(draw("id", tag), F.lit(n)).cast("int")
    is_ = lambda label: F.col("label") == label
    change = lambda c, *cases: F.coalesce(*(F.when(cond, v) for cond, v in cases), F.col(c)).alias(c)
    dates, person, lost = is_("date_mismatch"), is_("applicant_mismatch"), is_("unreadable_image")
    core = u("core", 10) < 7
    pair = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in (("invoice_amount", "invoice_merchant"), ("payment_amount", "payment_merchant"), ("order_amount", "order_id"))))
    digit = F.substring("order_id", -1, 1).cast("int")
    shown = F.concat(F.expr("substring(order_id, 1, length(order_id) - 1)"), ((digit + 1 + u("digit", 8)) % 10).cast("string"))
    replaced = [
        change("order_amount", (is_("amount_mismatch"), F.col("invoice_amount") + delta(F.col("invoice_amount"), u("small", 100) < 45))),
        change("reimbursement_amount", (is_("over_reimbursement"), F.col("invoice_amount") + delta(F.col("invoice_amount"), u("small", 100) < 35))),
        change("application_date", (dates & (u("date", 3) == 0), F.date_sub("payment_date", 1 + u("days", 5)))),
        change("invoice_date", (dates & (u("date", 3) == 1), F.date_add("payment_date", 91 + u("days", 50))), (dates & (u("date", 3) == 2), F.date_sub("order_date", 31 + u("days", 40)))),
        change("payment_merchant", (is_("merchant_mismatch"), F.concat(F.lit("Outside Vendor "), F.lpad(u("vendor", 10000).cast("string"), 4, "0")))),
        change("payer", (person & (u("person", 2) == 0), F.lit("Other Person"))),
        change("order_user", (person & (u("person", 2) == 1), F.lit("Other Person"))),
    ]
    names = {c._jc.toString().rsplit(" AS ", 1)[-1] for c in replaced}
    docs = F.array(*map(F.lit, DOCUMENTS))
    return claims.select(
        *[c for c in claims.columns if c not in names], *replaced,
        F.when(is_("missing_document"), F.array_remove(docs, F.get(docs, u("document", 4)))).otherwise(docs).alias("documents"),
        anomaly_types().alias("anomaly_types"),
        (~(is_("missing_document") | (lost & core))).alias("evidence_sufficient"),
        F.when(lost & core, F.get(pair, u("pair", 3))).when(lost, F.array(F.lit("expense_type"))).otherwise(F.array().cast("array<string>")).alias("unreadable_fields"),
        F.when(is_("order_id_mismatch"), shown).otherwise(F.col("order_id")).alias("shown_order_id"),
        F.when(is_("duplicate_in_batch"), F.when(u("twin", 2) == 0, "invoice").otherwise("order")).alias("duplicate_document"),
    )


def risk_reasons() -> Column:
    """array<string> of level:code, from the rules, in their order."""
    has = lambda label: F.array_contains("anomaly_types", label)
    missing = F.array_except(F.array(*map(F.lit, DOCUMENTS)), F.col("documents"))
    amounts = F.array("invoice_amount", "payment_amount", "reimbursement_amount", "order_amount")
    spread = F.array_max(amounts) - F.array_min(amounts)
    least = F.greatest(F.coalesce(F.array_min(F.filter(amounts, lambda x: x > 0)), F.lit(100)), F.lit(100))
    paid = F.least("invoice_amount", "payment_amount")
    over = F.col("reimbursement_amount") - paid
    level = lambda d, base: F.when((d <= 10000) & (d * 100 <= base * 5), "medium").otherwise("high")
    is_over = has("over_reimbursement") | (over > 0)
    accepted = F.array_append("aliases", F.col("merchant"))
    merchants = [F.coalesce(F.array_contains(accepted, F.col(c)), F.lit(False)) for c in ("invoice_merchant", "payment_merchant", "order_merchant")]
    gap = F.abs(F.datediff("invoice_date", "payment_date"))
    core = F.arrays_overlap("unreadable_fields", F.array(*map(F.lit, CORE_FIELDS)))
    code = lambda lv, c: F.concat(lv, F.lit(f":{c}"))
    return reasons(
        (F.array_contains(missing, "order"), "medium:missing_order_document"),
        (F.arrays_overlap(missing, F.array(*map(F.lit, DOCUMENTS[:3]))), "high:missing_core_document"),
        (is_over, code(level(over, F.greatest(paid, F.lit(100))), "over_reimbursement")),
        (~is_over & (has("amount_mismatch") | (spread > 0)), code(level(spread, least), "amount_mismatch")),
        (has("date_mismatch") & (gap > 90), "medium:date_mismatch"),
        (has("date_mismatch") & (F.datediff("order_date", "invoice_date") > 30), "medium:date_mismatch"),
        (has("date_mismatch") & (F.col("application_date") < F.col("payment_date")), "high:date_mismatch"),
        (has("merchant_mismatch") | ~(merchants[0] & merchants[1] & merchants[2]), "high:merchant_mismatch"),
        (has("applicant_mismatch") | ~(F.col("applicant").eqNullSafe(F.col("payer")) & F.col("payer").eqNullSafe(F.col("order_user"))), "high:applicant_mismatch"),
        (has("order_id_mismatch"), "high:order_id_mismatch"),
        (has("duplicate_in_batch"), "high:duplicate_in_batch"),
        (has("unreadable_image"), F.when(core, "high:unreadable_image").otherwise("medium:unreadable_image")),
    )


def judged(claims: DataFrame) -> DataFrame:
    """claims with reasons, risk_level and audit_result."""
    complete = F.size(F.array_except(F.array(*map(F.lit, DOCUMENTS)), F.col("documents"))) == 0
    levels = F.transform("reasons", lambda x: F.substring_index(x, ":", 1))
    clean = (F.size("anomaly_types") == 0) & complete
    risk = F.when(clean | (F.size("reasons") == 0), "low").when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").otherwise("low")
    result = (
        F.when(~complete | F.array_contains("anomaly_types", "missing_document"), "missing_info")
        .when((F.col("risk_level") == "high") & F.col("evidence_sufficient"), "reject_recommendation")
        .when(F.col("risk_level").isin("high", "medium"), "manual_review").otherwise("pass")
    )
    return held(claims.withColumn("reasons", risk_reasons())).withColumn("risk_level", risk).withColumn("audit_result", result)


def claims(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Derived, labelled, injected and judged claims; with only (case_id), those alone are derived, with the labels that they have among all.

    orders are labelled orders as labels() gives them, some or all, with more columns, which the claims keep: what is joined to orders is
    short, what is joined to answers is not.
    """
    orders = labels(spark, sf_dir) if orders is None else orders
    if only is not None:
        orders = orders.join(only.select("case_id"), "case_id", "left_semi")
    return held(judged(held(injected(base_claims(spark, sf_dir, orders)))))
