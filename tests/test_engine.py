import json
import math

import pytest
from pyspark.sql import functions as F

from claimlens.functions import exprs
from claimlens.functions.tolerant_json import extract_json, find_object
from claimlens.operators import audits, gates, ranking, scoring
from claimlens.plans import claims as C
from claimlens.sources import jsonl
from claimlens.streaming import progress


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    r = one(spark, exprs.iou(box(0, 0, 10, 10), box(0, 0, 10, 20)), exprs.iou(box(5, 5, 5, 5), box(5, 5, 5, 5)), exprs.relaxed_match(box(5, 5, 5, 5), box(0, 0, 10, 10)), exprs.strict_match(F.lit(None).cast("array<int>"), box(0, 0, 1, 1)))
    assert tuple(r) == (0.5, 0.0, True, False)
    assert one(spark, exprs.scaled_box(F.lit(2.5), 1000), exprs.scaled_box(F.lit(-3), 10), exprs.scaled_box(F.lit(50), 10))[:] == (2, 0, 1000)


def test_sets_rates_and_money(spark):
    a, none = F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>")
    r = one(spark, exprs.jaccard(none, none), exprs.jaccard(a, none), exprs.jaccard(a, F.array(F.lit("y"), F.lit("z"))), exprs.same_set(a, F.array(F.lit("y"), F.lit("x"))), exprs.rate(F.lit(1), F.lit(0)), exprs.cents(F.lit("1.005")), exprs.money_text(F.lit(12345)))
    assert tuple(r)[:2] == (1.0, 0.0) and math.isclose(r[2], 1 / 3) and tuple(r)[3:] == (True, 0.0, 101, "123.45")


@pytest.mark.parametrize("x", [-1.0, 0.0, 2.0, -20000.0])
def test_losses(spark, x):
    r = one(spark, exprs.dpo_loss(F.lit(x), 0.1), exprs.ipo_loss(F.lit(x), 0.1))
    assert math.isclose(r[0], math.log1p(math.exp(-0.1 * x)) if x > -7000 else 2000.0)
    assert math.isclose(r[1], (x - 5) ** 2)


def test_json(spark):
    assert find_object('{"a": 1}') == {"a": 1} and find_object("x {bad {\"a\": {\"b\": 2}} y") == {"a": {"b": 2}}
    assert find_object('```json\n{"a": 1}\n```') == {"a": 1} and find_object('{"a": {"b": 1}') == {"b": 1}
    assert find_object("{'a': 1}") is None and find_object(None) is None and find_object("[1]") is None
    df = spark.createDataFrame([('{"b":1,"a":2} tail',), (None,), ("no",)], "t string")
    assert [r[0] for r in df.select(extract_json("t")).collect()] == ['{"a":2,"b":1}', None, None]


def claim(**change):
    base = dict(
        invoice_amount=10000, payment_amount=10000, reimbursement_amount=10000, order_amount=10000, order_date="2026-01-01", payment_date="2026-01-02", invoice_date="2026-01-03", application_date="2026-01-04",
        applicant="p", payer="p", order_user="p", merchant="m", invoice_merchant="m", payment_merchant="m", order_merchant="m", aliases=["m2"], documents=list(C.DOCUMENTS), anomaly_types=[], evidence_sufficient=True, unreadable_fields=[],
    )
    return base | change


CASES = [
    ({}, "low", "pass"),
    (dict(order_amount=10500, anomaly_types=["amount_mismatch"]), "medium", "manual_review"),
    (dict(order_amount=10501, anomaly_types=["amount_mismatch"]), "high", "reject_recommendation"),
    (dict(order_amount=99999), "low", "pass"),
    (dict(reimbursement_amount=10500, anomaly_types=["over_reimbursement"]), "medium", "manual_review"),
    (dict(documents=["invoice", "payment", "reimbursement_form"], anomaly_types=["missing_document"], evidence_sufficient=False), "medium", "missing_info"),
    (dict(documents=["invoice", "payment", "order"], anomaly_types=["missing_document"], evidence_sufficient=False), "high", "missing_info"),
    (dict(application_date="2026-01-01", anomaly_types=["date_mismatch"]), "high", "reject_recommendation"),
    (dict(invoice_date="2026-04-03", anomaly_types=["date_mismatch"]), "medium", "manual_review"),
    (dict(anomaly_types=["date_mismatch"]), "low", "pass"),
    (dict(payment_merchant="m2", anomaly_types=["order_id_mismatch"]), "high", "reject_recommendation"),
    (dict(anomaly_types=["unreadable_image"], unreadable_fields=["expense_type"]), "medium", "manual_review"),
    (dict(anomaly_types=["unreadable_image"], unreadable_fields=["order_id"], evidence_sufficient=False), "high", "manual_review"),
]


def test_risk_rules(spark):
    schema = (
        "invoice_amount long, payment_amount long, reimbursement_amount long, order_amount long, order_date string, payment_date string, invoice_date string, application_date string, applicant string, payer string, order_user string, "
        "merchant string, invoice_merchant string, payment_merchant string, order_merchant string, aliases array<string>, documents array<string>, anomaly_types array<string>, evidence_sufficient boolean, unreadable_fields array<string>, n int"
    )
    rows = spark.createDataFrame([tuple(claim(**c).values()) + (k,) for k, (c, *_) in enumerate(CASES)], schema)
    for d in ("order_date", "payment_date", "invoice_date", "application_date"):
        rows = rows.withColumn(d, F.to_date(d))
    got = {r.n: (r.risk_level, r.audit_result) for r in C.judged(rows).collect()}
    assert got == {k: (risk, result) for k, (_, risk, result) in enumerate(CASES)}


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    ranks = [{r.id: r["rank"] for r in ranking.global_rank(df.repartition(n), "id", 9, by).collect()} for n in (1, 7) for by in ([], ["g"])]
    assert ranks[0] == ranks[2] and ranks[1] == ranks[3] and sorted(ranks[0].values()) == list(range(1, 501))
    q = ranking.quota_table(df.agg(F.count("*").alias("n")), C.SHARES)
    assert {r.label: r.quota for r in q.collect()} == ranking.largest_remainder(500, C.SHARES)
    assert ranking.stratified(df, "id", ["g"], 50, 1).count() == 50


def test_macro_f1_counts_absent_labels(spark):
    df = spark.createDataFrame([("low", "low"), ("high", None), ("high", "high"), ("low", "high")], "t string, p string")
    assert math.isclose(df.agg(scoring.macro_f1("t", "p", scoring.RISKS)).first()[0], (2 / 3 + 0 + 0.5) / 3)


def test_gate_needs_the_drop_in_misses(spark):
    m = dict(json_validity=1.0, schema_compliance=0.9, audit_accuracy=0.8, evidence_support_rate=0.9)
    for cand, ok in ((0.27, True), (0.28, False)):
        text = json.dumps({"base": m | {"high_risk_miss_rate": 0.3}, "cand": m | {"high_risk_miss_rate": cand}})
        fields = ", ".join(f"{k}: double" for k in [*m, "high_risk_miss_rate"])
        pair = spark.range(1).select(F.from_json(F.lit(text), f"base struct<{fields}>, cand struct<{fields}>").alias("x")).select("x.*")
        got = {r.check: r.passed for r in gates.repair_gate(pair, gates.MAIN, "main").collect()}
        assert got["high_risk_miss_improvement"] is ok and got["all"] is ok


def test_ancestry_of_long_chains_and_loops(spark):
    rows = [(f"m{k}", f"m{k - 1}" if k else None) for k in range(300)] + [("a", "b"), ("b", "a"), ("x", "gone")]
    got = {r.model_id: r.depth for r in audits.ancestry(spark.createDataFrame(rows, "model_id string, parent_model_id string")).collect()}
    assert got == {f"m{k}": k for k in range(300)} | {"x": 0}


def test_best_checkpoint(spark):
    s = spark.createDataFrame([(5, False, 0.3, 0.1), (10, True, 0.1, 0.0), (15, True, 0.9, 0.9)], "step int, eligible boolean, reward_gain double, order_gain double")
    assert gates.best_checkpoint(s).first().step == 10 and gates.best_checkpoint(s.where("not eligible")).first().step == 5


def test_audits(spark):
    e, g = spark.range(5).toDF("k"), spark.createDataFrame([(0,), (1,), (1,), (9,)], "k long")
    assert audits.merge_audit(e, g, "k").first()[:] == (3, 1, 1, 4)
    assert sorted(r.k for r in audits.pending(e, g, "k").collect()) == [2, 3, 4]


def test_jsonl(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    assert jsonl.read_if_there(spark, path, "a int, b string").count() == 0
    jsonl.write(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert [tuple(r) for r in jsonl.read(spark, path, "a int, b string").collect()] == [(1, None)]
    assert spark.range(1).select(F.lit(None).cast("string").alias("x")).select(jsonl.encoded("x")).first()[0] == '{"x":null}'


def test_streams_agree_with_batches_on_closed_windows(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 10} 0{k % 10}:00:00", k % 2, "a", float(k)) for k in range(40)]
    events = spark.createDataFrame(rows + rows[:3], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    path = f"file://{tmp_path}/events"
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = progress.throughput(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {tuple(r) for r in progress.throughput(events).collect()}
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert got and got <= want
    assert progress.first_per_key(events).count() == 40
