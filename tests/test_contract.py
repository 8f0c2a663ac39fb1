"""The contract, its guard and verifier, on texts; perfect answers and each fault through raw scoring."""

import copy
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from claimlens.functions import contract
from claimlens.functions.tolerant_json import find_object
from claimlens.operators import rewards, scoring
from claimlens.plans import claims as C
from claimlens.plans import outputs as O
from claimlens.plans import predictions as P

SF = "/root/testdata/sf0.001"


def item(document="order", field="order_id", value="ORD1", **more):
    return {"source_image_id": "i1", "source_doc_type": document, "field": field, "value": value, "bbox": [1, 2, 3, 4], "evidence_text": ""} | more


def answer(**more):
    base = {
        "case_id": "c1", "field_extraction": dict.fromkeys(O.FIELDS, "1"), "consistency_check": dict.fromkeys(O.CHECKS, True), "anomaly_types": [], "risk_level": "low", "audit_result": "pass",
        "reason": "ok", "evidence": [item()], "uncertainty": {"has_uncertain_fields": False, "uncertain_fields": [], "requires_manual_review": False},
    }
    return base | more


BREACHES = [
    ({"risk_level": "huge"}, "risk_level: not one of low, medium, high"), ({"anomaly_types": ["amount_mismatch"] * 2}, "anomaly_types: repeated items"), ({"reason": ""}, "reason: empty"), ({"evidence": [item(bbox=[1, 2, 3])]}, "evidence.0.bbox: not 4 items"),
    ({"evidence": [item(bbox=[1, 2, 3, True])]}, "evidence.0.bbox.3: not an integer"), ({"evidence": [item(bbox=[1, 2, 3, 1001])]}, "evidence.0.bbox.3: not within 0 to 1000"), ({"primary_anomaly_type": "none"}, "<root>: has primary_anomaly_type"),
    ({"consistency_check": dict.fromkeys(O.CHECKS, 1)}, "consistency_check.amount_consistent: not a boolean"), ({"uncertainty": {}}, "uncertainty: lacks has_uncertain_fields"),
]


@pytest.mark.parametrize("change, error", BREACHES)
def test_breaches(change, error):
    assert contract.violations(answer(**change))[0] == error


def test_whole_answers_and_whole_floats_are_valid():
    assert contract.violations(answer()) == [] and contract.violations(answer(evidence=[item(bbox=[1.0, 2, 3, 4])])) == []
    assert contract.violations([]) == ["<root>: not an object"]


def test_guard_moves_flattened_fields_back():
    flat = answer()
    fields = flat.pop("field_extraction")
    text, notes = contract.guarded(json.dumps(flat | fields | {"extra": 1}))
    assert json.loads(text) == answer() and notes["schema_valid_after"] and notes["changed"] and not notes["schema_valid_before"]
    assert sorted(notes["moved_keys"]) == sorted(O.FIELDS) and notes["dropped_keys"] == ["extra"]


def test_guard_returns_what_it_cannot_repair():
    for text in ('{"case_id": "c1", "invoice_amount": "1"}', "no json", "", '{"case_id": "c", "risk_level": "huge", "audit_result": "pass"}'):
        got, notes = contract.guarded(text)
        assert got == text and not notes["changed"] and not notes["schema_valid_after"]


def test_guard_recovers_a_text_that_is_cut_short():
    text = json.dumps(answer())
    text = text[: text.index('"bbox"')]
    got, notes = contract.guarded(text)
    assert notes["partial_reconstruction"] and notes["schema_valid_after"] and json.loads(got)["field_extraction"] == answer()["field_extraction"] and json.loads(got)["evidence"] == []


def test_guard_brings_values_to_their_types():
    odd = answer(evidence=["x", item(value=5, bbox=[1.5, 2.5, "7", None, 9], odd=1, source_doc_type="?")], anomaly_types=["amount_mismatch", "what", "amount_mismatch"], uncertainty={"has_uncertain_fields": "no", "uncertain_fields": [1]})
    odd["consistency_check"] = {"amount_consistent": "yes", "odd": 1}
    got = json.loads(contract.guarded(json.dumps(odd))[0])
    assert got["evidence"][1] == item(document="invoice", value="5", bbox=[2, 2, 7, 0]) and got["evidence"][0]["source_image_id"] == "unknown" and got["anomaly_types"] == ["amount_mismatch"]
    assert got["consistency_check"]["amount_consistent"] is True and got["consistency_check"]["date_reasonable"] is False
    assert got["uncertainty"] == {"has_uncertain_fields": False, "uncertain_fields": ["1"], "requires_manual_review": False}


@pytest.mark.parametrize("evidence, changed", [
    ([item(value="ORD1"), item("reimbursement_form", value="ORD2")], True), ([item(value="订单号:ord1"), item("reimbursement_form", value="ORD1")], False), ([item()], False), ([], False),
    ([item(value=""), item(value="", evidence_text="ORD1"), item("reimbursement_form", value="ord 2")], True),
])
def test_only_two_different_order_ids_make_a_decision(spark, evidence, changed):
    given = answer(evidence=evidence)
    got, notes = contract.guarded(json.dumps(given, ensure_ascii=False))
    assert notes["verifier_changed"] is changed and (json.loads(got) == given) is not changed
    out = json.loads(got)
    if changed:
        assert (out["risk_level"], out["audit_result"], out["anomaly_types"], out["consistency_check"]["order_id_consistent"]) == ("high", "reject_recommendation", ["order_id_mismatch"], False)
    kind = O.answers(C.claims(spark, SF)).schema["answer"].dataType.simpleString()
    row = spark.range(1).select(F.from_json(F.lit(json.dumps(given, ensure_ascii=False)), kind).alias("answer"))
    r = contract.verify_order_ids(row).first()
    assert r.changed is changed and json.loads(json.dumps(r.answer.asDict(True))) == out


def test_order_id_words():
    assert contract.order_id("订单号:ORD12-a") == "ORD12-A" and contract.order_id("订单号ORD12") == "订单号ORD12" and contract.order_id(" a b ") == "AB" and contract.order_id("  ") is None and contract.order_id(None) is None


def test_deep_and_long_texts_do_not_fail():
    for text, want in (('{"a":' * 100_000, None), ("{x" * 200_000, None), ('{"a":' * 50_000 + '{"b":1}', {"b": 1}), ('{"a":"' + "{" * 1000, None), ('{"a":[' * 50 + '{"b":{"c":1}}, {"d"', {"b": {"c": 1}})):
        began = time.time()
        assert find_object(text) == want and time.time() - began < 5
        contract.guarded(text)


def test_scanner_agrees_with_the_decoder():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(['{"a":', "{", "}", "[1,", "]", '"b":2', ",", " ", '"', "nul", "1"]) for _ in range(rng.randrange(1, 60)))
        want = next((v for k in range(len(text)) if text[k] == "{" for v in [decoded(text, k)] if isinstance(v, dict)), None)
        import claimlens.functions.tolerant_json as T

        patience, T.PATIENCE = T.PATIENCE, 0
        try:
            assert find_object("x" + text) == want
        finally:
            T.PATIENCE = patience


def decoded(text, k):
    try:
        return json.JSONDecoder().raw_decode(text, k)[0]
    except ValueError:
        return None


@pytest.fixture(scope="module")
def made(spark):
    return P.predictions(O.answers(C.claims(spark, SF)), ["m"]).persist()


def test_perfect_answers_score_one_and_faults_raise_their_issue(spark, made):
    s = scoring.score(made, "mode").persist()
    m = scoring.metrics(s.where(F.col("mode").isin(P.RIGHT)), "model").first()
    assert all(v == (0 if "miss" in k or "false" in k or "halluc" in k else 1) for k, v in m.asDict().items() if isinstance(v, float)) and m.error_cases == 0
    issue = {
        "json_invalid": "json_invalid", "schema_invalid": "schema_invalid", "high_risk_pass": "high_risk_miss", "false_manual_review": "audit_mismatch", "wrong_evidence_source": "hallucination", "wrong_bbox": "bbox_strict_error",
        "unsupported_conclusion": "unsupported_conclusion", "hallucinated_field": "hallucination", "missing_doc_fake_bbox": "hallucination",
    }
    seen = {r["mode"]: r["n"] for r in s.where(F.coalesce(*(F.when(F.col("mode") == k, F.array_contains("issues", v)) for k, v in issue.items()), F.lit(False))).groupBy("mode").agg(F.count("*").alias("n")).collect()}
    assert seen == {r["mode"]: r["n"] for r in made.where(F.col("mode").isin(list(issue))).groupBy("mode").agg(F.count("*").alias("n")).collect()} and set(seen) == set(issue)


def test_raw_texts_score_as_their_structs(spark, made):
    raw = made.select("case_id", "model", "answer", "images", P.raw_output().alias("raw_output"))
    parsed = contract.parsed(raw, made.schema["answer"].dataType.simpleString())
    assert scoring.metrics(scoring.score(parsed), "model").collect() == scoring.metrics(scoring.score(made), "model").collect()
    assert made.where("schema_valid").select(contract.answer_valid(F.col("pred")).alias("ok")).where("not ok").count() == 0


def test_the_last_prediction_counts(spark):
    truth = spark.createDataFrame([("a",), ("b",)], "case_id string")
    preds = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("z", "x", 1)], "case_id string, raw_output string, place int")
    assert {tuple(r) for r in scoring.last_prediction(truth, preds, ["case_id"], "place").collect()} == {("a", "new"), ("b", None)}


def reward_of(spark, made, truth, pred, json_valid=True, schema_valid=True):
    kind = made.schema["answer"].dataType.simpleString()
    images = "array<struct<image_id:string,doc_type:string,image_path:string>>"
    row = spark.range(1).select(
        F.lit("c").alias("case_id"), F.lit("m").alias("model"), F.from_json(F.lit(json.dumps(truth)), kind).alias("answer"), F.from_json(F.lit(json.dumps(pred)), kind).alias("pred"),
        F.array(F.struct(F.lit("i1").alias("image_id"), F.lit("order").alias("doc_type"), F.lit("").alias("image_path")), F.struct(F.lit("i2").alias("image_id"), F.lit("reimbursement_form").alias("doc_type"), F.lit("").alias("image_path"))).cast(images).alias("images"),
        F.lit(json_valid).alias("json_valid"), F.lit(schema_valid).alias("schema_valid"))
    return rewards.reward(row).first()


def test_reward_floors_and_sums(spark, made):
    two = [item(value="ORD1"), item("reimbursement_form", value="ORD2", source_image_id="i2")]
    high = answer(risk_level="high", audit_result="reject_recommendation", anomaly_types=["order_id_mismatch"], evidence=two)
    assert reward_of(spark, made, high, high).reward == 1.0
    bad = reward_of(spark, made, high, high, False, False)
    assert (bad.reward, bad.r_json) == (-1.0, 0.0)
    bad = reward_of(spark, made, high, high, True, False)
    assert (bad.reward, bad.r_json) == (-1.0, 1.0)
    passed = reward_of(spark, made, high, high | {"audit_result": "pass"})
    assert (passed.reward, passed.p_high_risk_miss, passed.r_field) == (-1.0, 1.0, 0.0)
    lone = reward_of(spark, made, high, high | {"evidence": two[:1]})
    assert lone.reward <= 0 and lone.p_missing_order_id_pair == 1 and lone.r_order_id_pair == 0
    low = answer()
    over = reward_of(spark, made, low, low | {"risk_level": "high"})
    assert over.p_false_escalation == 1 and abs(over.reward - (0.15 + 0.15 + 0.2 + 0 + 0.15 + 0.1 + 0.1 - 0.4)) < 1e-9
    missing = answer(anomaly_types=["missing_document"], risk_level="medium", audit_result="missing_info")
    assert reward_of(spark, made, missing, copy.deepcopy(missing) | {"audit_result": "pass"}).reward == -1.0


def test_rewards_within_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", -1.0), ("b", 0.5), ("b", 0.5), (None, 3.0)], "g string, reward double")
    got = rewards.normalised(df, ["g"]).collect()
    assert abs(sum(r.advantage for r in got if r.g == "a")) < 1e-9 and [r.advantage for r in got if r.g != "a"] == [0.0, 0.0, 0.0]
