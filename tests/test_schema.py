"""The schema compiler against the walker of the contract and a plain checker, on values that are changed at random."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from claimlens.functions import contract, schema
from claimlens.operators import validation
from claimlens.plans import claims as C
from claimlens.plans import outputs as O

SF = "/root/testdata/sf0.001"
VALUES = [None, "", "x", 5, 5.0, 5.5, -1, 2000, True, [], ["x", "x"], {}, {"a": 1}, "low", [1, 2, 3, 4], 10**20, "10.00", "2024-01-01", ["invoice"], "MV_A_000001"]


def places(v, at=()):
    """Every container and key of a value."""
    if isinstance(v, dict):
        for k, x in v.items():
            yield v, k
            yield from places(x, (*at, k))
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield v, k
            yield from places(x, (*at, k))


def changed(value, rng):
    out = copy.deepcopy(value)
    for _ in range(rng.randint(1, 3)):
        where, key = rng.choice(list(places(out)))
        kind = rng.random()
        if kind < 0.6:
            where[key] = copy.deepcopy(rng.choice(VALUES))
        elif kind < 0.8:
            del where[key]
        elif isinstance(where, dict):
            where[rng.choice(["note", "primary_anomaly_type", "b"])] = 1
        else:
            where.append(copy.deepcopy(where[key]))
        if not list(places(out)):
            break
    return out


def judged(spark, document, values):
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", schema.errors(document)(F.try_parse_json("t")).alias("e"))
    return [r.e for r in sorted(df.collect(), key=lambda r: r.k)]


def test_contract_equals_its_walker(spark):
    rng = random.Random(5)
    good = [json.loads(r[0]) for r in O.answers(C.claims(spark, SF)).limit(20).select(O.answer_json(F.col("answer"))).collect()]
    values = good + [changed(rng.choice(good), rng) for _ in range(400)] + [None, 5, "x", [], {}]
    for value, got in zip(values, judged(spark, contract.output_schema(), values), strict=True):
        want = contract.violations(value)
        assert sorted(got) == sorted(want), value
        assert [e.split(": ")[0] for e in got] == [e.split(": ")[0] for e in want]
    assert not any(judged(spark, contract.output_schema(), good))


def test_case_schema_and_rules(spark):
    people = dict.fromkeys(validation.PEOPLE, "A")
    case = {
        "case_id": "MV_A_000001", **people, "merchant_aliases": ["a", "b"], **dict.fromkeys(validation.AMOUNTS, "10.00"), "order_date": "2024-01-01", "payment_date": "2024-01-02", "invoice_date": "2024-01-03", "application_date": "2024-01-04",
        "invoice_id": "INV20240101000001", "order_id": "ORD20240101000001", "payment_id": "PAY20240101000001", "documents": ["invoice", "order"], "primary_anomaly_type": "none", "anomaly_types": [], "evidence_sufficient": True,
        "risk_level": "low", "audit_result": "pass", "metadata": {"split_name": "s", "source": "s", "template_group": "val", "seed": 1, "free": [1]},
    }
    wrong = [
        ({}, []), ({"case_id": "MV_1"}, ["case_id: not like ^MV_[A-Za-z0-9]+_[0-9]{6,}$"]), ({"payer": ""}, ["payer: empty"]), ({"tax_amount": "1.5"}, [r"tax_amount: not like ^[0-9]+\.[0-9]{2}$"]),
        ({"documents": ["order", "order"]}, ["documents: repeated items"]), ({"documents": []}, ["documents: not 1 to 4 items"]), ({"documents": ["order", "x"]}, ["documents.1: not one of invoice, payment, reimbursement_form, order"]),
        ({"metadata": {"seed": 1.5}}, ["metadata: lacks split_name", "metadata: lacks source", "metadata: lacks template_group", "metadata.seed: not an integer"]), ({"b": 1, "a": 2}, ["<root>: has a", "<root>: has b"]),
        ({"order_date": "2024-13-01"}, ["order_date: no date"]), ({"order_amount": "11.00"}, ["<root>: amounts of a normal case differ"]), ({"payer": "B"}, ["<root>: persons of a normal case differ"]),
        ({"payment_date": "2023-01-01"}, ["<root>: dates of a normal case are out of order"]), ({"risk_level": "high"}, ["<root>: a normal case is not low and passed"]), ({"evidence_sufficient": False}, ["<root>: a normal case lacks evidence"]),
        ({"evidence_sufficient": "true"}, ["evidence_sufficient: not a boolean"]), ({"primary_anomaly_type": "date_mismatch", "risk_level": "high", "payer": "B"}, []),
    ]
    rows = [(k, json.dumps(case | c)) for k, (c, _) in enumerate(wrong)] + [(100, "{"), (101, None), (102, json.dumps({k: v for k, v in case.items() if k != "payer"}))]
    df = spark.createDataFrame(rows, "k int, t string").select("k", validation.case_errors("t").alias("e"))
    got = {r.k: r.e for r in df.collect()}
    assert [got[k] for k in range(len(wrong))] == [w for _, w in wrong]
    assert got[100] == got[101] == ["<root>: no JSON"] and got[102] == ["<root>: lacks payer"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_keywords(spark):
    document = {"anyOf": [{"type": "string", "maxLength": 3}, {"type": "number", "minimum": 2}], "not": {"enum": ["no"]}}
    values = ["abc", "abcd", 1, 2, "no", None]
    none, out = ["<root>: none of 2 forms"], ["<root>: of a form that is ruled out"]
    assert judged(spark, document, values) == [[], none, none, [], out, none]
    assert judged(spark, {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/x"}, "$defs": {"x": {"minLength": 2}}}, [["ab"], ["a", "bc"], "x"]) == [["<root>: fewer than 2 items"], ["0: shorter than 2"], ["<root>: not a list"]]
    with pytest.raises(ValueError, match="unknown keywords"):
        schema.errors({"oneOf": []})(F.col("v"))
