"""Raw texts are read once, and scores or digests are sent instead of them."""

from pyspark.sql import functions as F

from claimlens import entry  # noqa: F401  (registers the queries, in its order)
from claimlens import queries_eval as E
from claimlens.functions import contract
from claimlens.operators import comparison, scoring

SF = "/root/testdata/sf0.001"


def test_the_last_prediction_is_taken_after_scoring(spark):
    rows = spark.createDataFrame([("a", "m", 0, 1, ["x"]), ("a", "m", 1, 2, []), ("b", "m", None, 3, None), ("a", "n", 5, 4, ["y"])], "case_id string, model string, place int, v int, issues array<string>")
    out = scoring.last_scored(rows, ["case_id", "model"], "place")
    assert {tuple(r) for r in out.select("case_id", "model", "v").collect()} == {("a", "m", 2), ("b", "m", 3), ("a", "n", 4)}
    plan = E.raw_evaluation(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(k for k, x in enumerate(plan) if "evidence_text" in x) < min(k for k, x in enumerate(plan) if "Join " in x)


TEXTS = ['{"b":1,"a":{"x":null},"audit_result":"pass"}', '```json\n{"audit_result":"pass","a":{"x":null},"b":1}\n```', "words", "{}", "", None, '{"risk":{"type":"low"},"decision":"é","n":1.50}', '{"decision":7,"parsed":{"decision":"no"},"risk_level":["a"]}']


def test_digests_and_heads_are_those_of_canonical_texts(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    c, told = contract.canonical("t"), contract.told(F.col("t"), comparison.HEADS)
    out = rows.select(F.sha2(c, 256).alias("d"), told.digest.alias("e"), *(comparison.at_paths(x, p).alias(f"{n}{i}") for i, p in enumerate((comparison.DECISION_PATHS, comparison.RISK_PATHS)) for n, x in (("c", c), ("t", told.heads))))
    for r in out.collect():
        assert r["d"] == r["e"] and r["c0"] == r["t0"] and r["c1"] == r["t1"]


def test_models_of_one_table_compare_as_two_tables_do(spark):
    rows = spark.createDataFrame([(f"c{k % 9}", m, t) for m, by in (("base", 1), ("cand", 2)) for k, t in enumerate(TEXTS) if k % 5 != by], "case_id string, model string, t string").dropDuplicates(["case_id", "model"])
    side = lambda m: rows.where(F.col("model") == m).select("case_id", contract.canonical("t").alias("answer"))
    got = comparison.paired_models(rows.select("case_id", "model", contract.told(F.col("t"), comparison.HEADS).alias("told")), "base", "cand")
    assert got.first() == comparison.paired(side("base"), side("cand")).first()
    made = E.paired_diff(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("ArrowEvalPython") == 1
