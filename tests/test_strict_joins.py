import pytest

from claimlens.operators import strict_joins


def test_absent_keys_are_errors_that_name_them(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    errors = df([("a", 1), ("b", 2), ("a", 3)], "case_id string, n int")
    truth = df([("a", "x"), ("b", "y"), ("c", "z")], "case_id string, risk string")
    got = strict_joins.with_all(errors, {"truth": truth, "pred": truth.where("case_id <> 'c'")}, "case_id").collect()
    assert sorted((r.case_id, r.n, r.truth.risk, r.pred.risk) for r in got) == [("a", 1, "x", "x"), ("a", 3, "x", "x"), ("b", 2, "y", "y")]
    with pytest.raises(Exception, match="pred lacks case_id b"):
        strict_joins.with_all(errors, {"truth": truth, "pred": truth.where("case_id <> 'b'")}, "case_id").collect()
    with pytest.raises(Exception, match="truth lacks case_id null"):
        strict_joins.with_all(df([(None, 1)], "case_id string, n int"), {"truth": truth}, "case_id").collect()
    assert strict_joins.with_all(errors.limit(0), {"truth": truth.limit(0)}, "case_id").count() == 0


def test_manifest_order(spark):
    cases = spark.createDataFrame([(f"c{k}", k * k, "s") for k in range(20)], "case_id string, v int, split string")
    manifest = spark.createDataFrame([(2, "t", "c7"), (0, "t", "c9"), (1, "t", "c0"), (0, "s", "c3")], "sample_index int, split string, case_id string")
    got = [tuple(r) for r in strict_joins.in_manifest_order(manifest, cases, "case_id", by=["split"]).collect()]
    assert got == [(0, "s", "c3", 9), (0, "t", "c9", 81), (1, "t", "c0", 0), (2, "t", "c7", 49)]
    with pytest.raises(Exception, match="lacks case_id c7"):
        strict_joins.in_manifest_order(manifest, cases.where("case_id <> 'c7'"), "case_id").collect()
