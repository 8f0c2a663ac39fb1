"""Answers stay in their row: what is joined or grouped is short."""

from pyspark.sql import functions as F

from claimlens import entry  # noqa: F401  (registers the queries, in its order)
from claimlens import queries_pairs as Q
from claimlens.operators import pairs
from claimlens.plans import claims as C
from claimlens.plans import outputs as O

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty() and not a.isEmpty()


def joined_before_answers(df):
    """Whether all joins of a plan stand below all answers; a plan is written from its root."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins, made = ([k for k, x in enumerate(lines) if word in x] for word in ("Join ", "evidence_text"))
    return bool(made) and bool(joins) and max(made) < min(joins)


def test_pairs_of_answers_in_the_row_are_those_of_joined_ones(spark):
    c = C.claims(spark, SF)
    rows = pairs.answered_candidates(O.answers(c, *pairs.PAIR_FACTS[2:]))
    columns = [x for x in pairs.pair_candidates(c, O.answers(c)).columns if x in rows.columns]
    assert same(rows.select(*columns), pairs.pair_candidates(c, O.answers(c)).select(*columns))
    assert joined_before_answers(Q.dpo_pairs_v2(spark, SF))


def test_kinds_are_joined_to_orders_not_to_answers(spark):
    assert same(Q._kinds(C.labels(spark, SF)), Q._kinds(C.claims(spark, SF).select("case_id", "label")))
    assert joined_before_answers(Q.dpo_pairs_v1(spark, SF))


def test_claims_without_pairs_are_left_out_before_their_answers(spark):
    all_of, some = Q.completions(spark, SF), Q.completions(spark, SF, mined_only=True)
    assert same(some.select("case_id", "model", "mode"), all_of.where(pairs.mining_bucket(F.col("answer")).isin(*pairs.MINED_BUCKETS)).select("case_id", "model", "mode"))
    assert 0 < some.count() < all_of.count()
