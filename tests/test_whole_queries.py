"""Queries that make only what they need, against the operators that make everything."""

from pyspark.sql import functions as F

from claimlens import entry  # noqa: F401  (registers the queries, in its order)
from claimlens import queries_pairs as Q
from claimlens.operators import pairs, validation
from claimlens.plans import claims as C
from claimlens.plans import outputs as O

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty() and not a.isEmpty()


def test_a_case_is_parsed_once(spark):
    assert str(validation.case_errors("t")).count("parse_json") == 1


def test_keys_of_pairs_are_those_of_their_candidates(spark):
    c = C.claims(spark, SF)
    keys = pairs.pair_keys(c).select("pair_id", "pair_type", "label", "case_id", "rejected_error_type", "final_weight", "sft_loss_weight")
    assert same(keys, pairs.pair_candidates(c, O.answers(c)))


def test_cells_within_the_row_are_those_of_records(spark):
    c = C.claims(spark, SF)
    assert same(O.extracted_cells(c), O.field_extraction(c, O.annotations(c)))


def test_images_are_those_of_answers(spark):
    c = C.claims(spark, SF)
    assert same(Q._records(c), O.answers(c).select("case_id", F.posexplode("images").alias("place", "i")).select("case_id", "place", "i.*"))


def test_claims_of_some_cases_are_the_same_as_among_all(spark):
    c = C.claims(spark, SF)
    some = c.select("case_id").where("crc32(case_id) % 7 = 0")
    assert same(C.claims(spark, SF, some), c.join(some, "case_id", "left_semi"))
