import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.functions import exprs
from claimlens.operators import comparison, evidence, resampling, scoring
from claimlens.plans import claims as C
from claimlens.plans import outputs as O
from claimlens.plans import predictions as P

def by_hand(true, pred, images, unsure, strict, relaxed):
    word = lambda v: "None" if v is None else v
    key = lambda x, k: tuple(word(v) for v in k(x[:4]))
    whole, said, sourced = lambda v: v, lambda v: v[2:], lambda v: v[:3]
    again = lambda k: sum(key(t, k) in [key(p, k) for p in pred] for t in true)
    first = [next((p[4] for p in pred if key(p, whole) == key(t, whole)), None) for t in true]
    wrong = sum(
        key(p, whole) not in [key(t, whole) for t in true] or (images is not None and (word(p[0]), word(p[1])) not in [i for i in images if None not in i]) or word(p[2]) in unsure for p in pred
    )
    return (again(whole), again(said), again(sourced), *(sum(match(b, t[4]) for b, t in zip(first, true, strict=True)) for match in (strict, relaxed)), wrong)


def test_batches_count_as_rows_do(spark):
    r = random.Random(7)
    texts = lambda: r.choice(["a", "b", "None", None])
    boxes = [None, [], [0, 0, 10, 10], [0, 0, 10, 20], [0, 0, 10, 3], [5, 5, 5, 5], [3, 3, None, 9], [2, 2, 8], [900, 1, 990, 7]]
    items = lambda: [(texts(), texts(), texts(), texts(), r.choice(boxes)) for _ in range(r.randrange(6))]
    rows = [(k, items(), items(), r.choice([None, [(texts(), texts()) for _ in range(4)]]), [x for x in ("a", "b") if r.random() < 0.2]) for k in range(300)]
    box = lambda c: F.lit(None).cast("array<int>") if c is None else F.array(*map(F.lit, c)).cast("array<int>")
    said = spark.range(1).select(*(f(box(p), box(t)) for p in boxes for t in boxes for f in (exprs.strict_match, exprs.relaxed_match))).first()
    judged = {(str(p), str(t)): said[2 * (i * len(boxes) + j) :][:2] for i, p in enumerate(boxes) for j, t in enumerate(boxes)}
    strict, relaxed = (lambda p, t, k=k: judged[str(p), str(t)][k] for k in (0, 1))
    item = "array<struct<source_image_id:string,source_doc_type:string,field:string,value:string,bbox:array<int>>>"
    df = spark.createDataFrame(rows, f"id int, t {item}, p {item}, i array<struct<image_id:string,doc_type:string>>, u array<string>")
    lists = df.select("id", "u", F.col("i.image_id").alias("ii"), F.col("i.doc_type").alias("dd"), *(v.alias(k) for c in "tp" for k, v in evidence.parts(F.col(c), c).items()))
    got = {x["id"]: tuple(x["f"]) for x in lists.select("id", evidence.found("t", "p", "ii", "dd", "u").alias("f")).collect()}
    assert got == {k: by_hand(t, p, i, u, strict, relaxed) for k, t, p, i, u in rows}


def test_keys_wider_than_64_bits():
    many = np.array([0, 1 << 40, 5, 0], np.int64)
    keys = evidence._keys(many, many, many, np.arange(4, dtype=np.int64) // 3)
    assert len(set(keys.tolist())) == 4 and not evidence._is_in(keys, np.zeros(0, np.int64)).any()
    assert evidence._boxes(pa.array([], pa.list_(pa.int32()))).shape == (0, 4)


def test_scores_leave_out_comparisons_that_nobody_asks_for(spark):
    s = scoring.score(P.predictions(O.answers(C.claims(spark, "/root/testdata/sf0.001")), ["m"]))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan(s.select("issues")) and "ArrowEvalPython" not in plan(s.select("case_id", "audit_correct"))


def test_bootstrap_sends_sums_instead_of_rows(spark):
    rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    rows = rows.withColumn("g", F.when(F.col("g") != "2", F.col("g")))
    x = rows.select("g", F.col("v"), F.posexplode(resampling.weights("k", 64, 9)).alias("b", "w")).groupBy("g", "b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    want = {r["g"]: (r["n"], round(r["se"], 9)) for r in x.groupBy("g").agg(F.max("n").alias("n"), F.stddev_samp("m").alias("se")).collect()}
    out = resampling.bootstrap(rows, ["g"], "k", "v", seed=9)
    assert {r["g"]: (r["n"], round(r["se"], 9)) for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_changed_ids_reads_each_side_once(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "case_id string")
    out = comparison.changed_ids(ids("a", "b", "b", None), ids("b", "c", "c"))
    assert {tuple(r) for r in out.collect()} == {("a", "fixed"), (None, "fixed"), ("c", "introduced")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
