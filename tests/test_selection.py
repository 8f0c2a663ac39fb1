"""Selections that depend on those before, against plain loops; holdouts, comparisons, sources."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import comparison, coverage, holdout, pairs, ranking, repair, selection
from claimlens.plans import claims as C
from claimlens.plans import outputs as O
from claimlens.sources import files, jsonl, logs, tables
from claimlens.streaming import progress

SF = "/root/testdata/sf0.001"


def in_hash_order(spark, keys, salt):
    return [r.k for r in spark.createDataFrame([(k,) for k in keys], "k string").orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("k")), 256), "k").collect()]


def test_greedy_choice_under_quotas_and_caps(spark):
    rng = random.Random(1)
    rows = [(f"p{k}", rng.choice(list(pairs.PAIR_SHARES)), rng.choice(["a", "b", "c", "none"])) for k in range(600)]
    got = pairs.select_pairs(spark.createDataFrame(rows, "pair_id string, pair_type string, label string"), 80, 7).orderBy("place").collect()
    order = {k: n for n, k in enumerate(in_hash_order(spark, [r[0] for r in rows], 7))}
    left, used, chosen = sorted(rows, key=lambda r: order[r[0]]), {}, []
    for kind, quota in [*pairs.quotas(80).items(), (None, 80)]:
        taken = 0
        for r in left:
            if (kind in (None, r[1])) and r[0] not in chosen and used.get(r[2], 0) < 20 and taken < quota and len(chosen) < 80:
                chosen.append(r[0])
                used[r[2]] = used.get(r[2], 0) + 1
                taken += 1
    assert [r.pair_id for r in got] == chosen and len(chosen) == 80


def by_loop(eligible, order):
    seen, out = {}, {}
    for k in order:
        if eligible[k]:
            out[k] = min(eligible[k], key=lambda n: seen.get(n, 0))
            seen[out[k]] = seen.get(out[k], 0) + 1
        else:
            out[k] = None
    return out


@pytest.mark.parametrize("kind", ["rare", "random", "sparse"])
def test_least_covered_kind(spark, kind):
    """Equal to the plain loop for any size of a block: kinds that are rarely eligible, any subset, and rows without a kind."""
    rng = random.Random(2)
    rare = lambda: pairs.REJECTED[:8] + rng.choice([[], [], [], [pairs.REJECTED[8]], [pairs.REJECTED[9]], pairs.REJECTED[8:]])
    some = lambda: rng.sample(pairs.REJECTED, rng.randint(1, 4))
    few = lambda: rng.sample(pairs.REJECTED[:3], rng.randint(0, 2)) + ([] if rng.random() < 0.97 else ["never"])
    rows = [(f"c{k}", {"rare": rare, "random": some, "sparse": few}[kind]()) for k in range(600)]
    df = spark.createDataFrame(rows, "case_id string, eligible array<string>")
    want = by_loop(dict(rows), in_hash_order(spark, [k for k, _ in rows], 5))
    for block in (100_000, 150, 40):
        assert {r.case_id: r.rejected_type for r in coverage.least_covered(df, "case_id", 5, block=block).collect()} == want
    first = coverage.least_covered(df, "case_id", 5, most=100, block=30).collect()
    assert {r.case_id: r.rejected_type for r in first} == dict(list(want.items())[:100])
    assert coverage.least_covered(df.limit(0), "case_id", 5).count() == 0


def test_pieces_hold_for_all_starts_that_fit():
    """A block run from another start that fits makes the same choices; one that does not fit by one is told apart."""
    rng = random.Random(7)
    for _ in range(200):
        rows = [rng.sample(range(4), rng.randint(1, 4)) for _ in range(12)]
        walk = coverage.Walk([rng.randint(0, 6) for _ in range(4)])
        picks = [walk.choose(r) for r in rows]
        piece = coverage.Piece(coverage.np.array(walk.start), coverage.np.array(walk.room), coverage.np.array(walk.count) - coverage.np.array(walk.start))
        assert piece.fits(piece.start)
        for _ in range(30):
            start = [rng.randint(0, 8) for _ in range(4)]
            other = coverage.Walk(start)
            same = [other.choose(r) for r in rows] == picks
            assert same == piece.fits(coverage.np.array(start))


def test_rounds_are_few(spark):
    """Counts even out within a block, so a hundred blocks take a few rounds and not a hundred."""
    rng = random.Random(3)
    rows = [(k, k // 50, rng.sample(range(6), 3) + ([6] if rng.random() < 0.02 else [])) for k in range(5000)]
    df = spark.createDataFrame(rows, "_r long, _block long, _kinds array<int>")
    starts, rounds = coverage.starts_of(df, 100, 7)
    walk = coverage.Walk([0] * 7)
    for k, (r, b, kinds) in enumerate(rows):
        if r % 50 == 0:
            assert starts[b].tolist() == walk.count
        walk.choose(kinds)
    assert rounds <= 8


def test_selection_by_thresholds(spark, monkeypatch):
    """Equal to the plain loop with small heads, tight caps, quotas beyond what there is, nulls and repeated keys."""
    rng = random.Random(11)
    for few, cap, most, quotas in ((5, 40, 200, {"a": 80, "b": 60, "c": 30}), (1, 7, 60, {"b": 20, "a": 20}), (3, 1000, 5000, {"a": 10, "c": 2000}), (2000, 30, 100, {"a": 100})):
        monkeypatch.setattr(selection, "FEW", few)
        rows = [(f"p{k}", rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None, "w"])) for k in range(900)]
        df = spark.createDataFrame([*rows, *rows[:50]], "pair_id string, kind string, label string")
        got = selection.select(df, "pair_id", "kind", "label", quotas, most, cap, 7).orderBy("place").collect()
        order = {k: n for n, k in enumerate(in_hash_order(spark, [r[0] for r in rows], 7))}
        left, used, chosen = sorted(rows, key=lambda r: order[r[0]]), {}, {}
        for kind, quota in [*quotas.items(), (None, most)]:
            taken = 0
            for key, own, label in left:
                if kind in (None, own) and key not in chosen and used.get(label, 0) < cap and taken < quota and len(chosen) < most:
                    chosen[key], used[label], taken = None, used.get(label, 0) + 1, taken + 1
        assert [(r.pair_id, r.place) for r in got] == [(k, n) for n, k in enumerate(chosen, 1)]
    assert selection.select(df.limit(0), "pair_id", "kind", "label", {"a": 3}, 5, 2, 7).count() == 0


def test_quotas_round_half_even():
    assert pairs.quotas(10) == {"hard_rejected": 4, "high_risk_miss": 3, "protective": 2, "normal_calibration": 1} and sum(pairs.quotas(3000).values()) == 3000


def test_pair_checks(spark):
    c = C.claims(spark, SF)
    a = O.answers(c)
    every = holdout_files(a)
    p = pairs.pair_candidates(c, a, every.where("path not like '%_invoice_00%'"))
    counts = {r["skip"]: r["n"] for r in p.groupBy("skip").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"missing_images", None}
    bad = a.select(F.col("answer").withField("evidence", F.transform("answer.evidence", lambda e: e.withField("bbox", F.array(F.lit(5), F.lit(0), F.lit(1), F.lit(9))))).alias("a"), "images")
    assert bad.where(pairs.boxes_valid(F.col("a"))).count() == 0 and a.where(~pairs.boxes_valid(F.col("answer")) | ~pairs.references_valid(F.col("answer"), F.col("images"))).count() == 0


def holdout_files(answers):
    return answers.select(F.explode("images.image_path").alias("path"))


def test_draws_by_turns(spark):
    df = spark.createDataFrame([(f"k{n}", f"s{n % 3 if n < 20 else 0}") for n in range(60)], "k string, s string")
    got = ranking.round_robin(df, "k", ["s"], 12, 1).collect()
    assert len(got) == 12 and {r.s: sum(x.s == r.s for x in got) for r in got} == {"s0": 4, "s1": 4, "s2": 4}
    two = ranking.spread_over_two(df, "k", ["s"], 20, 1).collect()
    ids = [{r.k for r in two if r.part == p} for p in (1, 2)]
    assert not ids[0] & ids[1] and list(map(len, ids)) == [20, 20]
    assert sorted(r["quota"] for r in ranking.equal_quotas(df.select("s").distinct(), [], "s", 11).collect()) == [3, 4, 4]
    filled = ranking.by_bucket_quota(df.withColumn("b", F.when(F.col("s") == "s1", "x").otherwise("y")), "k", "b", {"x": 15, "y": 5}, 3, 20).collect()
    assert len(filled) == 20 and sum(r.filled for r in filled) == 20 - 5 - min(15, sum(r.b == "x" for r in filled))


def test_targets_of_development_sets():
    assert [holdout.validation_target(n) for n in (2000, 1200, 700, 599)] == [800, 500, 350, 0]
    assert holdout.validation_quotas({"a": 2000, "b": 300}, 500) == {"a": 333, "b": 150} or sum(holdout.validation_quotas({"a": 2000, "b": 300}, 500).values()) == 500


def test_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("a", str(k)) for k in range(500)], "g string, id string")
    one, two = (holdout.id_digest(x, ["g"]).collect() for x in (df.repartition(1), df.union(df.limit(3)).repartition(7).orderBy(F.desc("id"))))
    assert one == two and holdout.id_digest(df.where("id <> '7'"), ["g"]).first().digest != one[0].digest


def test_bootstrap_error_is_that_of_a_share(spark):
    df = spark.range(4000).select((F.col("id") % 5 == 0).cast("int").alias("v"))
    r = comparison.bootstrap_error(df, "v", samples=4000).first()
    assert r.n == 4000 and r["mean"] == 0.2 and abs(r.se / math.sqrt(0.16 / 4000) - 1) < 0.05


def test_families_and_taxonomies(spark):
    a = O.answers(C.claims(spark, SF)).withColumn("f", repair.anomaly_family(F.col("answer")))
    got = {(r.label, r.f) for r in a.select("label", "f").distinct().collect()}
    assert ("none", "clean_or_low_risk") in got and ("applicant_mismatch", "person_mismatch") in got and len(got) == 10
    e = spark.createDataFrame([(["hallucination"], "high", "medium", "reject_recommendation", "manual_review"), ([], "low", "low", "pass", "pass")], "issues array<string>, true_risk string, pred_risk string, true_audit string, pred_audit string")
    assert [r[0] for r in e.select(comparison.problem_classes()).collect()] == [["model_missed_high_risk", "evidence_not_trustworthy"], ["other"]]
    old = spark.createDataFrame([(None, ["x"]), (["y"], ["x"])], "issues array<string>, issue_codes array<string>")
    assert [r[0] for r in old.select(comparison.legacy_issues(old)).collect()] == [["x"], ["y"]] and old.drop("issues").select(comparison.legacy_issues(old.drop("issues"))).first()[0] == ["x"]


def test_one_metric_row_or_an_error(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "model string, x double")
    assert comparison.one_metric_row(m, "a").select("x").first().x == 1.0
    for name in ("b", "c"):
        with pytest.raises(Exception, match="one metric row"):
            comparison.one_metric_row(m, name).collect()
    assert comparison.markdown([{"a": 0.12345, "b": None}, {"a": 12.0, "b": "x\ny"}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 0.1235 |  |\n| 12.0 | x y |"


def test_strict_lines_name_the_bad_one(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert jsonl.read_strict(spark, f"file://{folder}", "a int").count() == 2
    (folder / "b.jsonl").write_text('{"a":1}\n[1]\n{"a":3}\n{"a":\n')
    bad = jsonl.invalid_lines(spark, f"file://{folder}", "a int").orderBy("line").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line) for r in bad] == [("b.jsonl", 2), ("b.jsonl", 4)]
    with pytest.raises(Exception, match=r"b.jsonl:2:"):
        jsonl.read_strict(spark, f"file://{folder}", "a int").collect()
    assert [r.a for r in jsonl.read_first(spark, f"file://{folder}/a.jsonl", "a int", 1, "a").collect()] == [1]


def test_shards(spark, tmp_path):
    (tmp_path / "rollouts.jsonl").write_text('{"k":1}\n')
    assert jsonl.read_shards(spark, f"file://{tmp_path}", "k int", "k").count() == 1
    for n in range(3):
        (tmp_path / f"rollouts.shard-{n}.jsonl").write_text("".join(f'{{"k":{10 * n + j}}}\n' for j in range(4)))
    assert jsonl.read_shards(spark, f"file://{tmp_path}", "k int", "k").count() == 12
    (tmp_path / "rollouts.shard-9.jsonl").write_text('{"k":1}\n')
    with pytest.raises(ValueError, match="twice"):
        jsonl.read_shards(spark, f"file://{tmp_path}", "k int", "k")


def test_tables_and_configs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿model,x\na,1.5\nb,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/m.csv", "x double, model string, y int").collect()] == [(1.5, "a", None), (None, "b", None)]
    both = tables.stacked([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")])
    assert both.columns == ["a", "b", "c"] and sorted(map(str, both.collect()))[0] == "Row(a=1, b=2, c=None)"
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / "l.json").write_text("[1]")
    assert tables.config(spark, f"file://{tmp_path}/c.json") == {"a": 1}
    with pytest.raises(ValueError):
        tables.config(spark, f"file://{tmp_path}/l.json")
    df = spark.createDataFrame([(None, "c1_full_audit_x", [("user", "p"), ("assistant", '{"z":1}')])], "case_id string, id string, messages array<struct<role:string,content:string>>")
    assert df.select(tables.case_key("case_id", "id"), tables.answer_text(df)).first()[:] == ("c1", '{"z":1}')


def test_logs_and_harvests(spark, tmp_path):
    lines = spark.createDataFrame([("step 1",), ('{"stage":"dpo_train","global_step":3}',), ('{"stage":"other"}',), ('{"stage":',)], "value string")
    assert [r.global_step for r in logs.records(lines, "stage string, global_step long", ["dpo_train"]).collect()] == [3]
    (tmp_path / "t.txt").write_text("MV_MAIN_000001 x MV_MAIN_000002, MV_MAIN_000001")
    assert sorted(r.id for r in jsonl.harvest_ids(spark, f"file://{tmp_path}", r"\bMV_MAIN_\d{6}\b").collect()) == ["MV_MAIN_000001", "MV_MAIN_000002"]


def test_files_and_lineage(spark, tmp_path):
    import struct

    head = json.dumps({"w": 1}).encode()
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "a.bin").write_bytes(struct.pack("<Q", len(head)) + head + b"xx")
    (tmp_path / "b.bin").write_bytes(b"short")
    found = files.digests(spark, f"file://{tmp_path}")
    at = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    row = lambda m, parent, weights, size=None, sha=None: (m, parent, at["a.json"].path, at[weights].path if weights in at else "gone", None, at["a.json"].sha256, sha or (at[weights].sha256 if weights in at else ""), size or (at[weights].length if weights in at else 0), None)
    models = spark.createDataFrame(
        [row("ok", None, "a.bin"), row("child", "ok", "a.bin", sha="0"), row("orphan", "none", "a.bin"), row("gone", None, "c.bin"), row("size", None, "a.bin", 1), row("head", None, "b.bin")],
        "model_id string, parent_model_id string, config string, weights string, archive string, config_sha256 string, weights_sha256 string, weights_bytes long, archive_sha256 string")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"file://{tmp_path}")
    got = {r.model_id: r.status for r in files.lineage_audit(models, found, files.header_errors(raw).where("error is not null")).collect()}
    assert got == {"ok": "VERIFIED", "child": "HASH_MISMATCH", "orphan": "INVALID_LINEAGE", "gone": "LOCAL_MISSING", "size": "SIZE_MISMATCH", "head": "INVALID_WEIGHTS"}
    assert files.row_summary(spark.range(5), "id", "id").first()[:] == (5, 0, 4) and files.listing(spark, f"file://{tmp_path}").count() == 3
    files.write_manifest(spark, f"file://{tmp_path}/m.json", {"n": 1})
    files.write_manifest(spark, f"file://{tmp_path}/m.json", {"n": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 2} and not (tmp_path / "m.json.tmp").exists()


def test_stream_is_flushed_once(spark, tmp_path):
    rows = [(k % 6, f"2024-01-01 00:0{k % 6}:00", "dpo_train", k, float(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "event_id long, t string, stage string, global_step long, loss double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.json(f"file://{tmp_path}/in")
    assert progress.running_metrics(df).first()[:] == ("dpo_train", 8, 7, 3.5)
    for _ in range(2):
        q = progress.flushed(progress.watched(spark, f"file://{tmp_path}/in", df.schema), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", once=True, key="event_id")
        q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6
