"""Queries on rewards, preference pairs, repair sets, holdouts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entry import query
from .functions import contract
from .functions.exprs import draw
from .operators import comparison, coverage, gates, holdout, repair, rewards, splits
from .operators import pairs as PR
from .operators.storing import stored
from .operators.validation import money_errors as why_no_money
from .plans import claims as C
from .plans import generator
from .plans import outputs as O
from .plans import predictions as P
from .sources import logs
from .queries_eval import FAMILY, SAID, scores_sql
from .sql import CLAIMS, SPLITS, u

SALTS = ("s0", "s1", "s2", "s3")


def completions(spark, sf_dir, mined_only: bool = False) -> DataFrame:
    """Four completions of every claim, with their position; mined_only leaves out claims that give no pairs, before anything is made of them."""
    c = C.claims(spark, sf_dir)
    if mined_only:
        c = c.where(PR.mining_bucket(F.struct("risk_level", "audit_result", "anomaly_types")).isin(*PR.MINED_BUCKETS))
    x = P.predictions(O.answers(c), list(SALTS))
    return x.withColumn("position", F.substring("model", 2, 1).cast("int"))


REWARDS = f"""{scores_sql(SALTS)}, tp AS (SELECT case_id, max(value) FILTER (field = 'order_id' AND doc_type = 'order') AS o, max(value) FILTER (field = 'order_id' AND doc_type = 'reimbursement_form') AS r FROM evidence GROUP BY 1),
parts AS (
  SELECT s.*, o, r, NOT schema_valid OR (true_risk = 'high' AND pred_audit = 'pass') OR (label = 'missing_document' AND pred_audit = 'pass') AS stopped,
    label = 'order_id_mismatch' AS mismatch, coalesce(label = 'order_id_mismatch' AND o <> r, false) AS pair,
    CASE WHEN mode = 'unreadable_but_guess' THEN ((NOT (len(unreadable_fields) > 0 OR NOT evidence_sufficient))::INT + (len(unreadable_fields) = 0)::INT + (true_audit NOT IN ('manual_review', 'missing_info'))::INT) / 3.0::DOUBLE ELSE 1.0::DOUBLE END AS unsure
  FROM scores s JOIN tp USING (case_id)
), rewards AS (
  SELECT case_id, model, mode, label, json_valid, schema_valid, true_risk, true_audit, pair, stopped, json_valid::INT::DOUBLE AS r_json,
    CASE WHEN stopped THEN 0 ELSE field_correct::DOUBLE / 20 END AS r_field, CASE WHEN stopped THEN 0 ELSE consistency_correct::DOUBLE / 8 END AS r_consistency, CASE WHEN stopped THEN 0 ELSE 1.0::DOUBLE END AS r_anomaly,
    CASE WHEN stopped THEN 0 ELSE (risk_correct AND audit_correct)::INT::DOUBLE END AS r_audit, CASE WHEN stopped THEN 0 ELSE (support::DOUBLE / n + value_ok::DOUBLE / n + source_ok::DOUBLE / n + relaxed_ok::DOUBLE / n) / 4 END AS r_evidence,
    CASE WHEN stopped THEN 0 ELSE unsure END AS r_uncertainty, CASE WHEN stopped THEN 0 ELSE pair::INT::DOUBLE END AS r_order_id_pair, CASE WHEN stopped OR n_pred = 0 THEN 0 ELSE wrong::DOUBLE / n_pred END AS p_hallucination,
    CASE WHEN stopped THEN (schema_valid AND true_risk = 'high' AND pred_audit = 'pass')::INT::DOUBLE ELSE high_risk_miss::INT::DOUBLE END AS p_high_risk_miss, CASE WHEN stopped THEN 0 ELSE (mismatch AND NOT pair)::INT::DOUBLE END AS p_missing,
    CASE WHEN stopped THEN 0 ELSE (true_risk = 'low' AND true_audit = 'pass' AND (pred_risk = 'high' OR pred_audit = 'reject_recommendation'))::INT::DOUBLE END AS p_false
  FROM parts
), rewarded AS (
  SELECT *, CASE WHEN stopped THEN -1.0 ELSE least(CASE WHEN p_missing > 0 THEN 0.0 ELSE 1.0 END, greatest(-1.0, 0.15::DOUBLE * r_field + 0.15::DOUBLE * r_consistency + 0.2::DOUBLE * r_anomaly + 0.15::DOUBLE * r_audit + 0.15::DOUBLE * r_evidence + 0.1::DOUBLE * r_json
    + 0.1::DOUBLE * r_uncertainty + 0.25::DOUBLE * r_order_id_pair - 0.2::DOUBLE * p_hallucination - 0.4::DOUBLE * p_high_risk_miss - 0.5::DOUBLE * p_missing - 0.4::DOUBLE * p_false)) END AS reward FROM rewards
)"""


@query(f"{REWARDS} SELECT case_id, model, round(reward, 9) AS reward, round(r_evidence, 9) AS r_evidence, round(r_uncertainty, 9) AS r_uncertainty, r_order_id_pair, round(p_hallucination, 9) AS p_hallucination, p_high_risk_miss, p_missing AS p_missing_order_id_pair FROM rewarded")
def reward_scores(spark, sf_dir):
    """Rewards of four completions of every claim, with some of their parts."""
    r = rewards.reward(completions(spark, sf_dir))
    return r.select("case_id", "model", *(F.round(c, 9).alias(c) for c in ("reward", "r_evidence", "r_uncertainty")), "r_order_id_pair", F.round("p_hallucination", 9).alias("p_hallucination"), "p_high_risk_miss", "p_missing_order_id_pair")


@query(f"""{REWARDS}, g AS (SELECT case_id, avg(reward) AS m, stddev_pop(reward) AS s FROM rewarded GROUP BY 1)
SELECT case_id, model, round(CASE WHEN s < 1e-6 THEN 0 ELSE (reward - m) / (s + 1e-6) END, 6) + 0.0 AS advantage FROM rewarded JOIN g USING (case_id)""")
def reward_group_norm(spark, sf_dir):
    """Rewards of a claim's completions as advantages within their group."""
    r = stored(rewards.reward(completions(spark, sf_dir)).select("case_id", "model", "reward"))
    return rewards.normalised(r, ["case_id"]).select("case_id", "model", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query(f"""{REWARDS} SELECT model, count(*) AS count, round(avg(reward), 9) AS mean_reward, round(avg(r_json), 9) AS json_valid_rate, round(avg(p_high_risk_miss), 9) AS high_risk_miss_rate, round(avg(p_hallucination), 9) AS hallucination_penalty,
  round(avg(r_order_id_pair), 9) AS order_id_pair_rate, round(avg(p_missing), 9) AS missing_order_id_pair_rate, round(avg(p_false), 9) AS false_escalation_rate FROM rewarded GROUP BY 1""")
def reward_summary(spark, sf_dir):
    """Means of rewards and penalties of each set of completions."""
    s = rewards.summary(rewards.reward(completions(spark, sf_dir)), "model")
    return s.select("model", "count", *(F.round(c, 9).alias(c) for c in s.columns if c not in ("model", "count")))


MINED = f"""{REWARDS}, b AS (
  SELECT *, CASE WHEN label = 'order_id_mismatch' THEN 'order_id_mismatch' ELSE 'low_pass' END AS bucket, {SAID} AS said FROM rewarded
  WHERE schema_valid AND ((label = 'order_id_mismatch' AND true_audit = 'reject_recommendation' AND pair) OR (true_risk = 'low' AND true_audit = 'pass'))
), ql AS (
  SELECT *, CASE WHEN bucket = 'order_id_mismatch' THEN 0.4::DOUBLE * r_json + 0.15::DOUBLE * r_order_id_pair + 0.15::DOUBLE * r_audit + 0.1::DOUBLE * r_anomaly + 0.1::DOUBLE * r_evidence + 0.05::DOUBLE * r_field + 0.05::DOUBLE * r_consistency
      ELSE 0.4::DOUBLE * r_json + 0.25::DOUBLE * r_audit + 0.2::DOUBLE * (1 - p_false) + 0.1::DOUBLE * r_anomaly + 0.05::DOUBLE * r_evidence END AS quality,
    CASE WHEN bucket = 'order_id_mismatch' THEN r_order_id_pair = 1 AND r_audit = 1 AND r_anomaly = 1 ELSE r_audit = 1 AND p_false = 0 END AS ok, r_order_id_pair < 1 OR r_audit < 1 OR r_anomaly < 1 OR p_high_risk_miss > 0 AS failed FROM b
), good AS (SELECT * FROM ql WHERE ok QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY quality DESC, model) = 1
), chosen AS (
  SELECT case_id, bucket, 'model_generated' AS chosen_source, quality AS chosen_reward, said, r_evidence FROM good
  UNION ALL SELECT DISTINCT case_id, bucket, 'expert_corrected_target', 0.4::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE, 'expert', 1.0 FROM ql WHERE bucket = 'order_id_mismatch' AND case_id NOT IN (SELECT case_id FROM good)
), rej AS (
  SELECT q.case_id, 'model_generated' AS rejected_source, max(q.quality) AS rejected_reward FROM ql q JOIN chosen c USING (case_id) WHERE q.failed AND q.bucket = 'order_id_mismatch' AND q.said <> c.said GROUP BY 1
  UNION ALL SELECT case_id, 'synthetic_false_escalation_calibration', 0.4::DOUBLE + 0.05::DOUBLE * r_evidence FROM good WHERE bucket = 'low_pass'
), mined AS (SELECT *, chosen_reward - rejected_reward AS gap FROM chosen JOIN rej USING (case_id) WHERE chosen_reward - rejected_reward + 1e-9 >= 0.15 AND chosen_reward - rejected_reward - 1e-9 <= 0.6
), parted AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY sha256('1045:' || case_id), case_id) <= CASE WHEN bucket = 'low_pass' THEN 6 ELSE 18 END THEN 'holdout' ELSE 'train' END AS part FROM mined)"""


def mined(spark, sf_dir) -> DataFrame:
    """Mined pairs in parts; the pairs are few columns, which ranks and counts read again."""
    return PR.take_holdout(stored(PR.mined_pairs(completions(spark, sf_dir, mined_only=True))), 24, 1045)


@query(f"{MINED} SELECT case_id, bucket AS pair_type, chosen_source, rejected_source, round(chosen_reward, 9) AS chosen_reward, round(rejected_reward, 9) AS rejected_reward, round(gap, 9) AS reward_gap, part FROM parted")
def mined_pairs(spark, sf_dir):
    """Pairs of good and failing completions, with a small holdout."""
    m = mined(spark, sf_dir)
    return m.select("case_id", "pair_type", "chosen_source", "rejected_source", *(F.round(c, 9).alias(c) for c in ("chosen_reward", "rejected_reward", "reward_gap")), "part")


@query(f"""{MINED} SELECT count(*) FILTER (part = 'train') AS train_pairs, count(*) FILTER (part = 'holdout') AS holdout_pairs, count(*) FILTER (chosen_source = 'expert_corrected_target') AS expert_chosen, round(min(gap), 9) AS gap_min, round(max(gap), 9) AS gap_max,
  round(avg(gap), 9) AS gap_mean, round(avg(CASE WHEN bucket = 'low_pass' THEN 1.0 ELSE 2.0 END), 9) AS weight_mean, CASE WHEN count(*) FILTER (gap + 1e-9 < 0.15 OR gap - 1e-9 > 0.60) = 0 AND count(*) = count(DISTINCT case_id) THEN 'PASS' ELSE 'FAIL' END AS status FROM parted""")
def pair_audit(spark, sf_dir):
    """Counts, ranges and the status of the mined pairs."""
    a = PR.pair_audit(mined(spark, sf_dir))
    return a.select("train_pairs", "holdout_pairs", "expert_chosen", *(F.round(c, 9).alias(c) for c in ("gap_min", "gap_max", "gap_mean", "weight_mean")), "status")


PAIRS = f"""{CLAIMS}, hashed AS (SELECT *, row_number() OVER (ORDER BY sha256('844:' || case_id), case_id) AS hr, count(*) OVER () AS hn FROM claims),
roles AS (SELECT *, CASE WHEN hr <= greatest(1, hn // 10) THEN 'holdout' WHEN hr <= greatest(1, hn // 10) + least(200, hn - greatest(1, hn // 10)) THEN 'decode_dev' ELSE 'train' END AS role FROM hashed),
typed AS (SELECT *, unnest(list_filter(['hard_rejected', CASE WHEN risk_level = 'high' THEN 'high_risk_miss' END, CASE WHEN risk_level = 'high' AND label IN ({', '.join(f"'{a}'" for a in PR.PROTECTED)}) THEN 'protective' END,
    CASE WHEN risk_level <> 'high' OR audit_result <> 'reject_recommendation' THEN 'normal_calibration' END], lambda x: x IS NOT NULL)) AS pair_type FROM roles),
kinds AS (SELECT *, CASE pair_type WHEN 'high_risk_miss' THEN 'high_risk_pass' WHEN 'normal_calibration' THEN 'normal_over_reject'
    WHEN 'protective' THEN CASE WHEN label IN ('amount_mismatch', 'over_reimbursement') THEN 'high_risk_downgrade' WHEN label = 'order_id_mismatch' THEN 'audit_result_wrong' ELSE 'risk_level_wrong' END
    ELSE CASE WHEN risk_level = 'high' THEN 'high_risk_downgrade' WHEN audit_result <> 'pass' THEN 'audit_result_wrong' ELSE 'risk_level_wrong' END END AS kind FROM typed),
weighed AS (SELECT *, CASE kind WHEN 'high_risk_pass' THEN 3.0 WHEN 'high_risk_downgrade' THEN 2.5 WHEN 'audit_result_wrong' THEN 2.0 WHEN 'risk_level_wrong' THEN 1.8 ELSE 1.5 END::DOUBLE AS severity,
    CASE WHEN pair_type IN ('hard_rejected', 'protective') THEN 1.5 WHEN pair_type = 'high_risk_miss' THEN 1.4 ELSE 1.0 END::DOUBLE AS hardness, CASE WHEN evidence_sufficient THEN 1.0 ELSE 0.5 END::DOUBLE AS reliability FROM kinds)"""


def weighed_candidates(spark, sf_dir) -> DataFrame:
    """Candidate pairs with their weights; selections and means need no answers, so none are made."""
    return PR.pair_keys(C.claims(spark, sf_dir))


@query(f"""{PAIRS} SELECT case_id, role, pair_type, kind AS rejected_error_type, round(least(3.0, severity * hardness * reliability), 9) AS final_weight,
  CASE pair_type WHEN 'high_risk_miss' THEN 'low' WHEN 'normal_calibration' THEN 'high' WHEN 'protective' THEN CASE WHEN label = 'order_id_mismatch' THEN 'low' ELSE 'medium' END ELSE CASE WHEN risk_level <> 'high' AND audit_result <> 'pass' THEN 'low' ELSE 'medium' END END AS rejected_risk,
  CASE pair_type WHEN 'high_risk_miss' THEN 'pass' WHEN 'normal_calibration' THEN 'reject_recommendation' WHEN 'protective' THEN CASE WHEN label = 'order_id_mismatch' THEN 'pass' ELSE 'manual_review' END ELSE CASE WHEN risk_level <> 'high' AND audit_result <> 'pass' THEN 'pass' ELSE 'manual_review' END END AS rejected_audit,
  CASE WHEN pair_type = 'high_risk_miss' AND label NOT IN ('none', 'date_mismatch', 'duplicate_in_batch') THEN 0 WHEN pair_type = 'normal_calibration' THEN 1 ELSE len(anomaly_types) END::INT AS n_rejected_anomalies, CAST(NULL AS VARCHAR) AS skip
FROM weighed WHERE role <> 'decode_dev'""")
def dpo_pairs_v2(spark, sf_dir):
    """Candidate pairs by rule, with their role, weight and what the rejected answer says; cases for decoding give none."""
    labelled = C.labels(spark, sf_dir)
    ids = C.table(spark, sf_dir, "orders").select(C.case_id(F.col("o_orderkey")).alias("case_id"))
    orders = PR.three_way_split(labelled, "case_id", 844, counted=ids, keep=[c for c in labelled.columns if c != "case_id"]).where("role <> 'decode_dev'")
    p = PR.answered_candidates(O.answers(C.claims(spark, sf_dir, orders=orders), *PR.PAIR_FACTS[2:], "role"))
    return p.select(
        "case_id", "role", "pair_type", "rejected_error_type", F.round("final_weight", 9).alias("final_weight"), F.col("rejected.risk_level").alias("rejected_risk"), F.col("rejected.audit_result").alias("rejected_audit"),
        F.size("rejected.anomaly_types").alias("n_rejected_anomalies"), "skip")


@query(f"""{PAIRS}, w AS (SELECT pair_type, least(3.0, severity * hardness * reliability) AS w FROM weighed) SELECT pair_type, count(*) AS n, round(min(w), 9) AS weight_min, round(max(w), 9) AS weight_max, round(avg(w), 9) AS weight_mean, round(avg(w / (SELECT avg(w) FROM w v WHERE v.pair_type = w.pair_type)), 6) AS mean_of_weights,
  round(sum(w * w) / sum(w), 6) AS weighted_mean FROM w GROUP BY 1""")
def pair_weights(spark, sf_dir):
    """Weights of candidate pairs by type, as they are and as batches (here the types) scale them."""
    p = weighed_candidates(spark, sf_dir).select("pair_type", "final_weight")
    x = rewards.batch_weights(p, ["pair_type"])
    return x.groupBy("pair_type").agg(
        F.count("*").alias("n"), F.round(F.min("final_weight"), 9).alias("weight_min"), F.round(F.max("final_weight"), 9).alias("weight_max"), F.round(F.avg("final_weight"), 9).alias("weight_mean"),
        F.round(F.avg("weight"), 6).alias("mean_of_weights"), F.round(rewards.weighted_mean("final_weight", "final_weight"), 6).alias("weighted_mean"))


def _selection_sql(most: int, salt: int, cap: int) -> str:
    """Phase after phase: the rows of a type (or the rest) that their label's cap lets through, in order, up to the quota."""
    parts, before = [f"c AS (SELECT *, sha256('{salt}:' || pair_id) AS h FROM (SELECT case_id || '_' || pair_type || '_' || kind AS pair_id, pair_type, label FROM weighed))", "s0 AS (SELECT *, 0 AS place FROM c LIMIT 0)"], "s0"
    for k, (kind, quota) in enumerate([*PR.quotas(most).items(), (None, most)], 1):
        own = f"pair_type = '{kind}'" if kind else f"pair_id NOT IN (SELECT pair_id FROM {before})"
        parts += [
            f"o{k} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, pair_id) AS r FROM c WHERE {own})",
            f"n{k} AS (SELECT o{k}.*, row_number() OVER (ORDER BY h, pair_id) AS p FROM o{k} LEFT JOIN (SELECT label, count(*) AS used FROM {before} GROUP BY 1) USING (label) WHERE r <= {cap} - coalesce(used, 0))",
            f"s{k} AS (SELECT * FROM {before} UNION ALL SELECT pair_id, pair_type, label, h, p + (SELECT count(*) FROM {before}) FROM n{k} WHERE p <= least({quota}, {most} - (SELECT count(*) FROM {before})))",
        ]
        before = f"s{k}"
    return f"{', '.join(parts)} SELECT pair_id, pair_type, label, place FROM {before}"


@query(f"{PAIRS}, {_selection_sql(1000, 901, 250)}")
def pair_selection(spark, sf_dir):
    """1000 pairs under the quotas of their types and a cap for each anomaly; each choice depends on those before."""
    return PR.select_pairs(stored(weighed_candidates(spark, sf_dir).select("pair_id", "pair_type", "label")), 1000, 901).select("pair_id", "pair_type", "label", "place")


KINDS = f"""{CLAIMS.replace('WITH', 'WITH RECURSIVE', 1)}, seq AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('542:' || case_id), case_id) AS i, case_id, [1, 2, 3, 4, 5, 6, 7, 8] || CASE WHEN label = 'unreadable_image' THEN [9] ELSE [] END || CASE WHEN label = 'missing_document' THEN [10] ELSE [] END AS e FROM claims
), step(i, case_id, pick, n) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
  UNION ALL SELECT i, case_id, pick, list_transform(n, lambda c, k: c + (k = pick)::INT) FROM (
    SELECT seq.i, seq.case_id, n, e[list_position(list_transform(e, lambda k: n[k]), list_min(list_transform(e, lambda k: n[k])))] AS pick FROM step JOIN seq ON seq.i = step.i + 1)
)"""


def _kinds(labelled: DataFrame) -> DataFrame:
    """The kinds of rejected answers of labelled orders: which fit depends on the label alone, so no claims are made."""
    c = labelled.select("case_id", C.anomaly_types().alias("anomaly_types"))
    return coverage.least_covered(c.select("case_id", PR.eligible_rejections().alias("eligible")), "case_id", 542)


@query(f"{KINDS} SELECT case_id, [{', '.join(repr(k) for k in PR.REJECTED)}][pick] AS rejected_type FROM step WHERE i > 0")
def rejected_kinds(spark, sf_dir):
    """For every claim the kind of rejected answer that is least covered so far, over all claims in hash order."""
    return _kinds(C.labels(spark, sf_dir))


@query()
def dpo_pairs_v1(spark, sf_dir):
    """One rejected answer of every claim, of the kind least covered so far."""
    labelled = C.labels(spark, sf_dir)
    c = C.claims(spark, sf_dir, orders=labelled.join(_kinds(labelled), "case_id")).withColumns({f"_said_{f}": O.field_text(f) for f in O.FIELDS})
    x = O.answers(c, "rejected_type", *(f"_said_{f}" for f in O.FIELDS))
    said = PR.rejected_answer(F.col("answer"), F.col("rejected_type"), {f: F.col(f"_said_{f}") for f in O.FIELDS})
    return x.select("case_id", "rejected_type", F.sha2(said, 256).alias("rejected_sha256"), F.get_json_object(said, "$.audit_result").alias("rejected_audit"))


TRAIN = f"""{SPLITS}, rows_of AS (SELECT splits.*, {FAMILY} AS family FROM splits), excluded AS (SELECT case_id FROM rows_of WHERE split <> 'train' OR {u('used', 'case_id')} % 20 = 0)"""
PACK = f"""{TRAIN}, pool AS (
  SELECT case_id, family, 5 + CASE audit_result WHEN 'reject_recommendation' THEN 5 ELSE 3 END + CASE WHEN family IN ('amount_abnormal', 'order_id_inconsistent', 'evidence_or_document_insufficient') THEN 5 ELSE 0 END + 2 AS score, audit_result FROM rows_of
  WHERE split = 'train' AND risk_level = 'high' AND audit_result <> 'pass' AND case_id NOT IN (SELECT case_id FROM excluded)
), fr AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, case_id) AS r FROM pool), k AS (SELECT count(DISTINCT family) AS k FROM pool WHERE family <> 'clean_or_low_risk'),
pick AS (SELECT *, NOT (family <> 'clean_or_low_risk' AND r <= greatest(1, 100 // (SELECT k FROM k))) AS filled FROM fr WHERE r <= 100),
place AS (SELECT *, CASE family {' '.join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(repair.FAMILIES))} ELSE 7 END AS turn FROM pick),
pack AS (SELECT * FROM place ORDER BY filled, CASE WHEN filled THEN 0 ELSE turn END, CASE WHEN filled THEN -score ELSE r END, CASE WHEN filled THEN family END, case_id LIMIT 100)"""


def _train(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Answers with their split, and ids that must not be used: other splits, and a twentieth that was used before."""
    s, used = _splits_and_used(spark, sf_dir)
    return O.answers(C.claims(spark, sf_dir)).join(s, "case_id"), used


def _candidates(spark, sf_dir, s: DataFrame) -> DataFrame:
    """Answers of the claims that a repair pack can take, as it takes only high ones of train that do not pass; others are not made."""
    train = s.where("source_split = 'train'")
    return O.answers(C.claims(spark, sf_dir, train).where("risk_level = 'high' and audit_result <> 'pass'")).withColumn("source_split", F.lit("train"))


def _splits_and_used(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """case_id, source_split of all claims, and ids that must not be used."""
    s = stored(splits.assign_splits(C.labels(spark, sf_dir)).select("case_id", F.col("split").alias("source_split")))
    used = repair.excluded_ids({"evaluation": s.where("source_split <> 'train'"), "used": s.where(draw("case_id", "used") % 20 == 0)})
    return s, used


@query(f"""{PACK} SELECT case_id, family, score::INT AS score, filled, CASE {' '.join(f"WHEN family = '{f}' THEN '{t}'" for f, t in repair.STRATEGIES.items())} WHEN audit_result = 'reject_recommendation' THEN '{repair.STRATEGY_REJECT}' ELSE '{repair.STRATEGY_OTHER}' END AS repair_strategy FROM pack""")
def repair_pack(spark, sf_dir):
    """100 high-risk training claims to repair a model with, spread over anomaly families."""
    rows, used = _train(spark, sf_dir)
    return repair.repair_pack(rows, used, 100).select("case_id", "family", "score", "filled", "repair_strategy")


@query(f"""{PACK}, cal AS (
  SELECT case_id, CASE WHEN risk_level = 'low' AND audit_result = 'pass' THEN 'low_pass' WHEN risk_level = 'medium' OR audit_result IN ('manual_review', 'missing_info') THEN 'medium_or_manual_review' END AS bucket FROM rows_of
  WHERE case_id NOT IN (SELECT case_id FROM excluded) AND case_id NOT IN (SELECT case_id FROM pack)
), cr AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('44:' || case_id), case_id) AS r FROM cal WHERE bucket IS NOT NULL)
SELECT case_id, 'repair' AS role, CAST(NULL AS VARCHAR) AS bucket FROM pack UNION ALL SELECT case_id, 'calibration', bucket FROM cr WHERE r <= CASE bucket WHEN 'low_pass' THEN 40 ELSE 20 END""")
def repair_mix(spark, sf_dir):
    """The repair pack with 60 calibration claims, two thirds of them low."""
    rows, used = _train(spark, sf_dir)
    m = repair.repair_mix(stored(repair.repair_pack(rows, used, 100)), rows, used, 60, 44, "repair_v3", missing_info=True)
    return m.select("case_id", "repair_mix_metadata.role", "repair_mix_metadata.bucket")


@query(f"""{PACK} SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM pack)), ('ids', (SELECT count(DISTINCT case_id) FROM pack)), ('repeated_ids', (SELECT count(*) FROM (SELECT case_id FROM rows_of JOIN pack USING (case_id) GROUP BY 1 HAVING count(*) > 1))), ('invalid_answers', (SELECT count(*) FROM rows_of JOIN pack USING (case_id) WHERE rows_of.risk_level NOT IN ('low', 'medium', 'high') OR rows_of.audit_result NOT IN ('pass', 'manual_review', 'missing_info', 'reject_recommendation') OR length(case_id) = 0 OR len(list_distinct(anomaly_types)) < len(anomaly_types))), ('in_evaluation', (SELECT count(*) FROM pack WHERE case_id IN (SELECT case_id FROM rows_of WHERE split <> 'train'))),
  ('in_used', (SELECT count(*) FROM pack JOIN rows_of USING (case_id) WHERE {u('used', 'case_id')} % 20 = 0)), ('not_train', (SELECT count(*) FROM pack WHERE case_id NOT IN (SELECT case_id FROM rows_of WHERE split = 'train')))) AS x("check", n)""")
def repair_set_audit(spark, sf_dir):
    """The repair pack's checks: repeated and invalid rows, and ids that lie in other sets."""
    return repair_sets(spark, sf_dir)[0]


def repair_sets(spark, sf_dir) -> tuple[DataFrame, int]:
    """The audit of the repair pack, and how many rows the pack has."""
    s, used = _splits_and_used(spark, sf_dir)
    ids = stored(repair.repair_pack(_candidates(spark, sf_dir, s), used, 100).select("case_id"))
    boundaries = {n: used.where(F.col("source") == n) for n in ("evaluation", "used")}
    pack = stored(O.answers(C.claims(spark, sf_dir, ids)).join(s, "case_id"))
    return repair.repair_audit(pack, contract.answer_valid(F.col("answer")), boundaries, s.where("source_split = 'train'")), ids.count()


@query(f"""{SPLITS}, l AS (SELECT case_id, label, CASE WHEN {u('kind', 'case_id')} % 3 = 0 THEN 'order_rewritten' ELSE 'as_is' END AS k FROM splits WHERE label = 'order_id_mismatch')
SELECT c.case_id, starts_with(l.k, 'order') AS rewritten, 'order' AS first_document, 'reimbursement_form' AS second_document, '{PR.REPAIR_REASON[0]}' || shown_order_id || '{PR.REPAIR_REASON[1]}' || order_id || '{PR.REPAIR_REASON[2]}' AS reason
FROM claims c JOIN l USING (case_id) WHERE l.k = 'order_rewritten'""")
def structured_order_ids(spark, sf_dir):
    """Answers rewritten with both order ids in front and a reason that names them, for a third of the order id claims."""
    a = O.answers(C.claims(spark, sf_dir)).where("label = 'order_id_mismatch'").where(draw("case_id", "kind") % 3 == 0)
    s = a.select("case_id", PR.structured_order_ids(F.col("answer"), PR.REPAIR_REASON).alias("s"))
    at = lambda k: F.get("s.evidence", F.lit(k))["source_doc_type"]
    return s.select("case_id", F.col("s").isNotNull().alias("rewritten"), at(0).alias("first_document"), at(1).alias("second_document"), "s.reason")


TESTS = "('test_clean', 'test_robust', 'test_unseen_template', 'test_hard_negative')"
MANIFEST = f"""{SPLITS}, pool AS (SELECT * FROM splits WHERE split IN {TESTS} AND NOT (split = 'test_hard_negative' AND label = 'none')),
groups AS (SELECT split, label, 40 // count(*) OVER (PARTITION BY split) + (row_number() OVER (PARTITION BY split ORDER BY label) - 1 < 40 % count(*) OVER (PARTITION BY split))::INT AS quota FROM (SELECT DISTINCT split, label FROM pool)),
sizes AS (SELECT split, label, risk_level, audit_result, count(*) AS size, sum(count(*)) OVER (PARTITION BY split, label) AS total FROM pool GROUP BY split, label, risk_level, audit_result),
based AS (SELECT s.*, least(quota, total) AS q, least(quota, total) * size // total AS base, least(quota, total) * size % total AS frac FROM sizes s JOIN groups USING (split, label)),
quotaed AS (SELECT *, base + (row_number() OVER (PARTITION BY split, label ORDER BY frac DESC, risk_level DESC, audit_result DESC) <= q - sum(base) OVER (PARTITION BY split, label))::INT AS take FROM based),
manifest AS (SELECT p.split, p.case_id, p.id, p.label, p.risk_level, p.audit_result FROM (SELECT *, row_number() OVER (PARTITION BY split, label, risk_level, audit_result ORDER BY sha256('42:' || case_id), case_id) AS pr FROM pool) p
  JOIN quotaed USING (split, label, risk_level, audit_result) WHERE pr <= take)"""


def split_claims(spark, sf_dir) -> DataFrame:
    """Claims with their splits; stored, as holdouts read them many times."""
    c = C.claims(spark, sf_dir).select("id", "case_id", "risk_level", "audit_result", "documents", "anomaly_types")
    s = splits.assign_splits(C.labels(spark, sf_dir))
    return stored(s.join(c, "case_id"))


def _manifest(tests: DataFrame) -> DataFrame:
    return holdout.stratified_manifest(tests.where(F.col("split").startswith("test_")), 40, 42)


@query(f"{MANIFEST} SELECT (row_number() OVER (PARTITION BY split ORDER BY id) - 1)::INT AS sample_index, split, case_id, label, risk_level, audit_result FROM manifest")
def holdout_manifest(spark, sf_dir):
    """40 claims of each test split, evenly over labels and in proportion within them, in their own order."""
    return _manifest(split_claims(spark, sf_dir))


LOST_IMAGES = f"{u('image', 'path')} % 25 = 0"


def _files(images: DataFrame) -> DataFrame:
    """The image files that are there: all but a twenty-fifth."""
    return images.where(draw("image_path", "image") % 25 != 0).select(F.col("image_path").alias("path"))


def _records(claims: DataFrame) -> DataFrame:
    return claims.select("case_id", F.posexplode(O.image_items()).alias("place", "i")).select("case_id", "place", "i.*")


STATUS = f"""files AS (
  SELECT case_id, d, 'images/' || case_id || '_' || d || '_' || k || '.png' AS path FROM (SELECT case_id, unnest(documents) AS d, '00' AS k FROM claims UNION ALL SELECT case_id, duplicate_document, '01' FROM claims WHERE duplicate_document IS NOT NULL)
), status AS (SELECT case_id, count(*) AS image_count, count(*) FILTER ({LOST_IMAGES}) AS lost, len(any_value(documents)) - count(DISTINCT d) AS untyped FROM files JOIN claims USING (case_id) GROUP BY 1)"""


@query(f"{CLAIMS}, {STATUS} SELECT case_id, image_count, lost::INT AS n_missing_paths, untyped::INT AS n_missing_types, lost = 0 AND untyped = 0 AS complete FROM status")
def image_status(spark, sf_dir):
    """Whether the images of each claim are all there; a twenty-fifth of the files is not."""
    c = stored(C.claims(spark, sf_dir).select("case_id", "documents", "duplicate_document"))
    r = _records(c)
    s = holdout.image_status(c, r, _files(r))
    return s.select("case_id", "image_count", F.size("missing_paths").alias("n_missing_paths"), F.size("missing_doc_types").alias("n_missing_types"), "complete")


STRATA = ["risk_level", "audit_result", "key", "image_count"]
FINAL = f"""{MANIFEST}, {STATUS}, fresh AS (SELECT p.*, array_to_string(list_sort(anomaly_types), ',') AS key, image_count FROM pool p JOIN status USING (case_id) WHERE lost = 0 AND case_id NOT IN (SELECT case_id FROM manifest)),
turns AS (SELECT *, row_number() OVER (PARTITION BY split, risk_level, audit_result, key, image_count ORDER BY sha256('43:' || case_id), case_id) AS turn FROM fresh),
final AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY split ORDER BY turn, risk_level, audit_result, key, image_count, case_id) <= 60)"""


def _complete(spark, sf_dir, tests: DataFrame) -> DataFrame:
    """The tests whose images are all there, with the parts of their split key; only their answers are made."""
    r = stored(_records(C.claims(spark, sf_dir, tests)))
    s = holdout.image_status(tests, r, _files(r)).where("complete").select("case_id", "image_count")
    return stored(tests.join(s, "case_id").withColumn("key", holdout.split_key()))


@query(f"{FINAL} SELECT split, case_id, turn FROM final")
def final_holdout(spark, sf_dir):
    """60 unused claims with all images of each test split, drawn by turns from their strata."""
    t = split_claims(spark, sf_dir).where(F.col("split").startswith("test_") & ~((F.col("split") == "test_hard_negative") & (F.col("label") == "none")))
    return holdout.final_holdout(_complete(spark, sf_dir, t), _manifest(t), 60, 43, STRATA).select("split", "case_id", F.col("turn").cast("bigint").alias("turn"))


DEV = f"""{SPLITS}, {STATUS}, complete AS (SELECT p.*, array_to_string(list_sort(anomaly_types), ',') AS key, image_count FROM splits p JOIN status USING (case_id) WHERE lost = 0 AND split = 'val_in_template'),
turns AS (SELECT *, row_number() OVER (PARTITION BY risk_level, audit_result, key, image_count ORDER BY sha256('46:' || case_id), case_id) AS turn FROM complete),
one AS (SELECT case_id FROM turns WHERE turn % 2 = 1 AND turn <= 80 ORDER BY turn, risk_level, audit_result, key, image_count, case_id LIMIT 40),
two AS (SELECT case_id FROM turns WHERE turn <= 80 AND case_id NOT IN (SELECT case_id FROM one) ORDER BY turn % 2, turn, risk_level, audit_result, key, image_count, case_id LIMIT 40)"""


@query(f"{DEV} SELECT case_id, 'val_in_template' AS split, 1 AS part FROM one UNION ALL SELECT case_id, 'val_in_template', 2 FROM two")
def development_sets(spark, sf_dir):
    """Two disjoint development sets of 40 validation claims, drawn by turns from their strata."""
    t = split_claims(spark, sf_dir).where("split = 'val_in_template'")
    return holdout.development_sets(_complete(spark, sf_dir, t), {"val_in_template": 40}, STRATA, 46)


@query(f"""{FINAL} SELECT 'manifest_vs_final' AS pair, (SELECT count(*) FROM manifest JOIN final USING (case_id)) AS n UNION ALL SELECT 'tests_vs_final', (SELECT count(*) FROM pool JOIN final USING (case_id)) UNION ALL SELECT 'train_vs_final', 0""")
def holdout_overlaps(spark, sf_dir):
    """Claims that the final holdout shares with other sets."""
    every = split_claims(spark, sf_dir)
    t = every.where(F.col("split").startswith("test_") & ~((F.col("split") == "test_hard_negative") & (F.col("label") == "none")))
    m = stored(_manifest(t))
    f = stored(holdout.final_holdout(_complete(spark, sf_dir, t), m, 60, 43, STRATA))
    return holdout.overlap_counts({"train": every.where("split = 'train'"), "tests": t, "manifest": m, "final": f}, [("manifest", "final"), ("tests", "final"), ("train", "final")])


STEPS = [("a", k, 10 * k, 0.1 * k, 0.02 * ((k * 7) % 5), 1.0 - 0.004 * k, 0.01 * (k % 3)) for k in range(1, 6)]
STEP_ROWS = ", ".join(str(r) for r in STEPS)


@query(f"""WITH s(run, k, step, reward_gain, order_gain, json, esc) AS (VALUES {STEP_ROWS}), e AS (SELECT *, reward_gain >= 0.05 AND order_gain >= 0.04 AND json >= 0.99 AND esc <= 0.01 AS eligible FROM s),
best AS (SELECT * FROM e ORDER BY eligible DESC, CASE WHEN eligible THEN step ELSE 0 END, reward_gain DESC, order_gain DESC, step LIMIT 1)
SELECT step, eligible, (SELECT max_by(reward_gain, step) FROM s)::DOUBLE AS last_reward_gain FROM best""")
def checkpoint_selection(spark, sf_dir):
    """The checkpoint to take from a run's probes, and the run's last record."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("run", "k", "step", "reward_gain", "order_gain", "json", "esc"), r, strict=True))) for r in STEPS))
    s = spark.range(1).select(F.inline(rows)).withColumn("eligible", F.expr("reward_gain >= 0.05 and order_gain >= 0.04 and json >= 0.99 and esc <= 0.01"))
    last = comparison.last_record(s, ["run"], "step").select(F.col("reward_gain").alias("last_reward_gain"))
    return gates.best_checkpoint(s).select("step", "eligible").crossJoin(last)


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'step ' || event_id ELSE json_object('stage', CASE WHEN event_id % 5 = 0 THEN 'dpo_holdout' ELSE 'dpo_train' END, 'run', event_type, 'global_step', event_id, 'value', round(value::DECIMAL(20, 6), 2)::DOUBLE)::VARCHAR END AS line, event_type, value FROM events)
SELECT event_type AS run, CASE WHEN event_id % 5 = 0 THEN 'dpo_holdout' ELSE 'dpo_train' END AS stage, count(*) AS n, max(event_id) AS last_step FROM l WHERE starts_with(line, '{') GROUP BY ALL""")
def training_log(spark, sf_dir):
    """Records of a training log among its other lines: how many of each stage, and the last step."""
    e = C.table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "dpo_holdout").otherwise("dpo_train").alias("stage"), F.col("event_type").alias("run"), F.col("event_id").alias("global_step"), "value"))
    lines = e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("step "), F.col("event_id").cast("string"))).otherwise(record).alias("value"))
    r = logs.records(lines, "stage string, run string, global_step long, value double", ["dpo_train", "dpo_holdout"])
    return r.groupBy("run", "stage").agg(F.count("*").alias("n"), F.max("global_step").alias("last_step"))


WORLD = f"""WITH n AS (SELECT r_name || ' ' || n_name AS name, row_number() OVER (ORDER BY r_name, n_name) - 1 AS k FROM region, nation), nn AS (SELECT count(*) AS c FROM n),
m AS (SELECT n_name || ' ' || brand || ' ' || cat AS canonical, cat, row_number() OVER (PARTITION BY cat ORDER BY n_name, brand) - 1 AS k, count(*) OVER (PARTITION BY cat) AS c FROM nation, (VALUES ('Acme'), ('Orbit')) b(brand), (VALUES ('travel'), ('office'), ('meals')) t(cat)),
g AS (SELECT id, 'MV_GEN_' || lpad(id::VARCHAR, 6, '0') AS case_id, ['travel', 'office', 'meals'][({u('expense')} % 3 + 1)::INT] AS cat, 1000 + {u('money')} % 99001 AS amount, DATE '2026-01-01' + ({u('order')} % 300)::INT AS d0 FROM (SELECT unnest(range(1, 2001)) AS id)),
h AS (SELECT g.*, d0 + ({u('payment')} % 4)::INT AS d1 FROM g), j AS (SELECT h.*, d1 + ({u('invoice')} % 6)::INT AS d2 FROM h)"""


@query(f"""{WORLD} SELECT case_id, n.name AS applicant, m.canonical AS merchant, cat AS expense_type, (amount / 100.0)::DECIMAL(20, 2)::VARCHAR AS invoice_amount, (((amount * 6 + 50) // 100) / 100.0)::DECIMAL(20, 2)::VARCHAR AS tax_amount, 'INV' || strftime(d2, '%Y%m%d') || lpad(id::VARCHAR, 6, '0') AS invoice_id,
  d2 + ({u('application')} % 15)::INT AS application_date FROM j JOIN n ON n.k = {u('person')} % (SELECT c FROM nn) JOIN m USING (cat) WHERE m.k = {u('merchant')} % m.c""")
def generated_cases(spark, sf_dir):
    """2000 claims generated from dictionaries: names and merchants as products of lists, money and dates by draws."""
    t = lambda n: C.table(spark, sf_dir, n)
    names = generator.names(t("region").select(F.col("r_name").alias("surname")), t("nation").select(F.col("n_name").alias("given")), " ")
    merchants = generator.merchants(t("nation").select(F.col("n_name").alias("city")), ["Acme", "Orbit"], [("{city} {brand} {category}", ["{brand} {category}"], ["travel", "office", "meals"])])
    kinds = [("travel", 10.0, 1000.0), ("office", 10.0, 1000.0), ("meals", 10.0, 1000.0)]
    return generator.cases(spark, 2000, names, merchants, kinds, "MV_GEN", "2026-01-01", 300).select("case_id", "applicant", "merchant", "expense_type", "invoice_amount", "tax_amount", "invoice_id", "application_date")


@query(f"{SPLITS}, ids AS (SELECT split, case_id, substr(sha256(case_id), 1, 3) AS head FROM splits), b AS (SELECT split, head, count(*) AS n, sha256(string_agg(case_id, chr(10) ORDER BY case_id) || chr(10)) AS digest FROM ids GROUP BY ALL) SELECT split, sum(n)::BIGINT AS n, sha256(string_agg(head || ' ' || digest || chr(10), '' ORDER BY head)) AS digest FROM b GROUP BY 1")
def split_digests(spark, sf_dir):
    """A digest of each split's ids that does not depend on their order."""
    return holdout.id_digest(splits.assign_splits(C.labels(spark, sf_dir)), ["split"], "case_id")


@query(f"{CLAIMS} SELECT v AS why, count(*) AS n FROM (SELECT CASE id % 5 WHEN 0 THEN 'not_text' WHEN 1 THEN 'not_number' WHEN 2 THEN CASE WHEN invoice_amount > 0 THEN 'negative' END WHEN 3 THEN 'too_precise' END AS v FROM claims) GROUP BY 1")
def money_errors(spark, sf_dir):
    """Why texts are no money values: amounts that are left out, spoilt, negative or too precise."""
    text = O.field_text("invoice_amount")
    k = F.col("id") % 5
    said = F.when(k == 1, F.concat(text, F.lit("x"))).when(k == 2, F.concat(F.lit("-"), text)).when(k == 3, F.concat(text, F.lit("1"))).when(k == 4, text)
    return C.claims(spark, sf_dir).select(said.alias("money")).groupBy(why_no_money("money").alias("why")).agg(F.count("*").alias("n"))
