"""Queries on validation by schema, training rows, weights, digests, checkpoints and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entry import query
from .functions.exprs import draw, money_text
from .operators import audits, comparison, gates, holdout, pairs, ranking, repair, rewards, splits, strict_joins, validation
from .plans import claims as C
from .plans import outputs as O
from .queries_pairs import MANIFEST, MINED, PACK, PAIRS, mined, repair_sets, split_claims, weighed_candidates
from .sql import CLAIMS, SPLITS, u

DAMAGES = 11


def _case_texts(spark, sf_dir) -> DataFrame:
    """Claims as JSON cases, nine of eleven with one thing changed: in a value, or in the text."""
    d = draw("case_id", "case_damage") % DAMAGES
    of = lambda k, value, plain: F.when(d == k, value).otherwise(plain)
    money = {c: money_text(c) for c in validation.AMOUNTS}
    text = F.to_json(F.struct(
        "case_id", "applicant", of(1, F.lit(""), F.col("payer")).alias("payer"), "order_user", F.col("merchant").alias("merchant_canonical"), "invoice_merchant", "payment_merchant", "order_merchant", F.col("aliases").alias("merchant_aliases"), "expense_type",
        of(0, F.translate(money["invoice_amount"], ".", ","), money["invoice_amount"]).alias("invoice_amount"), *(money[c].alias(c) for c in validation.AMOUNTS[1:]), F.col("order_date").cast("string").alias("order_date"),
        of(4, F.lit("2024-02-30"), F.col("payment_date").cast("string")).alias("payment_date"), F.col("invoice_date").cast("string").alias("invoice_date"), F.col("application_date").cast("string").alias("application_date"), "invoice_id", "order_id", "payment_id",
        of(2, F.concat("documents", F.slice("documents", 1, 1)), F.col("documents")).alias("documents"), F.col("label").alias("primary_anomaly_type"), "anomaly_types", "evidence_sufficient", of(3, F.upper("risk_level"), F.col("risk_level")).alias("risk_level"), "audit_result",
        F.struct(F.lit("s").alias("split_name"), F.lit("orders").alias("source"), F.lit("train").alias("template_group"), F.lit(42).alias("seed")).alias("metadata"),
    ))
    changed = F.when(d == 5, F.replace(text, F.lit('"evidence_sufficient":'), F.lit('"evidence_sufficient":[],"was":'))).when(d == 6, F.replace(text, F.lit('"seed":42'), F.lit('"seed":4.2'))).when(
        d == 7, F.replace(text, F.lit('"source":"orders",'), F.lit(""))).when(d == 8, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    return C.claims(spark, sf_dir).select("case_id", changed.alias("text"))


def _case_sql() -> str:
    """The texts again, and every rule of the schema over their values, by path."""
    money = lambda c: f"({c} / 100.0)::DECIMAL(20, 2)::VARCHAR"
    d = f"({u('case_damage', 'case_id')} % {DAMAGES})"
    value = {
        "payer": f"CASE WHEN {d} = 1 THEN '' ELSE payer END", "merchant_canonical": "merchant", "merchant_aliases": "aliases", **{c: money(c) for c in validation.AMOUNTS}, **{c: f"{c}::VARCHAR" for c in validation.DATES},
        "primary_anomaly_type": "label", "documents": f"CASE WHEN {d} = 2 THEN documents || documents[1:1] ELSE documents END", "risk_level": f"CASE WHEN {d} = 3 THEN upper(risk_level) ELSE risk_level END",
        "metadata": "json_object('split_name', 's', 'source', 'orders', 'template_group', 'train', 'seed', 42)",
    }
    value["invoice_amount"] = f"CASE WHEN {d} = 0 THEN replace({money('invoice_amount')}, '.', ',') ELSE {money('invoice_amount')} END"
    value["payment_date"] = f"CASE WHEN {d} = 4 THEN '2024-02-30' ELSE payment_date::VARCHAR END"
    names = list(validation.case_schema()["properties"])
    made = "json_object(" + ", ".join(f"'{n}', {value.get(n, n)}" for n in names) + ")::VARCHAR"
    changed = f"""CASE {d} WHEN 5 THEN replace(t, '"evidence_sufficient":', '"evidence_sufficient":[],"was":') WHEN 6 THEN replace(t, '"seed":42', '"seed":4.2') WHEN 7 THEN replace(t, '"source":"orders",', '') WHEN 8 THEN substr(t, 1, length(t) - 5) ELSE t END"""

    def rule(path: str, part: dict) -> list[str]:
        at, name = f"j->'{path}'", path.removeprefix("$.")
        kind, own = f"json_type({at})", f"json_extract_string(j, '{path}')"
        when = lambda c, what: f"CASE WHEN {c} THEN '{name}: {what}' END"
        if part["type"] == "string":
            out = [when(f"{kind} <> 'VARCHAR'", "not a text")]
            out += [when(f"{own} NOT IN ({', '.join(repr(x) for x in part['enum'])})", "not one of " + ", ".join(part["enum"]))] if "enum" in part else []
            out += [when(f"length({own}) < 1", "empty")] if "minLength" in part else []
            return out + ([when(f"NOT regexp_matches({own}, '{part['pattern']}')", f"not like {part['pattern']}")] if "pattern" in part else [])
        if part["type"] == "array":
            own = f"({at})::VARCHAR[]"
            size = [when(f"len({own}) NOT BETWEEN {part['minItems']} AND {part['maxItems']}", f"not {part['minItems']} to {part['maxItems']} items")] if "minItems" in part else []
            return [when(f"{kind} <> 'ARRAY'", "not a list"), *size, when(f"len(list_distinct({own})) < len({own})", "repeated items")]
        if part["type"] == "object":
            return [when(f"NOT json_exists(j, '{path}.{n}')", f"lacks {n}") for n in part["required"]] + [r for n in sorted(part["properties"]) for r in rule(f"{path}.{n}", part["properties"][n])]
        return [when(f"{kind} <> 'BOOLEAN'", "not a boolean")] if part["type"] == "boolean" else [when(f"{kind} NOT IN ('BIGINT', 'UBIGINT')", "not an integer")]

    schema = validation.case_schema()
    listed = ", ".join(f"'{n}'" for n in names)
    root = [f"CASE WHEN NOT json_exists(j, '$.{n}') THEN '<root>: lacks {n}' END" for n in names] + [f"'<root>: has ' || list_sort(list_filter(json_keys(j), lambda k: k NOT IN ({listed})))[1]"]
    by_path = root + [r for n in sorted(names) for r in rule(f"$.{n}", schema["properties"][n])]
    text = lambda n: f"json_extract_string(j, '$.{n}')"
    dates = [f"CASE WHEN try_strptime({text(n)}, '%Y-%m-%d') IS NULL THEN '{n}: no date' END" for n in validation.DATES]
    normal = lambda c, what: f"CASE WHEN {text('primary_anomaly_type')} = 'none' AND ({c}) THEN '<root>: {what}' END"
    differ = lambda ns: " OR ".join(f"{text(a)} <> {text(b)}" for a, b in zip(ns, ns[1:]))  # noqa: E731, B905
    later = dates + [
        normal(differ(validation.AMOUNTS[:4]), "amounts of a normal case differ"), normal(differ(validation.PEOPLE[:3]), "persons of a normal case differ"),
        normal(" OR ".join(f"{text(a)} > {text(b)}" for a, b in zip(validation.DATES, validation.DATES[1:])), "dates of a normal case are out of order"), normal("len((j->'$.anomaly_types')::VARCHAR[]) > 0", "a normal case has anomalies"),  # noqa: B905
        normal(f"{text('risk_level')} <> 'low' OR {text('audit_result')} <> 'pass'", "a normal case is not low and passed"), normal(f"{text('evidence_sufficient')} <> 'true'", "a normal case lacks evidence"),
    ]
    first = lambda rules: f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)[1]"
    return f"""{CLAIMS}, made AS (SELECT case_id, {made} AS t FROM claims), texts AS (SELECT case_id, {changed} AS t FROM made), parsed AS (SELECT case_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM texts)
SELECT error, count(*) AS n FROM (SELECT CASE WHEN j IS NULL THEN '<root>: no JSON' ELSE coalesce({first(by_path)}, {first(later)}) END AS error FROM parsed) GROUP BY 1"""


@query(_case_sql())
def case_schema_errors(spark, sf_dir):
    """The first error of each case, by its schema or else by its rules, and how many have it; null for good ones."""
    t = _case_texts(spark, sf_dir).select(F.get(validation.case_errors("text"), F.lit(0)).alias("error"))
    return t.groupBy("error").agg(F.count("*").alias("n"))


@query(f"""{MINED} SELECT count(*) AS examples, round(avg(chosen_reward), 9) AS mean_chosen, round(avg(rejected_reward), 9) AS mean_rejected, round(avg(gap), 9) AS mean_reward_gap, round(count(*) FILTER (gap > 0) / count(*), 9) AS positive_reward_gap_rate FROM parted""")
def preference_summary(spark, sf_dir):
    """Mean rewards of both sides of the mined pairs, their mean gap and the share of positive gaps."""
    a = rewards.preference_audit(mined(spark, sf_dir))
    return a.select("examples", *(F.round(c, 9).alias(c) for c in a.columns[1:]))


@query(f"""{PAIRS}, w AS (SELECT case_id, pair_type, least(3.0, severity * hardness * reliability) AS final_weight, {u('batch', 'case_id')} % 997 AS batch FROM weighed), m AS (SELECT batch, greatest(avg(final_weight), 1e-6) AS mean FROM w GROUP BY 1)
SELECT case_id, pair_type, batch, round(final_weight / mean, 9) AS weight FROM w JOIN m USING (batch)""")
def batch_weights(spark, sf_dir):
    """Weights of candidate pairs, each divided by the mean of its batch."""
    p = weighed_candidates(spark, sf_dir).select("case_id", "pair_type", "final_weight", (draw("case_id", "batch") % 997).alias("batch"))
    return rewards.batch_weights(p, ["batch"]).select("case_id", "pair_type", "batch", F.round("weight", 9).alias("weight"))


@query(f"""{CLAIMS} SELECT risk_level, audit_result, array_to_string(anomaly_types, ',') AS anomalies, label IN ('order_id_mismatch', 'duplicate_in_batch') AND list_contains(documents, 'order') AND list_contains(documents, 'reimbursement_form') AND NOT list_contains(unreadable_fields, 'order_id') AS two_sided, count(*) AS n
FROM claims GROUP BY ALL""")
def decision_views(spark, sf_dir):
    """What a case study shows of the answers: decisions, anomalies, and whether both order ids are in the evidence."""
    v = O.answers(C.claims(spark, sf_dir)).select(comparison.decision_view(F.col("answer")).alias("v"))
    return v.groupBy("v.risk_level", "v.audit_result", F.array_join("v.anomaly_types", ",").alias("anomalies"), F.col("v.has_two_sided_order_id_evidence").alias("two_sided")).agg(F.count("*").alias("n"))


@query(f"""{PACK}, pack_facts AS (SELECT count(*) AS rows, count(*) - count(DISTINCT case_id) AS repeated, count(*) FILTER (case_id IN (SELECT case_id FROM rows_of WHERE split <> 'train')) + count(*) FILTER (case_id IN (SELECT case_id FROM rows_of WHERE {u('used', 'case_id')} % 20 = 0)) AS leaks,
  count(*) FILTER (case_id NOT IN (SELECT case_id FROM rows_of WHERE split = 'train')) AS not_train FROM pack), updates AS (SELECT *, ceil(rows / 8.0) * 3.0::DOUBLE AS u, [CASE WHEN repeated > 0 THEN 'REPAIR_DATA_DUPLICATE_IDS' END, CASE WHEN leaks > 0 THEN 'REPAIR_DATA_LEAKAGE' END, CASE WHEN not_train > 0 THEN 'REPAIR_DATA_NOT_TRAIN_ONLY' END] AS f FROM pack_facts)
SELECT CASE WHEN len(list_filter(f, lambda x: x IS NOT NULL)) = 0 THEN 'READY' ELSE 'NOT_READY' END AS status, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS hard_failures, u AS optimizer_updates, u BETWEEN 30 AND 60 AS in_target_range FROM updates""")
def repair_preflight(spark, sf_dir):
    """Whether the repair pack can be trained on, why not, and how many updates three epochs would be."""
    audit, n = repair_sets(spark, sf_dir)
    return repair.preflight(audit, n, world=1, batch=2, accumulate=4, epochs=3).withColumn("hard_failures", F.array_join("hard_failures", ","))


@query(f"""{CLAIMS}, l AS (SELECT case_id, label, documents, {u('lost', 'case_id')} % 6 AS k FROM claims),
r AS (SELECT label, CASE k WHEN 0 THEN ' ' ELSE 'prompt' END AS prompt, CASE k WHEN 1 THEN NULL ELSE 'chosen' END AS chosen, CASE k WHEN 2 THEN '' ELSE 'rejected' END AS rejected, CASE k WHEN 3 THEN [] ELSE documents END AS images FROM l)
SELECT label, count(*) AS n FROM r WHERE trim(prompt) <> '' AND trim(chosen) <> '' AND trim(rejected) <> '' AND len(images) > 0 GROUP BY 1""")
def trainable_rows(spark, sf_dir):
    """How many rows of each label can train, as neither texts nor images are missing."""
    k = draw("case_id", "lost") % 6
    r = C.claims(spark, sf_dir).select(
        "label", F.when(k == 0, " ").otherwise("prompt").alias("prompt"), F.when(k != 1, "chosen").alias("chosen"), F.when(k == 2, "").otherwise("rejected").alias("rejected"), F.when(k == 3, F.array().cast("array<string>")).otherwise(F.col("documents")).alias("images"))
    return pairs.trainable(r).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{CLAIMS} SELECT case_id FROM claims ORDER BY sha256('77:' || case_id), case_id LIMIT 25")
def sampled_claims(spark, sf_dir):
    """25 claims in hash order."""
    return repair.sampled(C.claims(spark, sf_dir).select("case_id"), "case_id", 25, 77)


@query(f"""{SPLITS} SELECT split, count(*) AS n, sha256(string_agg(case_id, chr(10) ORDER BY case_id) || chr(10)) AS digest FROM splits GROUP BY 1""")
def split_registry(spark, sf_dir):
    """The SHA-256 of each split's sorted ids, a line each."""
    return holdout.registry_digest(splits.assign_splits(C.labels(spark, sf_dir)), ["split"], "case_id")


PROBES = "SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS step, event_type, value, event_id FROM events"


@query(f"""WITH p AS ({PROBES}), s AS (SELECT step, (avg(value::DECIMAL(20, 4)) / 100)::DOUBLE AS reward_gain, count(*) FILTER (event_type = 'purchase') / count(*) AS order_gain FROM p GROUP BY 1),
e AS (SELECT *, round(reward_gain, 6) >= 0.5 AND round(order_gain, 6) >= 0.21 AS eligible FROM s), best AS (SELECT * FROM e ORDER BY eligible DESC, CASE WHEN eligible THEN step ELSE 0 END, round(reward_gain, 6) DESC, round(order_gain, 6) DESC, step LIMIT 1)
SELECT step, eligible, round(reward_gain, 6) AS reward_gain, round(order_gain, 6) AS order_gain FROM best""")
def event_checkpoint(spark, sf_dir):
    """The day to take as the checkpoint: the earliest with enough reward and orders, else the best."""
    s = _probes(spark, sf_dir).groupBy("step").agg(F.round(F.avg("value") / 100, 6).alias("reward_gain"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("order_gain"))
    s = s.withColumn("eligible", (F.col("reward_gain") >= 0.5) & (F.col("order_gain") >= 0.21))
    return gates.best_checkpoint(s).select("step", "eligible", "reward_gain", "order_gain")


@query(f"""WITH p AS ({PROBES}) SELECT step, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value, count(*) AS n FROM p GROUP BY 1, 2""")
def checkpoint_history(spark, sf_dir):
    """The last record of each day and event type, with how many there were."""
    p = _probes(spark, sf_dir)
    last = comparison.last_record(p, ["step", "event_type"], "event_id")
    return last.join(p.groupBy("step", "event_type").agg(F.count("*").alias("n")), ["step", "event_type"]).select("step", "event_type", "event_id", "value", "n")


def _probes(spark, sf_dir) -> DataFrame:
    e = C.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value", "event_id")
    first = e.agg(F.min("day").alias("first"))
    return e.crossJoin(F.broadcast(first)).select(F.date_diff("day", "first").cast("bigint").alias("step"), "event_type", "value", "event_id")


TREE = f"SELECT c_custkey AS model_id, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS parent FROM customer WHERE {u('gone', 'c_custkey')} % 50 <> 0"


@query(f"""WITH RECURSIVE m AS MATERIALIZED ({TREE}), up AS (SELECT model_id, 0::BIGINT AS depth FROM m WHERE parent IS NULL OR parent NOT IN (SELECT model_id FROM m) UNION ALL SELECT m.model_id, depth + 1 FROM m JOIN up ON m.parent = up.model_id)
SELECT up.model_id, depth, coalesce(parent NOT IN (SELECT model_id FROM m), false) AS orphan FROM up JOIN m USING (model_id)""")
def customer_lineage(spark, sf_dir):
    """Customers as a tree of referrals with some gone: the depth of each below its root, and whether its referrer is unknown."""
    m = C.table(spark, sf_dir, "customer").where(draw("c_custkey", "gone") % 50 != 0).select(F.col("c_custkey").alias("model_id"), F.when(F.col("c_custkey") >= 3, F.expr("c_custkey div 3")).alias("parent_model_id"))
    lost = audits.orphans(m).select("model_id", F.lit(True).alias("orphan"))
    return audits.ancestry(m).join(lost, "model_id", "left").select("model_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query("""WITH q AS (SELECT p_partkey, sum(p_size % 9) OVER (ORDER BY p_partkey) AS hi, p_size % 9 AS quota FROM part), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('55:' || o_orderkey), o_orderkey) AS rank FROM orders)
SELECT o_orderkey, p_partkey FROM o JOIN q ON rank > hi - quota AND rank <= hi""")
def orders_by_quota(spark, sf_dir):
    """Orders in hash order, dealt to parts that take as many as their quota says: a join of ranks with as many ranges as there are parts."""
    parts = C.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9).cast("bigint").alias("quota"))
    ranges = ranking.running_total(parts, "p_partkey", "quota", "hi").select("p_partkey", (F.col("hi") - F.col("quota")).alias("lo"), "hi")
    ranked = ranking.global_rank(C.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 55)
    return ranking.by_ranges(ranked, ranges, width=1000).select("o_orderkey", "p_partkey")


@query(f"""{MANIFEST} SELECT (row_number() OVER (PARTITION BY m.split ORDER BY m.id) - 1)::INT AS sample_index, m.split, m.case_id, c.expense_type, c.invoice_amount, len(c.documents)::INT AS n_documents FROM manifest m JOIN claims c USING (case_id)""")
def manifest_cases(spark, sf_dir):
    """The claims that the holdout manifest lists, in its order; one that is not there would be an error."""
    m = holdout.stratified_manifest(split_claims(spark, sf_dir).where(F.col("split").startswith("test_")), 40, 42).select("sample_index", "split", "case_id")
    c = C.claims(spark, sf_dir).select("case_id", "expense_type", "invoice_amount", F.size("documents").alias("n_documents"))
    return strict_joins.in_manifest_order(m, c, "case_id", by=["split"])
