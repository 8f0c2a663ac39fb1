"""Queries on registries, audits, lineage, losses, boxes, JSON and progress events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .entry import query
from .functions.exprs import dpo_loss, draw, iou, ipo_loss, relaxed_match, scaled_box, strict_match
from .functions.tolerant_json import extract_json
from .operators import audits, holdout, ranking
from .plans.claims import table
from .sql import u
from .streaming import progress


@query("""WITH ids AS (SELECT 'orders' AS source, o_custkey::VARCHAR AS id FROM orders UNION SELECT 'events', user_id::VARCHAR FROM events UNION SELECT 'customer', c_custkey::VARCHAR FROM customer),
b AS (SELECT source, substr(sha256(id), 1, 3) AS head, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10)) AS digest FROM ids GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(head || ' ' || digest || chr(10), '' ORDER BY head)) AS digest FROM b GROUP BY source""")
def used_id_registry(spark, sf_dir):
    """Distinct ids of each source, and a digest of them that does not depend on their order."""
    return holdout.id_digest(_registry(spark, sf_dir), ["source"])


def _registry(spark, sf_dir):
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k"))
    return audits.registry({"orders": t("orders", "o_custkey"), "events": t("events", "user_id"), "customer": t("customer", "c_custkey")}, "k")


@query("""WITH ids AS (SELECT 'orders' AS source, o_custkey AS id FROM orders UNION SELECT 'events', user_id FROM events UNION SELECT 'customer', c_custkey FROM customer)
SELECT x.source AS a, y.source AS b, count(*) AS n FROM ids x JOIN ids y USING (id) WHERE x.source < y.source GROUP BY ALL""")
def overlap_matrix(spark, sf_dir):
    """Ids that two sources share."""
    return audits.overlap_matrix(_registry(spark, sf_dir))


SHARDS = f"""WITH e AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY sha256('5:' || o_orderkey), o_orderkey) - 1) % 5 AS shard FROM orders),
got AS (SELECT k FROM e WHERE NOT (shard = 3 AND {u('lost', 'k')} % 50 = 0) UNION ALL SELECT k FROM e WHERE shard = 1 AND {u('twice', 'k')} % 40 = 0 UNION ALL SELECT -1)"""


def _shards(spark, sf_dir):
    e = ranking.sharded(ranking.global_rank(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k", 5), "rank", 5)
    lost = (F.col("shard") == 3) & (draw("k", "lost") % 50 == 0)
    again = e.where((F.col("shard") == 1) & (draw("k", "twice") % 40 == 0))
    return e.select("k"), e.where(~lost).select("k").union(again.select("k")).union(spark.range(1).select(F.lit(-1).cast("bigint")))


@query(f"""{SHARDS}, n AS (SELECT k, count(*) AS n FROM got GROUP BY k)
SELECT count(*) FILTER (n.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated, sum(n)::BIGINT AS rows FROM e FULL JOIN n ON e.k = n.k""")
def shard_merge_audit(spark, sf_dir):
    """Missing, extra and repeated keys of five shards that lost, gained and repeated some."""
    return audits.merge_audit(*_shards(spark, sf_dir), "k")


@query(f"{SHARDS} SELECT k FROM e WHERE k NOT IN (SELECT k FROM got)")
def resume_pending(spark, sf_dir):
    """Keys that are still to be done."""
    return audits.pending(*_shards(spark, sf_dir), "k")


MODELS = [("m0", None), ("m2", "m0"), ("m3", "m2"), ("r1", "m2"), ("r3", "r1"), ("v3", "r3"), ("lost", "gone")]


@query(f"""WITH RECURSIVE m(model_id, parent) AS (VALUES {', '.join(f"('{a}', {f"'{b}'" if b else 'NULL'})" for a, b in MODELS)}),
up AS (SELECT model_id, 0 AS depth FROM m WHERE parent IS NULL OR parent NOT IN (SELECT model_id FROM m) UNION ALL SELECT m.model_id, depth + 1 FROM m JOIN up ON m.parent = up.model_id)
SELECT up.model_id, depth, coalesce(parent NOT IN (SELECT model_id FROM m), false) AS orphan FROM up JOIN m USING (model_id)""")
def lineage(spark, sf_dir):
    """Depth of each model below its root, and whether its parent is unknown."""
    rows = F.array(*(F.struct(F.lit(a).alias("model_id"), F.lit(b).cast("string").alias("parent_model_id")) for a, b in MODELS))
    m = spark.range(1).select(F.inline(rows))
    lost = audits.orphans(m).select("model_id", F.lit(True).alias("orphan"))
    return audits.ancestry(m).join(lost, "model_id", "left").select("model_id", "depth", F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query("""SELECT event_type, count(*) AS n, round(avg(ln(1 + exp(-0.1 * value))), 9) AS dpo, round(avg(power(value - 5, 2)), 6) AS ipo FROM (SELECT event_type, value / 10 AS value FROM events) GROUP BY 1""")
def preference_loss(spark, sf_dir):
    """Mean DPO and IPO losses of margins, by event type."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 10).alias("m"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(dpo_loss("m", 0.1)), 9).alias("dpo"), F.round(F.avg(ipo_loss("m", 0.1)), 6).alias("ipo"))


BOX = "least(1000, greatest(0, round_even({0} * 1000.0 / {1}, 0)))::INT"


@query(f"""WITH b AS (
  SELECT l_orderkey % 300 AS x, l_partkey % 300 AS y, l_quantity::INT AS w, l_suppkey % 40 AS dx, l_linenumber * 5 AS dy FROM lineitem
), s AS (
  SELECT {BOX.format('x', 400)} AS t0, {BOX.format('y', 500)} AS t1, {BOX.format('(x + w)', 400)} AS t2, {BOX.format('(y + 20)', 500)} AS t3,
    {BOX.format('(x + dx)', 400)} AS p0, {BOX.format('(y + dy)', 500)} AS p1, {BOX.format('(x + dx + w)', 400)} AS p2, {BOX.format('(y + dy + 20)', 500)} AS p3 FROM b
), i AS (SELECT *, greatest(0, least(p2, t2) - greatest(p0, t0)) * greatest(0, least(p3, t3) - greatest(p1, t1)) AS inter FROM s),
o AS (SELECT *, coalesce(inter::DOUBLE / nullif((p2 - p0) * (p3 - p1) + (t2 - t0) * (t3 - t1) - inter, 0), 0) AS iou FROM i)
SELECT count(*) AS n, count(*) FILTER (iou >= 0.5) AS strict, count(*) FILTER (iou >= 0.3 OR (p0 + p2) / 2.0 BETWEEN t0 AND t2 AND (p1 + p3) / 2.0 BETWEEN t1 AND t3) AS relaxed, round(avg(iou), 9) AS mean_iou FROM o""")
def bbox_match(spark, sf_dir):
    """Strict and relaxed matches of shifted boxes."""
    x, y, w, dx, dy = (F.col("l_orderkey") % 300, F.col("l_partkey") % 300, F.col("l_quantity").cast("int"), F.col("l_suppkey") % 40, F.col("l_linenumber") * 5)
    box = lambda a, b: F.array(scaled_box(a, 400), scaled_box(b, 500), scaled_box(a + w, 400), scaled_box(b + 20, 500))
    b = table(spark, sf_dir, "lineitem").select(box(x, y).alias("t"), box(x + dx, y + dy).alias("p"))
    t, p = F.col("t"), F.col("p")
    return b.agg(F.count("*").alias("n"), F.count_if(strict_match(p, t)).alias("strict"), F.count_if(relaxed_match(p, t)).alias("relaxed"), F.round(F.avg(iou(p, t)), 9).alias("mean_iou"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def json_validity(spark, sf_dir):
    """k of each event's props, written plainly, fenced, cut short, or with words around it."""
    raw = F.col("props")
    mutated = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), raw, F.lit("\n```"))).when(
        F.col("event_id") % 4 == 2, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 4 == 3, F.concat(F.lit("answer {x "), raw, F.lit(" done"))).otherwise(raw)
    found = extract_json(mutated)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("bigint").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL")
def progress_throughput(spark, sf_dir):
    """Events by day and type."""
    return progress.throughput(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def progress_sessions(spark, sf_dir):
    """Sessions of each user, 30 minutes apart."""
    return progress.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL""")
def progress_dedup(spark, sf_dir):
    """The first event of each user and type."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "user_id", "event_type", "ts")
    return progress.first_per_key(e, "key").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("first_ts"))
