"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, conversation_repair, decontam, html_gbt, jaccard, line_rules, phrases, quality_mil, secret_scan, sentencepiece_codec, simhash, toxicity, url_rules
from .common import table


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    return quality_mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, as counts and digests."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url."""
    return url_rules.judge(table(spark, sf_dir, "pages")).drop("url")


def op6_html_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_gbt.extract(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, as counts and digests."""
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that an earlier one holds."""
    return phrases.digest(phrases.remove_repeats(table(spark, sf_dir, "documents")))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return line_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of similar documents of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that hold together best."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_mil, op2_secret_scan, op3_decontam, op4_toxicity, op5_url_rules, op6_html_gbt, op7_sentencepiece, op8_simhash, op9_phrases, op10_line_rules, op11_jaccard, op12_conversation_repair, op13_collocations)
}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule_host, rule_path, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), one AS (SELECT row_number() OVER () AS k, * FROM h), best AS (
  SELECT k, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(v, length(rule_host || rule_path)) AS v
  FROM one JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM one LEFT JOIN best USING (k)
"""

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {WORDS} AS w FROM documents
), win AS (
  SELECT k, i, w[i : i + 7] AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS t(i)
), twice AS (
  SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), rep AS (
  SELECT k, count(DISTINCT i + o) AS n FROM twice, range(0, 8) AS t(o) GROUP BY k
), l AS (
  SELECT k, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), ln AS (
  SELECT k, host, line, pos, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT k, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY k
), hs AS (
  SELECT k, host, pos, ('0x' || substr(md5(plain), 1, 15))::BIGINT AS h, len(string_split(plain, ' ')) AS n FROM ln
), whole AS (
  SELECT k, string_agg(h::VARCHAR, ',' ORDER BY pos) AS lines FROM hs GROUP BY k
), freq AS (
  SELECT host, h FROM (SELECT host, h, count(DISTINCT lines) AS n FROM hs JOIN whole USING (k) GROUP BY host, h)
  JOIN (SELECT host, count(*) AS n_host FROM d GROUP BY host) USING (host) WHERE n > 30 AND n > n_host * 0.001
), gone AS (
  SELECT k, sum(n) AS n FROM hs JOIN freq USING (host, h) GROUP BY k
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone USING (k)
), v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
       NOT base_failed AND NOT (n_line_words >= n_words * 0.5 AND n_words - n_line_words < 20) AS kept
FROM v
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT k, array_to_string(w[i : i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), both_ AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(k, to_) AS (
  SELECT k, k FROM d UNION SELECT reach.k, edge.b FROM reach JOIN edge ON reach.to_ = edge.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM d LEFT JOIN n USING (k) JOIN reach USING (k) JOIN d t ON t.k = reach.to_ GROUP BY d.k, d.doc_id, n.n
"""

OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d), g AS (
  SELECT lang, m, w[i : i + m - 1] AS ws, count(*) AS f FROM p, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 6)) AS u(m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), freq AS (SELECT * FROM g WHERE f >= 100), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang), cut AS (
  SELECT c.lang, c.ws, c.f AS a, k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.f * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM freq c JOIN n USING (lang), unnest(range(1, c.m)) AS t(k), freq x, freq y
  WHERE c.m > 1 AND x.lang = c.lang AND x.ws = c.ws[1 : k] AND y.lang = c.lang AND y.ws = c.ws[k + 1 : c.m]
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1), free AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM freq q WHERE q.lang = best.lang AND q.m > len(best.ws) AND 100 * q.f >= 100 * best.a
    AND contains(' ' || array_to_string(q.ws, ' ') || ' ', ' ' || array_to_string(best.ws, ' ') || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score
FROM free QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op13_collocations": OP13_SQL, "op11_jaccard": OP11_SQL, "op5_url_rules": OP5_SQL, "op10_line_rules": OP10_SQL}
