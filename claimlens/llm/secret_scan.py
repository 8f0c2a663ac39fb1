"""Secret scans: three fixed patterns and a character Markov model (native).

The model is a first-order Markov chain over ALPHABET for each of two classes, random strings and
ordinary identifiers, and a candidate's score is the log-likelihood ratio of the two. Labelled
samples: random strings are digests in several encodings; identifiers are made of the words of
IDENTIFIER_DOCS documents (a bound on the sample, chosen by a hash of the text), alone and joined
in the usual styles. Training is one aggregate, and the table of ratios, of fixed size, enters the
scan as a scalar subquery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, text_of, words

#: The patterns of the contract, with the least length of what counts.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
#: The longest alternative of a run of hex digits that can count.
HEX_LONG = "[0-9a-f]{24,}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}+"
N = len(ALPHABET) + 1
#: Labelled samples of the model: random strings, and documents whose words make identifiers.
RANDOM_STRINGS, IDENTIFIER_DOCS = 8000, 2000
#: A candidate counts from this log-likelihood ratio per transition on.
MIN_RATIO = 0.6

#: Characters of a part of a text, from which pieces between secrets are cut.
PART = 1024
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(steps: Column, use=lambda a, b: a + b, block: int = 128) -> Column:
    """Sums (or what `use` makes of 0 and up) of an array of integers up to each place.

    Arrays grow by copies, so sums run within blocks, and over blocks.
    """
    add = lambda values, first: F.aggregate(
        values, F.struct(first.alias("sum"), F.array().cast("array<int>").alias("all")), lambda a, v: let(use(a["sum"], v), lambda s: F.struct(s.alias("sum"), F.array_append(a["all"], s).alias("all"))), lambda a: a["all"])

    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, b: use(a, b)))
        before = let(add(totals, F.lit(0)), lambda t: F.concat(F.array(F.lit(0)), t))
        return let(before, lambda first: F.flatten(F.transform(parts, lambda p, k: add(p, F.get(first, k)))))

    starts = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(block))
    return let(steps, lambda s: let(F.transform(starts, lambda k: F.slice(s, k + 1, F.lit(block))), over))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """SPAN of the matches that keep(match, group 2 or match) accepts, in text order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    #: What stands between matches, with the matches, gives the offsets.
    parts = F.struct(found.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))

    def walk(x: Column) -> Column:
        none = F.array().cast(SPAN)
        n = F.size(x["m"])
        steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.length(F.get(x["gap"], i)) + F.length(F.get(x["m"], i)))
        span = lambda ends: F.transform(ends, lambda e, i: F.when(keep(F.get(x["v"], i)), F.struct((e - F.length(F.get(x["m"], i))).alias("start"), F.lit(kind).alias("kind"), e.alias("end"))))
        return F.when(n > 0, F.array_compact(let(running(steps), span)).cast(SPAN)).otherwise(none)

    return let(parts, walk)


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    assign = F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, lambda v: F.length(v) >= 20)).otherwise(none)
    hexes = F.when(text.rlike(HEX_LONG), _spans(text, HEX_LONG, 2, lambda v: F.length(v) >= 24)).otherwise(none)
    return F.sort_array(F.concat(assign, access, hexes))


def _pairs(text: Column) -> Column:
    """Codes of neighbouring characters as a * N + b; one walk over the text."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    both = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x * N + y)
    return F.when(F.length(text) > 1, let(codes, both))


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    return spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 4 == 1, raw)
        .when(F.col("id") % 4 == 2, F.translate(raw, "+/=", ""))
        .otherwise(F.concat(F.lit("AKIA"), F.upper(F.translate(raw, "+/=", ""))))
        .alias("s")
    )


def identifiers(documents: DataFrame, n_docs: int) -> DataFrame:
    """Words of about n_docs documents, joined in snake, kebab, camel, path and numbered style.

    A document is in the sample if its hash falls under a threshold set from the number of documents (a copy counts by its
    own id), so the choice is made while reading and nothing is sorted or sent to one task.
    """
    each = max(1, documents.count() // max(n_docs, 1))
    few = documents.select(text_of("text").alias("text"), F.col("doc_id")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(each)) == 0).select("text")
    plain = few.select(F.transform(words(F.col("text")), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")).alias("w"))
    runs = plain.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)), F.lit(3)), lambda i: F.slice("w", i, F.lit(3)))).alias("r")
    )
    low = F.transform("r", lambda x: F.lower(x))
    style = F.pmod(F.xxhash64("r"), F.lit(6))
    return runs.select(
        F.when(style == 0, F.array_join(low, "_"))
        .when(style == 1, F.array_join(low, "-"))
        .when(style == 2, F.array_join(F.transform("r", lambda x: F.initcap(x)), ""))
        .when(style == 3, F.array_join(low, "/"))
        .when(style == 4, F.upper(F.array_join(low, "_")))
        .otherwise(F.concat(F.array_join(low, "_"), F.lit("_"), F.pmod(F.xxhash64("r"), F.lit(2100)).cast("string")))
        .alias("s")
    )


def ratio_table(documents: DataFrame, n_random: int = RANDOM_STRINGS, n_docs: int = IDENTIFIER_DOCS) -> DataFrame:
    """One row: an array of N * N log ratios ln P(b|a, random) - ln P(b|a, identifier)."""
    spark = documents.sparkSession
    both = random_strings(spark, n_random).withColumn("secret", F.lit(1)).union(
        identifiers(documents, n_docs).withColumn("secret", F.lit(0))
    )
    seen = (
        both.select("secret", F.explode(_pairs(F.col("s"))).alias("k"))
        .groupBy("k").agg(F.sum("secret").alias("r"), F.sum(1 - F.col("secret")).alias("o"))
    )
    row = Window.partitionBy("a")
    grid = (
        spark.range(N * N).select(F.col("id").cast("int").alias("k")).join(seen, "k", "left").na.fill(0, ["r", "o"])
        .withColumn("a", F.expr(f"k div {N}"))
        .withColumn("ratio", F.log((F.col("r") + 0.5) / (F.sum("r").over(row) + 0.5 * N)) - F.log((F.col("o") + 0.5) / (F.sum("o").over(row) + 0.5 * N)))
    )
    return grid.agg(F.sort_array(F.collect_list(F.struct("k", "ratio"))).alias("t")).select(F.col("t.ratio").alias("t"))


def random_spans(text: Column, table: Column, base: Column, min_ratio: float) -> Column:
    """SPAN of kind 3: candidates apart from base spans whose mean ratio is min_ratio or more."""

    def score(s: Column) -> Column:
        return let(_pairs(s), lambda p: let(table, lambda t: F.aggregate(
            p, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(t, k), F.lit(0.0))) / F.size(p)))

    found = _spans(text, CANDIDATE, 3, lambda v: score(v) >= min_ratio)
    apart = lambda b: F.filter(found, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
    return F.when(text.rlike(CANDIDATE), let(base, apart)).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    kind = lambda k: reduce(lambda acc, i: acc.when(k == i, KINDS[i]), range(1, 4), F.when(k == 0, KINDS[0]))
    return F.array_join(
        F.transform(spans, lambda x: F.concat(kind(x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ","
    )


def scan(documents: DataFrame, min_ratio: float = MIN_RATIO, n_random: int = RANDOM_STRINGS, n_docs: int = IDENTIFIER_DOCS) -> DataFrame:
    """row (all columns of documents), base (SPAN of the patterns) and found (SPAN with the model's), both by start.

    A null text is read as empty and has no spans. One result row for each row, repeated rows included; columns of
    documents keep any name. An empty table gives an empty result (the model then knows random strings
    only). Offsets are code points, end exclusive. Work and memory for a text are in proportion to its length and its matches.
    """
    table = ratio_table(documents, n_random, n_docs).scalar()
    text = text_of("row.text")
    with_base = documents.select(F.struct("*").alias("row"), table.alias("ratios")).select("row", "ratios", base_spans(text).alias("base"))
    extra = random_spans(text, F.col("ratios"), F.col("base"), min_ratio)
    return with_base.select("row", "base", F.sort_array(F.concat("base", extra)).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    count = lambda col, k: F.size(F.filter(col, lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        "row.doc_id", count("base", 0).alias("n_assign"), count("base", 1).alias("n_access"), count("base", 2).alias("n_hex"),
        count("found", 3).alias("n_random"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each span replaced by mark, overlapping ones by one; n_chars, if there, follows the text.

    All rows and columns stay, whatever their names. A null text stays null, texts without secrets stay to the byte. An empty
    table gives an empty one. The text is cut once into parts of PART characters, so that a span costs no walk from the beginning.
    """
    scanned = scan(documents)
    text = text_of("row.text")

    def piece(parts: Column, a: Column, b: Column) -> Column:
        """Characters a to b (exclusive) of a text in parts of PART characters."""
        first = (a - a % PART) / PART
        own = F.slice(parts, first.cast("int") + 1, (((b - 1) - (b - 1) % PART) / PART - first).cast("int") + 1)
        return F.when(b > a, F.substring(F.array_join(own, ""), a % PART + 1, b - a)).otherwise("")

    def cut(spans: Column) -> Column:
        """What stands before each span that overlaps none before, with a mark, and what is left at the end."""
        x = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), F.greatest)).alias("ends"))
        before = lambda v: F.transform(spans, lambda s, k: let(F.get(v["ends"], k), lambda e: F.when(s["start"] >= e, F.concat(piece(v["parts"], e, s["start"]), F.lit(mark))).otherwise("")))
        return let(x, lambda v: F.concat(F.array_join(before(v), ""), let(F.element_at(v["ends"], -1), lambda e: piece(v["parts"], e, F.length(text)))))

    some = F.size("found") > 0
    out = scanned.select("row", "found", F.when(some, let(F.col("found"), cut)).otherwise(F.col("row.text")).alias("text"))
    change = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        change["n_chars"] = F.when(some, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(change.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
