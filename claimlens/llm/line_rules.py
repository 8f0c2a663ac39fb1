"""Document quality rules with cross-document line frequency (native).

Lines are normalised and hashed; for each host (the column source) the documents that hold a line
are counted, and lines above the host's limit are removed. Documents that lose most of their words
so and keep too few are rejected. Copies of a document are one document in that count: a document
is known by a hash of all its normalised lines in order, so a group of copies, however large, does
not push its own lines over the limit, while different documents count apart whatever lines they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPACE_RUN, let, repeated, stored, text_of, trimmed, with_counted, words

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: A line is removed if more than this many documents of its host, and this share of them, hold it.
LINE_DOCS, LINE_SHARE = 30, 0.001
#: A document is rejected if it loses at least this share of its words and keeps fewer than MIN_WORDS.
LOST_SHARE = 0.5


def repeated_words(w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text (long).

    Windows are compared by a 64-bit hash. Only texts with a repeated window are sorted.
    """
    n = F.size(w)

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            )

        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(by_hash, lambda s: let(starts(s), total))
        ).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    return F.when(n > WINDOW, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def features(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of a text, all long."""
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of the line, lower-cased, with each run of white space as one space."""
    plain = F.regexp_replace(trimmed(F.lower(line)), SPACE_RUN, " ")
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    """doc, host, h, words, key: one row for each line with a word; key stands for the document."""
    found = F.transform(
        F.filter(F.split(F.col("text"), "\n"), lambda x: trimmed(x) != ""),
        lambda x: F.struct(line_hash(x).alias("h"), F.size(F.split(trimmed(x), SPACE_RUN)).alias("words")),
    )
    whole = let(found, lambda x: F.struct(x.alias("lines"), F.xxhash64(x["h"]).alias("key")))
    return docs.select("doc_id", "tk", "host", whole.alias("x")).select("doc_id", "tk", "host", F.col("x.key").alias("key"), F.inline("x.lines"))


def frequent_lines(docs: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """host, h, n of the lines above the limits: n documents of the host hold the line, each different text once."""
    held = _lines(docs).groupBy("host", "h", "key").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = docs.groupBy("host").agg(F.count("*").alias("n_host"))
    return (
        held.where(F.col("n") > line_docs)
        .join(hosts, "host")
        .where(F.col("n") > F.col("n_host") * line_share)
        .select("host", "h", "n")
    )


def _judged(documents: DataFrame, line_docs: int, line_share: float, lost_share: float) -> DataFrame:
    """The columns of quality_rules, tk, copies and gone_lines (hashes), one row for each doc_id and tk."""
    docs = documents.select(
        F.col("doc_id"), text_of("text").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    ).withColumn("tk", F.xxhash64("text", "host"))
    base = (
        docs.select("doc_id", "tk", features(F.col("text")).alias("f"))
        .select("doc_id", "tk", "f.w.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.w.n_repeat_words")
        .groupBy("doc_id", "tk")
        .agg(*(F.first(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.count("*").cast("int").alias("copies"))
    )
    #: A frequent line is by its nature a hot key, so the most frequent ones are not joined by a shuffle.
    gone = (
        with_counted(_lines(docs), stored(frequent_lines(docs, line_docs, line_share)), ["host", "h"])
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("tk").alias("gone_tk"))
        .agg(F.sum("words").alias("gone"), F.collect_set("h").alias("gone_lines"))
    )
    both = base.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("tk") == F.col("gone_tk")), "left")
    lost = F.coalesce(F.expr("gone div copies"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        both.withColumns({"n_line_words": lost, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & ~(
            (F.col("n_line_words") >= F.col("n_words") * lost_share) & (F.col("n_words") - F.col("n_line_words") < MIN_WORDS)))
    )


def quality_rules(
    documents: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, lost_share: float = LOST_SHARE
) -> DataFrame:
    """doc_id, the base counts, base_failed, n_line_words (words in removed lines) and kept.

    One result row for each row of documents, repeated rows included. A null text counts as empty
    and fails the base rule; a null source is a host of its own; a null doc_id stays null. Other
    columns are dropped. An empty table gives an empty result.
    """
    judged = _judged(documents, line_docs, line_share, lost_share)
    return repeated(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept", "copies"), "copies")


def kept_documents(
    documents: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, lost_share: float = LOST_SHARE
) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns, less the lines above the limits.

    Where lines go, n_chars (if there is such a column) is the length of what is left; other texts
    stay as they are, to the byte. Rows with a null or blank text, or too few words, go; a null source is a host of
    its own, a null doc_id stays; repeated rows stay as often as they are there. Columns of any other name pass
    through. An empty table gives an empty one.
    """
    verdicts = _judged(documents, line_docs, line_share, lost_share).where("kept").select(
        F.col("doc_id").alias("id_of"), F.col("tk").alias("tk_of"), "gone_lines")
    whole = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of("text"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("tk"))
    kept = whole.join(verdicts, F.col("id").eqNullSafe(F.col("id_of")) & (F.col("tk") == F.col("tk_of")))
    text, loses = F.col("row.text"), F.col("gone_lines").isNotNull()
    left = F.array_join(F.filter(
        F.split(text_of(text), "\n"), lambda x: (trimmed(x) == "") | ~F.array_contains(F.col("gone_lines"), line_hash(x))
    ), "\n")
    kept = kept.select("row", "gone_lines", F.when(loses, left).otherwise(text).alias("text"))
    change = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        change["n_chars"] = F.when(loses, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*(change.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
