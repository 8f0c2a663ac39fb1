"""The whole pipeline on a small table against its stages done by hand, and every operator on tables whose columns have the operators' own names."""

import hashlib
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import common, decontam, html_gbt, line_rules, phrases, quality_mil, secret_scan, simhash, toxicity, url_rules
from claimlens.llm import sentencepiece_codec as codec

from .rows import TAKEN, crowded_frame, empty_frame, prose
from .test_line_rules import by_hand as counts_by_hand
from .test_secret_scan import ASSIGN

SPACE = " \t\n\x0b\x0c\r"
HEX = hashlib.sha256(b"x").hexdigest()


def planted():
    """Copies, near copies, leaks, secrets, a common line, short and repeated texts."""
    header = prose(40, 12)
    rows = [(k, f"{header}\n{prose(100 + k, 60)}\n{prose(400 + k, 30)}") for k in range(45)]
    rows += [(100 + k, prose(700 + k, 80)) for k in range(30)]
    rows += [(200 + k, rows[50][1]) for k in range(5)] + [(210, rows[52][1].upper())]
    rows += [(220 + k, rows[55 + k][1] + " " + prose(9000 + k, 1)) for k in range(3)]
    bench = [(k, prose(5000 + k, 30) + ". " + prose(6000 + k, 8)) for k in range(6)]
    rows += [(300 + k, f"{prose(900 + k, 50)} {t} {prose(950 + k, 40)}") for k, (_, t) in enumerate(bench)]
    rows += [(400 + k, f"{prose(1000 + k, 40)} token = \"{HEX[:40]}\" {prose(1050 + k, 30)} password: {HEX[5 + k:20]}") for k in range(4)]
    rows += [(500, None), (501, "few words"), (502, "a b c d e f g h " * 10), (503, ""), (None, prose(1, 50))]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows], bench


def stages_by_hand(rows, bench):
    """doc_id, text of what is left before tokens."""
    split = {n: [x for x in (r[1] or "").split("\n") if x.strip(SPACE)] for n, r in enumerate(rows)}
    plain = lambda x: " ".join(x.lower().split())
    holders = {}
    for n, lines in split.items():
        for x in lines:
            holders.setdefault(plain(x), set()).add(tuple(map(plain, lines)))
    common_lines = {x for x, docs in holders.items() if len(docs) > line_rules.LINE_DOCS and len(docs) > line_rules.LINE_SHARE * len(rows)}
    kept = []
    for r in rows:
        text = r[1] or ""
        gone = sum(len(x.split()) for x in text.split("\n") if x.strip(SPACE) and plain(x) in common_lines)
        n = len(text.split())
        if not counts_by_hand(text)[-1] and not (gone >= n * line_rules.LOST_SHARE and n - gone < line_rules.MIN_WORDS):
            kept.append((r[0], "\n".join(x for x in text.split("\n") if not x.strip(SPACE) or plain(x) not in common_lines)))
    prints = [simhash.fingerprint(t) & (2**64 - 1) for _, t in kept]
    group = list(range(len(kept)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    best = {}
    for k, (d, _) in enumerate(kept):
        if find(k) not in best or (d is None, d) < (kept[best[find(k)]][0] is None, kept[best[find(k)]][0]):
            best[find(k)] = k
    kept = [kept[k] for k in sorted(best.values())]
    items = decontam.Items.of(pd.DataFrame(bench, columns=["item_id", "text"]))
    clean = []
    for d, t in kept:
        w = decontam._of([t])
        if d is None or not any(decontam._leaks(items, k, w, 0, len(w.hash)) for k in range(len(bench))):
            clean.append((d, t))
    out = []
    for d, t in clean:
        spans = [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        for a, b in reversed(spans):
            t = t[:a] + "[SECRET]" + t[b:]
        out.append((d, t))
    return out


@pytest.fixture
def tables(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", rows, bench


def test_run_matches_the_stages_by_hand(spark, tables):
    folder, rows, bench = tables
    want = stages_by_hand(rows, bench)
    ids = {d for d, _ in want}
    assert ids >= set(range(45)) - {0} and not ids & {200, 201, 300, 301, 500, 501, 502, 503} and any("[SECRET]" in t for _, t in want)
    own = codec.Codec(codec.MODEL)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted((d or -1, i) for (d, _), i in zip(want, own.encode([t for _, t in want]), strict=True))
    assert all(r.round_trip for r in got)


def test_finished_stages_leave_nothing_behind(spark, tables):
    folder, *_ = tables
    there = lambda x: os.path.exists(x._scratch_path.removeprefix("file://"))
    with common.scratch() as other:
        theirs = common.stored(spark.range(3))
    with common.scratch() as made:
        corpus_pipeline.run(spark, folder).collect()
    assert sum(map(there, made)) == 1 and there(theirs) and other == [theirs]
    common.drop_stored(theirs, *made)
    assert not there(theirs) and not any(map(there, made))


def test_stages_keep_columns_of_any_name(spark, tables):
    folder, *_ = tables
    docs = crowded_frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{c}:a" for r in out.collect() for c in TAKEN if c not in ("id",)), name
        assert stage(spark, empty_frame(spark), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_operators_take_tables_with_their_own_names(spark):
    docs = crowded_frame(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), *(F.col(c) for c in TAKEN if c not in ("label",)))
    n = docs.count()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "doc_id").alias("url"), F.col("text").alias("html"), *TAKEN)
    for out in (
        quality_mil.quality(docs, labels), toxicity.toxicity(docs, labels), secret_scan.digest(secret_scan.scan(docs, n_random=200, n_docs=10)), line_rules.quality_rules(docs), simhash.near_duplicates(docs),
        phrases.remove_repeats(docs), codec.digest(docs), html_gbt.extract(pages), url_rules.judge(pages),
    ):
        assert out.count() == n


def test_secret_model_on_labelled_strings(spark):
    """Random strings of several alphabets and lengths are found, identifiers and words of any style are not."""
    rng = random.Random(8)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    secrets = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(24, 64))) for _ in range(150)]
    styles = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), lambda w: "/".join(w), lambda w: "_".join(w).upper(), lambda w: w[0] + "".join(x.title() for x in w[1:])]
    names = [s for s in (styles[k % 6](prose(2000 + k, 5).split()) for k in range(300)) if len(s) >= 20]
    rows = [(k, prose(k, 200)) for k in range(40)] + [(1000 + k, f"see {s} here") for k, s in enumerate(secrets)] + [(5000 + k, f"see {s} here") for k, s in enumerate(names)]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = sum(got[1000 + k].n_random + got[1000 + k].n_hex + got[1000 + k].n_access > 0 for k in range(len(secrets)))
    assert found >= 0.95 * len(secrets)
    assert sum(got[5000 + k].n_random for k in range(len(names))) <= 0.02 * len(names)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={HEX[:8]}{k}" for k in range(6000))
    r = secret_scan.digest(secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), n_random=200)).first()
    assert r.n_assign == 6000 and r.spans.split(",")[-1] == f"assign:{text.rindex('token')}:{len(text)}"
    assert secret_scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == " ".join(["[SECRET]"] * 6000)
