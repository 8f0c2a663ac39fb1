from collections import Counter

from claimlens.llm import line_rules

from .rows import SCHEMA, awkward, awkward_frame, empty_frame, prose

SPACE = " \t\n\x0b\x0c\r"


def by_hand(text):
    text = text or ""
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    n = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_counts_match_brute_force(spark):
    extra = [(100, "a b c d e f g h i " * 5 + "\nz\nz\n" + "#|<" * 3, None, "s", None, 0.0, "", 0, 0)]
    rows = awkward() + extra
    got = line_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert have == Counter((r[0], *by_hand(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)


def test_empty(spark):
    assert line_rules.quality_rules(empty_frame(spark)).count() == 0
    assert line_rules.kept_documents(empty_frame(spark)).columns == empty_frame(spark).columns


def test_frequent_lines_deplete_only_other_documents(spark):
    """A line of 60 documents of a host goes; a document that is little else is rejected; copies stay."""
    common = prose(50, 30)
    rows = [(k, f"{common}\n{prose(1000 + k, 40)}", "s") for k in range(60)] + [(900, f"{common}\nshort own words", "s"), (901, f"{common}\nshort own words", "other")]
    rows += [(1000 + k, prose(7, 50) + "\n" + prose(8, 50), "s") for k in range(200)]
    got = {r.doc_id: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[900].kept and not got[900].base_failed and got[900].n_line_words == 30
    assert got[901].kept and all(r.kept for d, r in got.items() if d < 60 or d >= 1000)


def test_kept_documents_keeps_columns_and_copies(spark):
    docs = awkward_frame(spark)
    kept = line_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 2, None: 1, 9: 1, 10: 1, 12: 1})


def test_documents_that_share_two_template_lines_count_apart(spark):
    """40 different documents hold a header and a footer, which both go; 40 copies with other case and spaces are one."""
    header, footer = prose(60, 25), prose(61, 25)
    rows = [(k, f"{header}\n{prose(2000 + k, 40)}\n{footer}", "s") for k in range(40)] + [(900, f"{header}\nshort own words\n{footer}", "s")]
    copy = prose(62, 50) + "\n" + prose(63, 50)
    rows += [(1000 + k, copy.upper().replace(" ", "  ") if k % 2 else copy, "s") for k in range(40)]
    got = {r.doc_id: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.n_line_words == (50 if d <= 900 else 0) for d, r in got.items())
    assert not got[900].kept and all(r.kept for d, r in got.items() if d != 900)


def test_kept_documents_lose_the_lines_above_the_limits(spark):
    """Header and footer go from texts and n_chars; other texts, blank lines included, stay to the byte."""
    header, footer = prose(70, 9), prose(71, 8)
    own = {k: f"{prose(3000 + k, 30)}\n \n{prose(4000 + k, 30)}" for k in range(40)}
    rows = [(k, f"{header.upper()}\n{t}\n  {footer}", "s", 1) for k, t in own.items()]
    rows += [(5, rows[5][1], "s", 1), (None, rows[6][1], "s", 1), (100, f"{header}\n\n{prose(72, 40)}\n", "other", 7), (101, f"{header}\n{footer}\nfew", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    want = Counter((k, t, "s", len(t)) for k, t in own.items())
    want.update([(5, own[5], "s", len(own[5])), (None, own[6], "s", len(own[6])), rows[-2]])
    kept = line_rules.kept_documents(docs)
    assert kept.schema == docs.schema and Counter(map(tuple, kept.collect())) == want
