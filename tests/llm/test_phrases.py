from collections import Counter

from claimlens.llm import phrases

from .rows import SCHEMA, awkward, empty_frame, prose


def test_against_word_by_word(spark):
    passage = prose(77, 60)
    rows = [r[:2] for r in awkward() if r[0] is not None]
    rows += [(300 + k, prose(300 + k, 5 + k % 30) + " " + passage + "\n" + prose(600 + k, 20)) for k in range(40)]
    rows += [(400, passage), (401, " ".join(passage.split()[:13])), (402, " ".join(passage.split()[:12])), (403, "a " * 200), (404, "a " * 30), (405, passage.upper())]
    docs = spark.createDataFrame([(d, t, *[None] * 7) for d, t in rows], SCHEMA)
    want = phrases.removed_by_hand([(d, t or "") for d, t in rows])
    got = phrases.digest(phrases.remove_repeats(docs)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert want[403][1] == 0 and want[404][1] == 30 and want[401][1] == 13 and want[402][1] == 0


def test_rows_without_id_come_last(spark):
    t = prose(5, 40)
    docs = spark.createDataFrame([(None, t), (9, t), (None, prose(6, 20))], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_repeats(docs).collect())
    assert got == Counter([(None, 40, 40), (9, 40, 0), (None, 20, 0)])


def test_many_flushes_of_the_automaton(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENTS", 3)
    lines = [[f"w{k}" for k in range(a, a + 20)] for a in (0, 2, 4)]
    assert phrases.locate(lines, [5, 3, 9])[0] == [5, 5, 3, 3, 3, 3, 3, 3]
    assert phrases.locate([], []) == []


def test_empty(spark):
    assert phrases.remove_repeats(empty_frame(spark)).count() == 0


def test_hot_and_heavy_anchors_change_nothing(spark):
    """A phrase of eight words in ever new surroundings, and a passage in every document, by salts and window by window."""
    common, licence = prose(1, 8), prose(2, 40)
    rows = [(k, f"{prose(100 + k % 50, 12)} {common} {prose(200 + k % 40, 12)} {licence if k % 2 else ''} {prose(300 + k, 20)}") for k in range(120)]
    want = phrases.removed_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy, hot in ((2, 5), (10**6, 5), (2, 10**6)):
        got = phrases.digest(phrases.remove_repeats(docs, heavy, hot)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_rows_whose_text_keys_clash(spark, monkeypatch):
    """All texts have one key: rows without an id differ by length only; no row loses another's words, and none crashes."""
    monkeypatch.setattr(phrases, "text_key", lambda: phrases.F.lit(5).cast("long"))
    passage = prose(8, 30)
    rows = [(1, passage), (None, prose(9, 16) + " " + passage), (None, prose(10, 3)), (None, passage + " " + prose(11, 40)), (None, prose(12, 14))]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 30, 0), (None, 46, 30), (None, 3, 0), (None, 70, 30), (None, 14, 0)])
    short, long = " ".join(f"a{k}" for k in range(20)), "b" * 64 + " c"
    assert len(short) == len(long) + 3
    same = [(1, short), (None, short), (None, long + "ddd")]
    got = Counter((r.doc_id, r.n_words) for r in phrases.remove_repeats(spark.createDataFrame(same, "doc_id long, text string")).collect())
    assert got == Counter([(1, 20), (None, 20), (None, 2)])
