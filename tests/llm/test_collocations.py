import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from claimlens.llm import collocations

from .rows import SCHEMA, awkward, crowded_frame, empty_frame


def by_hand(rows, least, top=2000, longest=5):
    """The contract over (text, lang), phrase by phrase."""
    f = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        frequent = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * v >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, v in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "city", "in", "été", "日本", "a\x0bb", "x" * 300, "\U0001f600", "don't", "(and"]
    phrases = ["New York City hall of records", "in the city of", "\t  ", "of of of of of of", "the The THE"]
    return [" ".join(rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\r", ";"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, *[None] * 6) for k, (t, lang) in enumerate(rows)], SCHEMA)


def test_against_phrase_by_phrase(spark):
    rows = [(t, ("en", "de", None, "und")[k % 4]) for k, t in enumerate(texts(3, 400))] + [(t, None) for _, t, *_ in awkward()]
    for least, block in ((100, 1_000_000), (5, 300)):
        got = collocations.collocations(frame(spark, rows), least=least, block=block).collect()
        assert sorted(map(tuple, got)) == by_hand(rows, least)
        assert len(got) > 10


def test_ranks_are_cut(spark):
    rows = [(t, "en") for t in texts(4, 150)]
    got = collocations.collocations(frame(spark, rows), least=3, top=7).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, 3, 7) and len(got) == 7


def test_empty_rare_and_clashing_names(spark):
    assert collocations.collocations(empty_frame(spark)).count() == 0
    assert collocations.collocations(frame(spark, [("only once here", "en")])).count() == 0
    rows = [(r[1], None) for r in awkward()]
    assert sorted(map(tuple, collocations.collocations(crowded_frame(spark), least=2).collect())) == by_hand(rows, 2)


def test_bounded_sums_filters_and_equal_hashes(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 2000)
    words = [f"w{k}" for k in range(300)]
    found = [("en", pa.array(words), np.arange(300)), ("de", pa.array(words[:50]), np.ones(50, int)), ("en", pa.array(words[::-1]), np.arange(300)[::-1])]
    batches = list(collocations._summed(iter(found)))
    assert len(batches) > 1 and max(b.num_rows for b in batches) < 650
    sums = Counter()
    for row in pa.Table.from_batches(batches).to_pylist():
        sums[row["lang"], row["phrase"]] += row["n"]
    assert sums == Counter({("en", w): 2 * k for k, w in enumerate(words)}) + Counter({("de", w): 1 for w in words[:50]}) | Counter({("en", "w0"): 0})
    seq = np.array([1, 2, 1, 2, 3, 0, 1, 2], np.int32)
    at, n = collocations._different(seq, np.array([0, 1, 2, 3, 6]), np.zeros(5, np.uint64), 2)
    assert sorted(zip(seq[at].tolist(), seq[at + 1].tolist(), n.tolist(), strict=True)) == [(1, 2, 3), (2, 1, 1), (2, 3, 1)]
    texts_of = [(part, a.to_pylist()) for part, a in collocations._texts(pa.array(["x" * 1500, "y"]), np.array([[1, 2], [2, 2], [1, 1]]))]
    assert [x for _, a in texts_of for x in a] == ["x" * 1500 + " y", "y y", "x" * 1500 + " " + "x" * 1500] and len(texts_of) == 2
    some = collocations._Known(12)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    some.add(hashes[:100])
    assert some.has(hashes[:100]).all() and some.has(hashes[100:]).sum() < 10


def test_blocks_are_never_joined(spark):
    own = collocations.blocks(frame(spark, [(t, "en") for t in texts(5, 50)]), 100)
    below = collocations.known(spark.createDataFrame([("en", "new york"), ("en", "york city")], "lang string, phrase string"), 2)
    found = collocations.phrases_in(own, 3, below, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r["phrase"] for r in found.collect()} >= {"new york city"}


def test_rare_phrases_are_not_sent_however_many_there_are(spark):
    words = [f"w{k}" for k in range(450)]
    pairs = [f"{a} {b}" for a in words for b in words] + ["w1 w2", "w1 w2", "w7 w7"]
    own = collocations.stored(collocations.blocks(frame(spark, [(".".join(pairs[k::40]), "en") for k in range(40)]).repartition(4), 20_000))
    assert own.count() > 10
    below = collocations.known(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string"), 1)
    found = collocations.phrases_in(own, 2, below, 3)
    assert {r["phrase"] for r in found.collect()} == {"w1 w2"}
    assert [tuple(r) for r in collocations.phrase_sums(own, 2, below, 3).collect()] == [("en", "w1 w2", 3)]


def test_phrases_are_added_up_from_arrays(spark):
    own = collocations.stored(collocations.blocks(frame(spark, [(t, ("en", "de")[k % 2]) for k, t in enumerate(texts(6, 120))]), 200))
    below = collocations.known(own.selectExpr("lang", "explode(words) AS phrase"), 1)
    found = collocations.phrases_in(own, 2, below, 2)
    sums = collocations.phrase_sums(own, 2, below, 2)
    by_phrase = Counter()
    for r in found.collect():
        by_phrase[r["lang"], r["phrase"]] += r["n"]
    assert {(r["lang"], r["phrase"]): r["f"] for r in sums.collect()} == {p: n for p, n in by_phrase.items() if n >= 2}
    assert found.count() > 100 and "HashAggregate" not in sums._jdf.queryExecution().executedPlan().toString()


def test_heads_are_added_up_exactly():
    heads = np.array([5, 1 << 31, 5, (1 << 32) - 1, 0, 5], np.uint32)
    assert [x.tolist() for x in collocations._added(heads)] == [[0, 5, 1 << 31, (1 << 32) - 1], [1, 3, 1, 1]]
    assert [x.tolist() for x in collocations._added(heads, np.array([1, 2, 3, 1 << 40, 5, 6]))] == [[0, 5, 1 << 31, (1 << 32) - 1], [5, 10, 2, 1 << 40]]
    assert collocations._ranges(np.sort(heads), 2) == [0, 4, 6] and collocations._ranges(heads[:0], 3) == [0, 0, 0, 0]
