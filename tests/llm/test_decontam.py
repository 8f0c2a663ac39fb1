import numpy as np
import pandas as pd

from claimlens.llm import decontam

from .rows import awkward_frame, empty_frame, prose

BENCH = "item_id long, text string, score double"


def bench():
    return [(k, prose(5000 + k, 20 + k) + ". " + prose(6000 + k, 8), 1.0) for k in range(30)]


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    items = bench()
    rows, want = [], {}
    for k, (i, t, _) in enumerate(items):
        rows.append((1000 + k, f"{prose(k, 150)} {t.upper()} {prose(90 + k, 200)}"))
        want[1000 + k, i] = True
        w = t.split()
        w[3:12:4] = ["xx"] * len(w[3:12:4])
        rows.append((2000 + k, f"{prose(200 + k, 80)} {' '.join(w)}"))
        want[2000 + k, i] = True
        rows.append((3000 + k, prose(300 + k, 400)))
        rows.append((4000 + k, " ".join(t.split()[: len(t.split()) // 3]) + " " + prose(400 + k, 100)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, spark.createDataFrame(items, BENCH)).collect()}
    assert set(got) == set(want)
    assert all(got[1000 + k, k].share == 1 for k in range(30))
    blocks = decontam.contaminated(docs, spark.createDataFrame(items, BENCH), block=7).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(want)


def exact_pairs(texts, items, idf):
    """(text, passage, query) of all pairs that reach the cosine, counted word by word."""
    weight = decontam._query_weights(items, idf)
    other = float((idf[idf > 0] ** 2).mean())
    at = {h: k for k, h in enumerate(items.vocabulary.tolist())}
    out = {}
    for t, text in enumerate(texts):
        w = decontam._of([text]).hash.tolist()
        starts = range(0, len(w), decontam.UNIT)
        for u, a in enumerate(starts):
            own = w[a : a + 2 * decontam.UNIT]
            length = np.sqrt(sum(idf[at[h]] ** 2 if h in at else other for h in own))
            for q in range(len(items.queries)):
                c = sum(weight[q, at[h]] * idf[at[h]] for h in own if h in at) / length
                if c >= decontam.COSINE:
                    out[t, u, q] = c
    return out


def test_recall_of_the_latent_search_against_exact_cosines(spark):
    """Through latent_space itself: of the pairs that reach the cosine, nine in ten or more are found in a space of far fewer dimensions."""
    rng = np.random.default_rng(3)
    rows = [(k, prose(5000 + k, 30) + ". " + prose(6000 + k, 8), 1.0) for k in range(120)]
    items = decontam.Items.of(pd.DataFrame(rows, columns=["item_id", "text", "score"]))
    texts = []
    for k in range(150):
        w = rows[rng.integers(len(rows))][1].split()
        for j in range(int(rng.integers(1, 4)), len(w), int(rng.integers(3, 7))):
            w[j] = prose(7000 + 40 * k + j, 1)
        texts.append(f"{prose(8000 + k, 60)} {' '.join(w)} {prose(9000 + k, 60)}")
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    seen, n = decontam.document_frequency(docs, items)
    idf = (np.log((n + 1) / (seen + 1)) + 0.1).astype(np.float32)
    space = decontam.latent_space(docs, items, idf, rank=40)
    assert space.shape[1] == 40 < len(items.queries) and np.allclose(space.T @ space, np.eye(40), atol=1e-3)
    own = decontam._query_rows(items, idf)
    assert (np.linalg.norm(own @ space, axis=1) < 0.95).mean() > 0.9, "the space leaves a part of most items out"
    want = exact_pairs(texts, items, idf)
    latent = own @ space
    latent /= np.linalg.norm(latent, axis=1)[:, None]
    got = {}
    weight = np.ascontiguousarray(decontam._query_weights(items, idf).T)
    for t, text in enumerate(texts):
        p = decontam.Passages.read(items, idf, decontam._of([text]), decontam.COSINE)
        if p is not None and len(p.some):
            hit, q = decontam.candidates(p, (space * idf[:, None]).astype(np.float32), latent, decontam.NEAR)
            for h, k, c in zip(hit, q, decontam.exact_cosines(p, idf, weight, hit, q), strict=True):
                got[t, int(p.some[h]), int(k)] = c
    assert len(want) > 150 and len(set(want) & set(got)) >= 0.9 * len(want)
    assert all(abs(got[k] - c) < 1e-3 for k, c in want.items() if k in got)
    assert len(got) < 0.2 * len(items.queries) * sum(len(t.split()) // decontam.UNIT + 1 for t in texts)


def test_pairs_match_an_exhaustive_comparison(spark):
    """Every document against every item by the longest common subsequence over the whole text, without any search."""
    items = [(k, prose(5000 + k, 24) + ". " + prose(6000 + k, 8), 1.0) for k in range(25)]
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        t = items[rng.integers(25)][1].split()
        drop = rng.random(len(t)) < rng.choice([0.0, 0.1, 0.35, 0.6])
        rows.append((k, f"{prose(200 + k, 70)} {' '.join('zz' if d else x for x, d in zip(t, drop))} {prose(900 + k, 50)}"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()}
    every = decontam.Items.of(pd.DataFrame(items, columns=["item_id", "text", "score"]))
    want = set()
    for d, text in rows:
        w = decontam._of([text])
        want |= {(d, every.ids[k]) for k in range(25) if decontam._leaks(every, k, w, 0, len(w.hash))}
    assert len(want) > 40 and got == want


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(0, 6, rng.integers(0, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, z in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == z else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_words(a, b) == t[-1, -1]


def test_awkward_rows(spark):
    docs = awkward_frame(spark)
    items = spark.createDataFrame([(1, None, 0.0), (None, prose(1, 80), 0.0), (2, "", 0.0), (3, prose(1, 80), 0.0)], BENCH)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 3), (2, 3), (10, 3)}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(empty_frame(spark), items).count() == 0
    assert decontam.clean_documents(docs, items).columns == docs.columns


def test_long_items_are_found(spark):
    """Items of 300, 600 and 1200 words, word for word or with every sixth word changed, at any offset; half of one is no leak."""
    sizes = {1: 300, 2: 600, 3: 1200, 4: 61}
    items = [(k, prose(8000 + k, n), 1.0) for k, n in sizes.items()]
    rows = []
    for k, text, _ in items:
        w = text.split()
        rows += [(100 * k + j, f"{prose(9000 + 10 * k + j, 30 + j)} {text} {prose(9500 + 10 * k + j, 50)}") for j in range(0, 12, 3)]
        rows.append((100 * k + 50, prose(9700 + k, 37) + " " + " ".join("xx" if i % 6 == 3 else x for i, x in enumerate(w))))
        rows.append((100 * k + 60, prose(9800 + k, 37) + " " + " ".join(w[: len(w) * 2 // 5])))
    docs = spark.createDataFrame(rows + [(9000 + k, prose(7000 + k, 300)) for k in range(200)], "doc_id long, text string")
    want = {(100 * k + j, k) for k in sizes for j in (0, 3, 6, 9, 50)}
    for block in (256, 20):
        got = decontam.contaminated(docs, spark.createDataFrame(items, BENCH), block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.share == 1 and r.item_words == sizes[r.item_id] for r in got if r.doc_id % 100 != 50)
