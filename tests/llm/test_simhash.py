from collections import Counter

import xxhash

from claimlens.llm import simhash
from claimlens.llm.components import components

from .rows import SCHEMA, awkward, awkward_frame, empty_frame, prose


def by_hand(text):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(prints):
    """Component of each (doc_id, fp), by comparing all pairs."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {f: least.get(find(f)) for f in fps}


def test_whole_operator_against_all_pairs(spark):
    base = prose(30, 60).split()
    rows = awkward()
    for k in range(60):
        w = list(base)
        w[k] = f"w{k}"
        rows.append((500 + k, " ".join(w), None, None, None, None, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = [(r[0], by_hand(r[1])) for r in rows]
    want = roots(prints)
    for group in (512, 1):
        got = simhash.digest(simhash.near_duplicates(docs, group=group)).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", want[f]) for d, f in prints)


def test_links_of_dense_groups_join_what_pairs_join(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre = 0xF0F0_1234_8765_0FF1
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 7)})
    fps += [1 << 63, (1 << 63) | 3, 0, 7]
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = roots([(f, f) for f in fps])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    for group in (512, 4):
        links = simhash.links(nodes, group)
        assert all((r.a ^ r.b) & ((1 << 64) - 1) for r in links.collect())
        root = {r.node & ((1 << 64) - 1): r.root for r in components(links).collect()}
        assert groups({f: root.get(f, signed(f)) for f in fps}) == groups(want)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 120), (120, 110), (7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 110: 100, 120: 100, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_and_empty(spark):
    docs = awkward_frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and ids[3] == 1 and 4 not in ids and max(ids.values()) == 1
    assert simhash.near_duplicates(empty_frame(spark)).count() == 0


def test_one_of_each_component_stays_whatever_its_ids(spark):
    """Null ids, one id with two texts, and copies of both: one row of each component, with its own text."""
    a, b, c, d, e = (prose(70 + k, 60) for k in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (4, c), (3, c), (5, d), (5, e), (5, e), (6, d), (None, d)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, a), (None, b), (3, c), (5, d), (5, e)])
