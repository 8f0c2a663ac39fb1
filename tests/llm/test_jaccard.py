import random
from collections import Counter

from pyspark.sql import functions as F

from claimlens.llm import jaccard

from .rows import SCHEMA, awkward, crowded_frame, empty_frame, prose


def sets_by_hand(text, size=4):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def by_hand(rows, size=4, percent=85):
    """The contract, comparing all pairs."""
    sets = [sets_by_hand(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return Counter((d, len(x), least.get(find(k)) if x else d) for k, ((d, _), x) in enumerate(zip(rows, sets, strict=True)))


def family(seed, n, words, edits):
    """n copies of one text, each with some words replaced."""
    rng, base = random.Random(seed), prose(seed, words).split()
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{seed}{k}{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_all_pairs(spark):
    rows = [r[:2] for r in awkward()]
    texts = [t for seed, n, words, edits in ((50, 60, 120, 5), (51, 25, 40, 2), (52, 30, 300, 16), (53, 20, 12, 1)) for t in family(seed, n, words, edits)]
    common = prose(90, 30)
    texts += [prose(700 + k, 25) + "\n" + common for k in range(40)] + [prose(50, 120).upper(), "a b c d " * 30, "a b c d " * 9, "One", "ONE two", "one TWO"]
    rows += [(1000 + k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0])]
    got = jaccard.near_duplicates(spark.createDataFrame([(d, t, *[None] * 7) for d, t in rows], SCHEMA)).collect()
    assert Counter(map(tuple, got)) == by_hand(rows)


def test_filters_lose_no_link(spark):
    """Every linking pair of a dense family passes from its first shared prefix shingle on, and no pair is brought twice in a row."""
    rows = list(enumerate(family(77, 50, 60, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = jaccard.prints(docs, jaccard.rarity(docs)).groupBy("n", "k1", "k2").agg(F.min("id").alias("node"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    none = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in jaccard.rest(jaccard.recurring(nodes), none).collect()}
    sets = {d: sets_by_hand(t) for d, t in rows}
    ids = {r.node for r in nodes.collect()}
    want = {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_other_sizes_and_limits(spark):
    rows = list(enumerate(family(5, 20, 50, 4) + family(6, 20, 30, 2)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70).collect()
    assert Counter(map(tuple, got)) == by_hand(rows, 2, 70)


def test_prefix_lengths_leave_one_shared_shingle():
    for n in range(1, 300):
        p = jaccard.prefix_length(n)
        assert 1 <= p <= n and n - p + 1 == -(-85 * n // 100)


def test_empty_and_clashing_names(spark):
    assert jaccard.near_duplicates(empty_frame(spark)).count() == 0
    rows = [r[:2] for r in awkward()]
    assert Counter(map(tuple, jaccard.near_duplicates(crowded_frame(spark)).collect())) == by_hand(rows)
