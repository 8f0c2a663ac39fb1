"""Jaccard join of word n-gram sets by rare-first prefix filtering, and the components of its links.

A document's set is its distinct SIZE-word shingles as 64-bit hashes. Documents with equal sets are one class (a node), whatever their
number, before anything is joined. All shingles are put in one order, rare ones first, and a set's prefix is its first
n - ceil(0.85 n) + 1 shingles: two sets that link share a shingle of both prefixes.

1. Order: how rare a shingle is comes from counts over all documents in a fixed number of slots (`slots`); ties go by hash. Any common
   order gives the same links, a sharper one fewer candidates.
2. Prefix shingles in two or more nodes' prefixes recur; the others are dropped.
3. Stars: each node is tried against one node of each of its recurring shingles, that of whose prefix the largest share recurs
   (in a family of edited copies its origin). That joins dense families with a number of pairs that is linear in their members.
4. The rest, exactly: for every shingle whose nodes are still in different components, each node outside the largest component of that
   shingle is tried against all nodes of other components. Pairs within a component need no trial.

A trial is made from the first shingle two prefixes share, and only if the length filter, the positional filter and the suffix filter
let it pass; then the whole sets are intersected, once for each pair. The suffix filter bounds the number of shingles in one set only
from below by the parities of how many shingles each of PARITIES hash ranges holds (it takes in the prefixes, whose ends differ).

Hashes of 64 bits stand for shingles; two different ones in two documents that are compared agree with a chance of about
n * n / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, short, stored, text_of, with_counted
from .components import components
from .slots import PARTS, merged, parts, slot_of, zeros
from .wordhash import MIX, mix, pieces, runs, words

SIZE, PERCENT = 4, 85
PARITIES = 512
#: Earlier recurring shingles of a prefix that are looked at to see that a pair has met before.
EARLIER = 4


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; of the whole sequence if it has fewer words, none without words."""
    for x in pieces(texts):
        w = words(x, lower=True)
        for a, b in zip(w.text[:-1].tolist(), w.text[1:].tolist(), strict=True):
            yield np.unique(runs(w.hash[a:b], min(size, b - a))) if b > a else np.zeros(0, np.uint64)


def rarity(documents: DataFrame, size: int = SIZE) -> np.ndarray:
    """In how many documents the shingles of each slot are, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = zeros()
        for b in short(batches):
            if sets := list(shingle_sets(b["text"], size)):
                np.add.at(counts, slot_of(np.concatenate(sets)), 1)
        yield from parts(counts)

    return merged(documents.select(text_of("text").alias("text")).mapInArrow(run, PARTS))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prints(documents: DataFrame, counts: np.ndarray, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """id, th (hash of the text), n, k1 and k2 (which tell sets apart), prefix (rarest first), bits (the parities)."""
    rare = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            n, k1, k2, prefix, bits = [], [], [], [], []
            for s in shingle_sets(b["text"], size):
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s * MIX + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                count = rare.value[slot_of(s)]
                p = prefix_length(len(s), percent) if len(s) else 0
                if 4 * p < len(s):
                    few = np.flatnonzero(count <= np.partition(count, p - 1)[p - 1])
                    s_, count = s[few], count[few]
                else:
                    s_ = s
                prefix.append(s_[np.argsort(count, kind="stable")[:p]].view(np.int64))
                odd = np.bincount((s >> np.uint64(64 - (PARITIES.bit_length() - 1))).astype(np.int64), minlength=PARITIES) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "id": b["id"], "th": b["th"], "n": pa.array(n, pa.int32()), "k1": k1, "k2": k2,
                "prefix": pa.array(prefix, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64())),
            })

    text = text_of("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "id long, th long, n int, k1 long, k2 long, prefix array<long>, bits array<long>")


def recurring(nodes: DataFrame) -> DataFrame:
    """tok, node, n, pos, bits, share, earlier: the prefix shingles that other nodes' prefixes have too.

    share: how much of the node's prefix recurs, in thousandths; earlier: the last EARLIER recurring shingles before.
    """
    keyed = nodes.select(F.posexplode("prefix").alias("pos", "tok"), "node")
    sizes = stored(keyed.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1"), tidy=True)
    some = with_counted(keyed, sizes, ["tok"], "m").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("own"))
    own = nodes.select("node", "n", "bits", F.size("prefix").alias("p")).join(some, "node")
    own = own.withColumn("share", F.expr("1000 * size(own) div p").cast("int")).withColumn("toks", F.transform("own", lambda x: x["tok"]))
    each = own.select("node", "n", "bits", "share", "toks", F.posexplode("own").alias("k", "x"))
    first = F.greatest(F.col("k") - EARLIER, F.lit(0))
    out = stored(each.select(F.col("x.tok").alias("tok"), "node", "n", F.col("x.pos").alias("pos"), "bits", "share", F.slice("toks", first + 1, F.col("k") - first).alias("earlier")), tidy=True)
    drop_stored(sizes)
    return out


def may_link(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Length, positional and suffix filter, and that no earlier shingle has brought the pair together."""
    na, nb = a["n"], b["n"]
    x = (na + nb) * percent + (99 + percent)
    alpha = ((x - x % (100 + percent)) / (100 + percent)).cast("int")  # the least number of shared shingles of a link
    room = F.least(a["pos"], b["pos"]) + F.least(na - a["pos"], nb - b["pos"])
    differ = sum((F.bit_count(F.get(a["bits"], F.lit(k)).bitwiseXOR(F.get(b["bits"], F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))
    return (
        (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (room >= alpha) & (differ <= na + nb - 2 * alpha)
        & ~F.arrays_overlap(a["earlier"], b["earlier"])
    )


def _side(tag: str) -> Column:
    return F.struct(*(F.col(f"{tag}_{c}").alias(c) for c in ("n", "pos", "bits", "earlier")))


def _tagged(rows: DataFrame, tag: str, *cols: str) -> DataFrame:
    return rows.select("tok", *(F.col(c).alias(f"{tag}_{c}") for c in ("node", "n", "pos", "bits", "earlier", *cols)))


def stars(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: each node with the chosen node of each of its recurring shingles, where the filters let the pair pass."""
    heads = stored(rows.groupBy("tok").agg(F.max(F.struct("share", F.xxhash64("node").alias("mix"), "node", "n", "pos", "bits", "earlier")).alias("head"), F.count("*").alias("m")), tidy=True)
    near = with_counted(rows, heads, ["tok"], "m").where(F.col("node") != F.col("head.node"))
    pairs = near.where(may_link(F.struct("n", "pos", "bits", "earlier"), F.col("head"), percent))
    out = stored(pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct(), tidy=True)
    drop_stored(heads)
    return out


def rest(rows: DataFrame, root: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs of nodes (of rows) in different components that the filters let pass; root: node, root of the nodes that have one."""
    rows = stored(rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), tidy=True)
    largest = F.max(F.struct("m", "root"))["root"].alias("largest")
    mixed = rows.groupBy("tok", "root").agg(F.count("*").alias("m")).groupBy("tok").agg(largest, F.sum("m").alias("m"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    mixed = stored(mixed, tidy=True)
    open_ = stored(with_counted(rows, mixed, ["tok"], "m").drop("m"), tidy=True)
    left, right = _tagged(open_.where("root <> largest"), "l", "root"), _tagged(open_, "r", "root", "largest")
    once = (F.col("r_root") == F.col("r_largest")) | (F.col("l_node") < F.col("r_node"))
    right = right.withColumnRenamed("tok", "r_tok")
    pairs = left.join(right, (F.col("tok") == F.col("r_tok")) & (F.col("l_root") != F.col("r_root")) & once & may_link(_side("l"), _side("r"), percent))
    out = stored(pairs.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct(), tidy=True)
    drop_stored(rows, mixed, open_)
    return out


def sets_of(documents: DataFrame, nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """node, shingles (array of hashes) of nodes (node, id, th), read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            yield pa.RecordBatch.from_pydict({"node": b["node"], "shingles": pa.array([s.view(np.int64) for s in shingle_sets(b["text"], size)], pa.list_(pa.int64()))})

    text, none = text_of("text"), F.lit(-1)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = texts.join(nodes.select("node", F.coalesce("id", none).alias("id"), "th"), ["id", "th"]).select("node", "text").dropDuplicates(["node"])
    return stored(found.mapInArrow(run, "node long, shingles array<long>"), tidy=True)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose whole sets link."""
    of = lambda tag: sets.select(F.col("node").alias(tag), F.col("shingles").alias(f"s{tag}"))
    x = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return stored(x.where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent).select("a", "b"), tidy=True)


def near_duplicates(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included).

    One row for each row of documents; other columns are dropped. Two documents link when their sets share at least `percent` hundredths of
    their union. A null or blank text has an empty set and links with nothing, equal ones included: its component is its own
    doc_id. A row with a null doc_id takes part in links and gets the smallest known id of its component, null if there is
    none. Rows that repeat are one class. An empty table gives an empty result.
    """
    own = stored(prints(documents, rarity(documents, size), size, percent), tidy=True)
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    nodes = own.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("first_id"), F.count("*").alias("m"), rep.alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), tidy=True)
    rows = recurring(nodes)
    addresses = nodes.select("node", "rep.id", "rep.th")
    in_pairs = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    near = stars(rows, percent)
    sets = sets_of(documents, addresses.join(in_pairs(near), "node"), size)
    links = verified(near, sets, percent)
    root = components(links)
    more = rest(rows, root, percent)
    new = sets_of(documents, addresses.join(in_pairs(more), "node").join(sets.select("node"), "node", "left_anti"), size)
    links = stored(links.union(verified(more, sets.union(new), percent)))
    drop_stored(rows, near, more, sets, new)

    root = nodes.select("node", "n", "k1", "k2", "first_id", "m").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    root = stored(root)
    least = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = stored(root.join(least, "root").select("n", "k1", "k2", "m", "component_id"))
    drop_stored(nodes, links, root)
    slim = own.select("id", "n", "k1", "k2")
    linked = with_counted(slim.where("n > 0"), of, ["n", "k1", "k2"], "m").select("id", "n", "component_id")
    return linked.union(slim.where("n = 0").select("id", "n", "id")).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
