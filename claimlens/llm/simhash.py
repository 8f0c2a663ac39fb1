"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most two
bits agree on at least two blocks, so each pair of blocks is a join key of 32 bits. Equal
fingerprints are one node, which takes in all copies before anything is joined. A key with up to
GROUP nodes is compared within its group, and a link is made by the first key on which its two ends
agree. In a larger group every node is put under itself and its 32 one-bit changes outside the
key: nodes under one such value differ in at most two bits, and any two that do meet under one, so
the group's rows stay in proportion to its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, let, stored, text_of, with_counted
from .components import components

SHINGLE, SEED, MAX_BITS, BLOCKS = 3, 42, 2, 4
#: Nodes of a key that are compared with each other; more go by one-bit changes.
GROUP = 512


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE, *more: Column) -> DataFrame:
    """doc_id, fp (long) and more, one row for each row of documents."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([fingerprint(t, size) for t in b], dtype="int64")

    return documents.select(F.col("doc_id").cast("long"), fp(text_of("text")).alias("fp"), *more)


def _masks() -> list[int]:
    """For each two blocks, the bits of both, as a signed number."""
    width = 64 // BLOCKS
    block = lambda k: ((1 << width) - 1) << (k * width)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(block(i) | block(j)) for i, j in combinations(range(BLOCKS), BLOCKS - MAX_BITS)]


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """a, b: pairs of fingerprints with up to MAX_BITS different bits, or stars that join the same ones."""
    masks = _masks()
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    keyed = nodes.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)
    ))).alias("k")).select("fp", "k.part", "k.key")
    sizes = stored(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = with_counted(keyed, sizes, ["part", "key"])

    def first_here(x: Column, part: Column) -> Column:
        """No earlier pair of blocks agrees, so the link is not made twice."""
        return ~F.exists(F.slice(table, F.lit(1), part), lambda m: x.bitwiseAND(m) == 0)

    def pairs(fps: Column, part: Column) -> Column:
        return F.flatten(F.transform(fps, lambda a: F.transform(
            F.filter(fps, lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS) & first_here(a.bitwiseXOR(b), part)),
            lambda b: F.struct(a.alias("a"), b.alias("b")),
        )))

    small = (
        shared.where(F.col("n") <= group).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
        .select(F.inline(let(F.struct("fps", "part"), lambda x: pairs(x["fps"], x["part"]))))
    )
    free = [[F.lit(0).cast("long")] + [F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long") for b in range(64) if not (m >> b) & 1] for m in masks]
    flips = F.element_at(F.array(*(F.array(*bits) for bits in free)), F.col("part") + 1)
    near = shared.where(F.col("n") > group).select("part", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("near"), "fp")
    star = near.groupBy("part", "near").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1).select(
        F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b")
    )
    return small.union(star)


def _roots(prints: DataFrame, group: int) -> DataFrame:
    """fp, m (its rows), root (the smallest fingerprint of its component), component_id; one row for each fingerprint."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m")))
    roots = components(links(nodes, group))
    joined = stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "m", F.coalesce("root", "fp").alias("root")))
    least = stored(joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    of = stored(with_counted(joined, least, ["root"]).select("fp", "m", "root", "component_id"))
    drop_stored(nodes, joined, least)
    return of


def near_duplicates(documents: DataFrame, size: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    One row for each row of documents; other columns are dropped. A null text has no words, like an
    empty one: its fingerprint is zero and links like any other. A row with a null doc_id takes part
    in links and gets the smallest known id of its component, null if there is none. Rows that
    repeat share their component. An empty table gives an empty result.
    """
    prints = stored(fingerprints(documents, size))
    return with_counted(prints, _roots(prints, group), ["fp"], "m").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each component, with all columns: of those with the smallest doc_id, the text with the smallest hash.

    Rows without a doc_id come after all others, so one stays if its component has no doc_id at all.
    A doc_id that stands for texts of several components can stay once in each of them. Of rows that have both the id and the
    text that with the smallest hash of all its columns stays. Empty and null texts are one component. An empty table gives an empty one.
    """
    text = F.xxhash64(text_of("text"))
    prints = stored(fingerprints(documents, size, text.alias("th")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    firsts = (
        prints.groupBy("fp").agg(first).join(_roots(prints, GROUP), "fp").groupBy("root").agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("id_of"), F.col("first.th").alias("th_of"))
    )
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("th"))
    kept = whole.join(firsts, F.col("id").eqNullSafe(F.col("id_of")) & (F.col("th") == F.col("th_of")), "left_semi")
    return kept.groupBy("id", "th").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
