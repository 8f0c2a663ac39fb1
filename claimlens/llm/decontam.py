"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of two units of UNIT words, one unit apart. A passage is a TF-IDF
vector over the benchmark's words; the inverse document frequencies count all documents. A
distributed randomised SVD of the passages of all documents and of the benchmark, each of length one, gives a
latent space of RANK or more dimensions: two rounds of the range finder, each one pass over the documents. The benchmark's rows
together weigh BALANCE times what the documents' rows do, as the leading directions of the documents alone hold a tenth of an item.

Items are compared with every passage by cosine in the latent space, an item of over LONG words also by each of its own passages, cut like
those of documents, as a passage holds too little of it to be like the whole. What reaches NEAR there, which is far less than all
pairs, is compared by its exact cosine, and what reaches COSINE is checked in the text around it by the longest
common subsequence of words, and, where the item is only partly there (a paraphrase), by its answer, the last sentence.
Tests hold the latent search against exact cosines of all pairs; it must find nine in ten.

The benchmark is a stated query set: it is checked in blocks of BLOCK items and passages of items, each in four passes over all
documents, so what is sent to workers is bounded by the block (an item is in one block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short, text_of
from .wordhash import Words, pieces, words

UNIT, BLOCK = 12, 2048
#: Dimensions of the latent space: a third of the queries of a block, within these; more are sketched and then left out.
RANK, MOST_RANK, SPARE = 64, 256, 8
#: Least cosine in the latent space, and how much the benchmark's rows weigh there.
NEAR, BALANCE = 0.4, 4.0
#: Items of more words are searched by their passages too: up to here one passage holds two fifths or more of a copy.
LONG = 5 * UNIT
#: Words in more than this share of the documents are left out of the vectors.
COMMON = 0.1
COSINE = 0.35
#: Share of an item's words, in order, that makes a leak; a smaller share does with the answer.
WHOLE, PART, ANSWER = 0.8, 0.5, 0.9
PAIRS = "doc_id long, item_id long, cosine double, lcs_words long, item_words long, share double, answer boolean"


def _of(texts: list[str]) -> Words:
    return words(pa.array(texts, pa.large_string()), plain=True)


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two rows of word hashes, a bit per item word."""
    masks: dict[int, int] = {}
    for k, h in enumerate(item.tolist()):
        masks[h] = masks.get(h, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for h in text.tolist():
        if m := masks.get(h):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def n_queries(n: int) -> int:
    """Vectors by which an item of n words is searched: the whole, and its passages if it is long."""
    return 1 + (len(range(0, n - UNIT, UNIT)) if n > LONG else 0)


@dataclass
class Items:
    """A block of the benchmark: ids, word hashes, answers' hashes, the vocabulary of the block, and what
    is searched for: word hashes of items and their passages (queries), and the item of each (owner)."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    may: np.ndarray
    queries: list[np.ndarray]
    owner: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Items:
        split = lambda texts: [w.hash[a:b] for w in [_of(texts)] for a, b in zip(w.text[:-1], w.text[1:], strict=True)]
        texts = rows["text"].tolist()
        last = [next((s for s in reversed(re.split(r"[.!?\n]+", t)) if s.strip()), "") for t in texts]
        vocabulary = np.unique(np.concatenate([*split(texts), np.zeros(0, np.uint64)]))
        may = np.zeros(1 << 16, bool)
        may[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        own = split(texts)
        queries = own + [w[a : a + 2 * UNIT] for w in own if len(w) > LONG for a in range(0, len(w) - UNIT, UNIT)]
        owner = np.append(np.arange(len(own)), np.repeat(np.arange(len(own)), [n_queries(len(w)) - 1 for w in own])).astype(np.int64)
        return cls(rows["item_id"].tolist(), own, split(last), vocabulary, may, queries, owner)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words in the vocabulary, and their places in it."""
        at = np.flatnonzero(self.may[(w.hash >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, w.hash[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == w.hash[at]
        return at[same], place[same]


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit its text; for each text its first unit; for each word its unit."""
    n = np.diff(w.text)
    each = -(-n // UNIT)
    first = np.cumsum(each) - each
    text = np.repeat(np.arange(len(n)), n)
    unit = first[text] + (np.arange(int(n.sum())) - w.text[:-1][text]) // UNIT
    return np.repeat(np.arange(len(n)), each), first, unit


def _sums(unit: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of rows by unit, and of each unit with the next one of its text."""
    out = np.zeros((len(of), rows.shape[1]), np.float32)
    if len(unit):
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        out[unit[begin]] = np.add.reduceat(rows, begin)
    more = np.flatnonzero(of[1:] == of[:-1])
    both = out.copy()
    both[more] += out[more + 1]
    return both


@dataclass
class Passages:
    """Passages of some texts: the unit at which each begins, the words of the vocabulary in all units, squared lengths, and which passages can reach the cosine."""

    of: np.ndarray
    first: np.ndarray
    unit: np.ndarray
    place: np.ndarray
    whole: np.ndarray
    some: np.ndarray

    @classmethod
    def read(cls, items: Items, idf: np.ndarray, w: Words, cosine: float) -> Passages | None:
        other = float((idf[idf > 0] ** 2).mean()) if (idf > 0).any() else 1.0
        at, place = items.find(w)
        of, first, unit = _units(w)
        #: What the vocabulary holds counts by its weight, other words by the mean weight.
        energy = np.full(len(w.hash), other, np.float32)
        energy[at] = idf[place] ** 2
        keep = idf[place] > 0
        at, place = at[keep], place[keep]
        if not len(at):
            return None
        pair = lambda x: x + np.where(np.append(of[1:] == of[:-1], False), np.append(x[1:], 0), 0)
        whole = pair(np.bincount(unit, energy, len(of)))
        known = pair(np.bincount(unit[at], energy[at], len(of)))
        #: No cosine exceeds the root of the share that the vocabulary holds.
        some = np.flatnonzero((known >= cosine * cosine * whole) & (known > 0))
        near = np.zeros(len(of), bool)
        near[some] = near[np.minimum(some + 1, len(of) - 1)] = True
        keep = near[unit[at]]
        return cls(of, first, unit[at[keep]], place[keep], whole, some)

    def times(self, rows: np.ndarray) -> np.ndarray:
        """The passages' vectors times rows (already weighted), at the unit that each begins with."""
        return _sums(self.unit, rows[self.place], self.of)


def document_frequency(texts: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and how many documents there are."""
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        count, n = np.zeros(len(own.vocabulary), np.int64), 0
        for b in short(batches):
            for x in pieces(b["text"]):
                w = words(x, plain=True)
                at, place = own.find(w)
                text = np.searchsorted(w.text, at, "right")
                seen = np.unique(text * len(own.vocabulary) + place)
                count += np.bincount(seen % len(own.vocabulary), minlength=len(count))
                n += len(x)
        yield pa.RecordBatch.from_pydict({"place": np.arange(-1, len(count)), "n": np.append(n, count)})

    got = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(items.vocabulary) + 1, np.int64)
    count[got["place"].to_numpy() + 1] = got["n"].to_numpy()
    return count[1:], int(count[0])


def _query_rows(items: Items, idf: np.ndarray) -> np.ndarray:
    """The queries as unit vectors over the vocabulary."""
    out = np.zeros((len(items.queries), len(items.vocabulary)), np.float32)
    for k, x in enumerate(items.queries):
        place = np.searchsorted(items.vocabulary, x)
        np.add.at(out[k], place, idf[place])
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def _query_weights(items: Items, idf: np.ndarray) -> np.ndarray:
    """What each word adds to the cosine with each query: its weight over the length of the query's different words."""
    out = np.zeros((len(items.queries), len(items.vocabulary)), np.float32)
    for k, x in enumerate(items.queries):
        place = np.searchsorted(items.vocabulary, x)
        np.add.at(out[k], place, idf[place])
        out[k] /= max(np.sqrt((idf[np.unique(place)] ** 2).sum()), 1e-9)
    return out


def gram_times(texts: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, int]:
    """A'A basis for the matrix A of the unit passages of all documents that can reach the cosine, and how many there are.

    One pass: each task sums its share, and shares are added by word, so only vocabulary x columns numbers come to the driver.
    """
    size, columns = basis.shape
    shared = texts.sparkSession.sparkContext.broadcast((items, idf, (basis * idf[:, None]).astype(np.float32)))
    width = 32

    def sketch(own: Items, idf: np.ndarray, rows: np.ndarray, w: Words, y: np.ndarray) -> int:
        p = Passages.read(own, idf, w, cosine)
        if p is None or not len(p.some):
            return 0
        seen = np.zeros((len(p.of), columns), np.float32)
        seen[p.some] = p.times(rows)[p.some] / p.whole[p.some][:, None]
        total = seen[p.unit]
        before = np.flatnonzero((p.unit > 0) & (p.of[np.maximum(p.unit - 1, 0)] == p.of[p.unit]))
        total[before] += seen[p.unit[before] - 1]
        total *= idf[p.place][:, None]
        order = np.argsort(p.place, kind="stable")
        begin = np.flatnonzero(np.diff(p.place[order], prepend=-1))
        if len(begin):
            y[p.place[order][begin]] += np.add.reduceat(total[order], begin)
        return len(p.some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale, rows = shared.value
        y, n = np.zeros((size, columns), np.float32), 0
        for b in short(batches):
            for x in pieces(b["text"]):
                n += sketch(own, scale, rows, words(x, plain=True), y)
        some = np.flatnonzero(y.any(1))
        yield pa.RecordBatch.from_pydict({"place": [-1], "part": [0], "y": pa.array([[float(n)]], pa.list_(pa.float64()))})
        for k in range(0, columns, width):
            part = y[some, k : k + width].astype(float)
            yield pa.RecordBatch.from_pydict({"place": some, "part": np.full(len(some), k), "y": pa.array(list(part), pa.list_(pa.float64()))})

    parts = texts.select("text").mapInArrow(run, "place long, part long, y array<double>")
    total = parts.groupBy("place", "part").agg(F.array(*(F.sum(F.get("y", F.lit(k))) for k in range(width))).alias("y")).toPandas()
    y, n = np.zeros((size, columns)), 0
    for place, part, row in zip(total["place"], total["part"], total["y"], strict=True):
        if place < 0:
            n = int(row[0])
        else:
            y[place, part : part + width] = np.asarray(row, float)[: columns - part]
    return y, n


def latent_space(texts: DataFrame, items: Items, idf: np.ndarray, rank: int | None = None, balance: float = BALANCE, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (vocabulary x rank) of the leading right singular vectors of all unit passages and the weighted queries.

    Randomised: Y = A'A Omega, its orthonormal range Q, Y = A'A Q, of which the left singular vectors are the basis.
    """
    size = len(items.vocabulary)
    rank = min(size, max(RANK, min(MOST_RANK, len(items.queries) // 3)) if rank is None else rank)
    own = _query_rows(items, idf)
    y = np.random.default_rng(seed).standard_normal((size, min(size, rank + SPARE)))
    for _ in range(2):
        basis = np.linalg.qr(y)[0].astype(np.float32)
        y, n = gram_times(texts, items, idf, basis)
        y += balance * max(n, 1) / max(len(own), 1) * (own.T @ (own @ basis))
    return np.linalg.svd(y, full_matrices=False)[0][:, :rank].astype(np.float32)


def candidates(p: Passages, rows: np.ndarray, query: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Passages (places in p.some) and queries whose cosine in the latent space is near or more."""
    both = p.times(rows)[p.some]
    both /= np.maximum(np.linalg.norm(both, axis=1), 1e-9)[:, None]
    return np.nonzero(both @ query.T >= near)


def exact_cosines(p: Passages, idf: np.ndarray, weight: np.ndarray, hit: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (places in p.some, queries); weight (vocabulary x queries) has what a word adds to the product."""
    at = np.searchsorted(p.unit, np.stack([p.some[hit], p.some[hit] + 2]))
    last = np.searchsorted(p.unit, p.some[hit] + 1)
    inner = (p.some[hit] + 1 < len(p.of)) & (p.of[np.minimum(p.some[hit] + 1, len(p.of) - 1)] == p.of[p.some[hit]])
    n = np.where(inner, at[1], last) - at[0]
    word = np.repeat(at[0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    pair = np.repeat(np.arange(len(hit)), n)
    product = np.bincount(pair, weight[p.place[word], query[pair]] * idf[p.place[word]], len(hit))
    return product / np.sqrt(p.whole[p.some[hit]])


def _leaks(items: Items, k: int, w: Words, lo: int, hi: int) -> tuple[int, bool] | None:
    """Common words of item k and the words lo to hi, and whether the answer is there; None if no leak."""
    item, answer, text = items.words[k], items.answers[k], w.hash[lo:hi]
    n = common_words(item, text)
    if n < PART * len(item):
        return None
    said = bool(len(answer)) and common_words(answer, text) >= ANSWER * len(answer)
    return (n, said) if n >= WHOLE * len(item) or said else None


def search(texts: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float, near: float = NEAR) -> DataFrame:
    """PAIRS of the documents and items of which a passage passes both cosines and the text checks."""
    weight = np.ascontiguousarray(_query_weights(items, idf).T)
    latent = weight.T @ space
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
    shared = texts.sparkSession.sparkContext.broadcast((items, (space * idf[:, None]).astype(np.float32), idf, latent.astype(np.float32), weight))

    def one(x: pa.Array, ids: list[int | None]) -> Iterator[tuple]:
        own, rows, scale, query, weight = shared.value
        w = words(x, plain=True)
        p = Passages.read(own, scale, w, cosine)
        if p is None or not len(p.some):
            return
        hit, item = candidates(p, rows, query, near)
        like = exact_cosines(p, scale, weight, hit, item)
        keep = like >= cosine
        hit, item, like = hit[keep], item[keep], like[keep]
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for h, k, c in zip(hit.tolist(), own.owner[item].tolist(), like.tolist(), strict=True):
            u = int(p.some[h])
            found.setdefault((int(p.of[u]), k), []).append((u, c))
        for (text, k), seen in sorted(found.items()):
            n = len(own.words[k])
            reach, best = n // UNIT + 2, None
            seen.sort()
            at_u = [u for u, _ in seen]
            cuts = [0] + [j for j in range(1, len(at_u)) if at_u[j] - at_u[j - 1] > reach] + [len(at_u)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                base = int(w.text[text])
                lo = base + (at_u[a] - int(p.first[text])) * UNIT - n
                hi = base + (at_u[b - 1] - int(p.first[text]) + 2) * UNIT + n
                got = _leaks(own, k, w, max(lo, base), min(hi, int(w.text[text + 1])))
                if got and (best is None or got > best):
                    best = got
            if best:
                yield ids[text], own.ids[k], max(s for _, s in seen), best[0], n, best[0] / n, best[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAIRS.split(", ")]
        for b in short(batches):
            got, at = [], 0
            for x in pieces(b["text"]):
                got += one(x, b["doc_id"][at : at + len(x)].to_pylist())
                at += len(x)
            if got:
                columns = dict(zip(names, zip(*got, strict=True), strict=True))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, {"doc_id": pa.int64(), "item_id": pa.int64(), "lcs_words": pa.int64(), "item_words": pa.int64(), "answer": pa.bool_()}.get(k, pa.float64())) for k, v in columns.items()})

    return texts.mapInArrow(run, PAIRS)


def contaminated(documents: DataFrame, benchmark: DataFrame, rank: int | None = None, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """PAIRS: each document (row) and benchmark item of which it holds most, best place only.

    Null texts are read as empty; items without words, or without an id, match nothing, and so do
    empty documents. Rows that repeat give repeated pairs; a null doc_id stays null. Of repeated
    item ids each row is an item. An empty table on either side gives no pairs. Items whose words are
    all common (COMMON) are compared over all their words.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), text_of("text").alias("text"))
    out = None
    held: list[tuple[int, str]] = []
    wanted = 0

    def flush() -> None:
        nonlocal out, wanted
        items = Items.of(pd.DataFrame(held, columns=["item_id", "text"]))
        held.clear()
        wanted = 0
        if len(items.vocabulary):
            seen, n = document_frequency(texts, items)
            idf = np.log((n + 1) / (seen + 1)).astype(np.float32) + np.float32(0.1)
            rare = seen <= max(COMMON * n, 1)
            for own in items.words:  # an item of common words only keeps them
                place = np.searchsorted(items.vocabulary, own)
                if len(place) and not rare[place].any():
                    rare[place] = True
            idf = np.where(rare, idf, 0).astype(np.float32)
            found = search(texts, items, idf, latent_space(texts, items, idf, rank), cosine)
            out = found if out is None else out.union(found)

    for row in rows.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        wanted += n_queries(len(_of([row["text"]]).hash))
        if wanted >= block:
            flush()
    if held:
        flush()
    return spark.createDataFrame([], PAIRS) if out is None else out


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names.

    All rows of a doc_id go if one of them holds an item; rows without a doc_id stay. Empty tables on either side take nothing away.
    """
    ids = contaminated(documents, benchmark).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("leak")).distinct()
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return whole.join(ids, F.col("id") == F.col("leak"), "left_anti").select("row.*")
