"""Substring dedup by repeated-phrase automata.

A window is WINDOW words of one document; a word goes if a window over it also starts in a document
with a smaller doc_id. In each window the ANCHOR-word run with the smallest hash is its anchor, so equal
windows have equal anchors and only anchors, about a fifth of all positions, are counted.

1. Anchors are counted over all documents (aggregated before the shuffle); those of two or more recur.
   Rows of anchors that very many documents have are dealt to SALTS places each.
2. Each document's recurring anchors give segments: the words that the windows over the anchor cover.
   Equal segments of an anchor are one row with their smallest doc_id, so a passage in any
   number of documents is one row.
3. Segments are sorted by anchor; a worker compiles each few hundred of them, words written as single
   characters, into an Aho-Corasick automaton of their windows with the smallest doc_id of
   each, and streams the segments through it, which locates every occurrence.
4. Occurrences go back to the documents, which are read once more to remove the words.

An anchor in over HEAVY different segments (a common phrase in ever new surroundings) would be one task's load and one list;
its segments are cut into their windows, which are grouped as words, wherever they are, and their smallest doc_ids go back to the segments.

Hashes only choose candidates in steps 1 and 2; segments are grouped and windows compared as words in step 3. On the way back, step 4,
a segment is known by its anchor's hash and a 64-bit hash of its own, a row by its doc_id, a 64-bit hash of its text and its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, drop_stored, short, stored, text_of, with_counted
from .wordhash import Words, pieces, runs, words

WINDOW, ANCHOR = 13, 5
#: Anchor hashes keep this many bits; equal ones by chance cost work, not results.
BITS = 44
#: Segments that share an automaton, few enough for it to stay in the processor's cache; an anchor's segments stay together.
SEGMENTS = 300
NO_ID = (1 << 63) - 1
#: An anchor with more different segments than this is compared window by window.
HEAVY = 50_000
#: The rows of an anchor in over HOT_ROWS documents, of which the first HOT_KEYS count, are dealt to so many places.
SALTS, HOT_KEYS = 64, 10_000


def anchors(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions, hashes and texts of the anchors of all windows, in order, each once."""
    h = runs(w.hash, anchor)
    n, reach = len(w.hash) - window + 1, window - anchor + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    low, at, step = h, np.arange(len(h)), 1
    while step < reach:
        jump = min(step, reach - step)
        less = low[jump:] < low[:-jump]
        at = np.where(less, at[jump:], at[:-jump])
        low = np.where(less, low[jump:], low[:-jump])
        step += jump
    text = np.repeat(np.arange(len(w.text) - 1), np.diff(w.text))
    place = np.unique(at[:n][text[:n] == text[window - 1 :]])
    return place, (h[place] >> np.uint64(64 - BITS)).astype(np.int64), text[place]


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b[n].to_numpy(zero_copy_only=False) for n in names]


def anchor_rows(docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """h, id, tk: the anchors of each document, each once; a hot one with a salt of the document above its BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            ids, keys = _columns(b, "id", "tk")
            at = 0
            for x in pieces(b["text"]):
                _, h, text = anchors(words(x))
                own = np.unique(np.stack([text, h]), axis=1)
                h, id_, tk = own[1], ids[at + own[0]], keys[at + own[0]]
                if hot is not None and len(hot):
                    some = np.isin(h, hot)
                    h[some] += ((id_[some] ^ tk[some] & 0xFFFFFFFF) % SALTS + 1) << BITS
                yield pa.RecordBatch.from_pydict({"h": h, "id": id_, "tk": tk})
                at += len(x)

    return docs.mapInArrow(run, "h long, id long, tk long")


def segment_rows(docs: DataFrame) -> DataFrame:
    """h, sid, seg, id, tk, tl, start of documents with hs, their recurring anchors: the segments around these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            ids, keys, sizes = _columns(b, "id", "tk", "tl")
            hs, offsets = b["hs"].flatten().to_numpy(), b["hs"].offsets.to_numpy() - b["hs"].offsets[0].as_py()
            at = 0
            for x in pieces(b["text"]):
                w = words(x)
                place, h, text = anchors(w)
                own = hs[offsets[at] : offsets[at + len(x)]]
                of = np.repeat(np.arange(len(x)), np.diff(offsets[at : at + len(x) + 1]))
                pair = lambda t, v: t.astype(np.int64) * 0x9E3779B97F4A7C1 ^ v
                some = np.isin(pair(text, h), pair(of, own))
                place, h, text = place[some], h[some], text[some]
                lo = np.maximum(place - (WINDOW - ANCHOR), w.text[:-1][text])
                hi = np.minimum(place + WINDOW, w.text[1:][text])
                data = w.data.tobytes()
                seg = [b" ".join(data[i:j].split()) for i, j in zip(w.begin[lo].tolist(), w.end[hi - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "h": h, "seg": pa.array(seg, pa.binary()).cast(pa.string()), "id": ids[at + text], "tk": keys[at + text], "tl": sizes[at + text],
                    "start": (lo - w.text[:-1][text]).astype(np.int32),
                })
                at += len(x)

    rows = docs.mapInArrow(run, "h long, seg string, id long, tk long, tl int, start int")
    return rows.withColumn("sid", F.xxhash64("seg"))


def locate(segments: list[list[str]], firsts: list[int], window: int = WINDOW) -> list[list[int]]:
    """For each segment and window in it, the smallest doc_id of the segments that hold the window."""
    import ahocorasick

    letters: dict[str, str] = {}

    def letter(word: str) -> str:
        if word not in letters:
            k = len(letters) + 1
            letters[word] = chr(k if k < 0xD800 else k + 0x800)
        return letters[word]

    lines = ["".join(map(letter, s)) for s in segments]
    least: dict[str, int] = {}
    for line, first in zip(lines, firsts, strict=True):
        for k in range(len(line) - window + 1):
            key = line[k : k + window]
            if least.get(key, NO_ID) >= first:
                least[key] = first
    automaton = ahocorasick.Automaton()
    for key, first in least.items():
        automaton.add_word(key, first)
    if not least:
        return [[] for _ in segments]
    automaton.make_automaton()
    return [[first for _, first in automaton.iter(line)] for line in lines]


def located(distinct: DataFrame) -> DataFrame:
    """h, sid, firsts of rows (h, sid, seg, first), of which an anchor's rows are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            split = [r[2].split(" ") for r in rows]
            #: An anchor with one segment only has one smallest doc_id for all its windows.
            alone = [(k == 0 or rows[k - 1][0] != r[0]) and (k + 1 == len(rows) or rows[k + 1][0] != r[0]) for k, r in enumerate(rows)]
            some = [k for k, a in enumerate(alone) if not a]
            got = [[r[3]] * (len(w) - WINDOW + 1) for r, w in zip(rows, split, strict=True)]
            for k, firsts in zip(some, locate([split[k] for k in some], [rows[k][3] for k in some]), strict=True):
                got[k] = firsts
            return pa.RecordBatch.from_pydict({"h": [r[0] for r in rows], "sid": [r[1] for r in rows], "firsts": pa.array(got, pa.list_(pa.int64()))})

        for b in short(batches):
            held += zip(*(b[c].to_pylist() for c in ("h", "sid", "seg", "first")), strict=True)
            if len(held) >= SEGMENTS:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield flush(held[:cut])
                    held = held[cut:]
        if held:
            yield flush(held)

    return distinct.mapInArrow(run, "h long, sid long, firsts array<long>")


def _salted(table: DataFrame, hot: DataFrame) -> DataFrame:
    """table with a row for each salt of its hot anchors; the salt stands above the BITS bits of the hash."""
    few = F.broadcast(hot.select(F.col("h").alias("hot_h")))
    copies = F.when(F.col("hot_h").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(SALTS)))
    return table.join(few, F.col("h") == F.col("hot_h"), "left").withColumn("copy", F.explode(copies)).withColumn("h", F.col("h") + F.col("copy") * F.lit(1 << BITS)).drop("hot_h", "copy")


def _by_windows(segments: DataFrame) -> DataFrame:
    """h, sid, firsts of rows (h, sid, seg, first): the windows are grouped as words."""
    split = F.split("seg", " ")
    each = F.transform(F.sequence(F.lit(0), F.size(split) - WINDOW), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(split, k + 1, F.lit(WINDOW)), " ").alias("window")))
    windows = segments.select("h", "sid", "first", F.inline(each))
    least = stored(windows.groupBy("window").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    back = with_counted(windows.select("h", "sid", "k", "window"), least, ["window"])
    told = F.array_sort(F.collect_list(F.struct("k", "least")))
    return back.groupBy("h", "sid").agg(F.transform(told, lambda x: x["least"]).alias("firsts"))


def repeats(docs: DataFrame, most: int = HEAVY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, tk, tl, marks (start, bits of the windows from there) of rows (id, tk, tl, text).

    Rows that share id and tk by chance share a list of recurring anchors, of which each finds its own; all else is told apart by tl as well.
    """
    counted = anchor_rows(docs).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    recurring = stored(counted.where("lo < hi").select("h", "n"), tidy=True)
    hot = stored(recurring.where(F.col("n") > hot_rows).orderBy(F.desc("n"), "h").limit(HOT_KEYS).select("h"))
    few = np.array([r["h"] for r in hot.collect()], np.int64)  # HOT_KEYS at most
    found = anchor_rows(docs, few).join(_salted(recurring.select("h"), hot), "h").withColumn("h", F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)))
    lists = stored(found.groupBy("id", "tk").agg(F.collect_list("h").alias("hs")), tidy=True)
    segments = stored(segment_rows(docs.join(lists, ["id", "tk"]).select("id", "tk", "tl", "text", "hs")), tidy=True)
    drop_stored(lists, recurring)
    distinct = stored(segments.groupBy("h", "sid", "seg").agg(F.min("id").alias("first")), tidy=True)
    heavy = stored(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("h").alias("heavy_h")), tidy=True)
    of_heavy = F.col("h") == F.col("heavy_h")
    some = bool(heavy.limit(1).count())
    light = distinct.join(heavy, of_heavy, "left_anti") if some else distinct
    firsts = located(light.repartition("h").sortWithinPartitions("h").select("h", "sid", "seg", "first"))
    firsts = stored(firsts.unionByName(_by_windows(distinct.join(heavy, of_heavy, "left_semi"))) if some else firsts, tidy=True)
    drop_stored(distinct, heavy)
    bits = F.aggregate(
        F.transform("firsts", lambda f, k: F.when(f < F.col("id"), F.pow(F.lit(2), k)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    ).cast("int")
    is_hot = F.col("hot_h").isNotNull()
    salt = (F.pmod(F.xxhash64("id", "tk"), F.lit(SALTS)) + 1) * F.lit(1 << BITS)
    dealt = segments.select("h", "sid", "id", "tk", "tl", "start").join(F.broadcast(hot.select(F.col("h").alias("hot_h"))), F.col("h") == F.col("hot_h"), "left")
    dealt = dealt.withColumn("h", F.when(is_hot, F.col("h") + salt).otherwise(F.col("h"))).drop("hot_h")
    marks = stored(
        dealt.join(_salted(firsts, hot), ["h", "sid"]).select("id", "tk", "tl", "start", bits.alias("bits")).where("bits > 0")
        .groupBy("id", "tk", "tl").agg(F.collect_set(F.struct("start", "bits")).alias("marks")), tidy=True
    )
    drop_stored(segments, firsts, hot)
    return marks


def text_key() -> Column:
    return F.xxhash64("text")


def remove_repeats(documents: DataFrame, heavy: int = HEAVY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space): one row for each row.

    A null text is read as empty. A row without a doc_id counts as later than all others and is never
    a source. Rows with one doc_id are one document and do not remove each other's words. Texts of
    fewer than WINDOW words lose nothing. Other columns are dropped; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of("text").alias("text"))
    docs = docs.withColumns({"tk": text_key(), "tl": F.octet_length("text")})  # part rows with one doc_id and different texts
    marked = docs.join(repeats(docs, heavy, hot_rows), ["id", "tk", "tl"], "left").select("id", "text", F.col("marks.start").alias("starts"), F.col("marks.bits").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            n, gone, kept = [], [], []
            for text, starts, bits in zip(b["text"].to_pylist(), b["starts"].to_pylist(), b["bits"].to_pylist(), strict=True):
                own = text.encode().split()
                n.append(len(own))
                if starts:
                    edge = np.zeros(len(own) + 1, np.int64)
                    at, mask = np.array(starts), np.array(bits)
                    for k in range(WINDOW - ANCHOR + 1):
                        hit = at[(mask >> k) & 1 == 1] + k
                        hit = hit[hit + WINDOW <= len(own)]
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + WINDOW, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    own = [w for w, s in zip(own, stay.tolist(), strict=True) if s]
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_pydict({"id": b["id"], "n_words": n, "n_removed": gone, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    out = marked.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def removed_by_hand(rows: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract word by word on the driver, for tests."""
    first: dict[tuple[bytes, ...], int] = {}
    split = {d: t.encode().split() for d, t in rows}
    for d, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
