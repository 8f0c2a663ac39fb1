"""Phrase collocations level by level: phrases of k words are counted where both of their parts of k - 1 words may be frequent.

Texts are read once and kept as blocks: runs of word numbers of one language, with the block's own list of words. A phrase of k
words can be frequent only if its first and its last k - 1 words are. So level by level, words being the first:

1. Blocks tell places whose two parts are in the filter of the level below. Their hashes' first 32 bits (heads) are added up over all
   blocks, dealt by ranges of heads; the sum of a head is never below the count of a phrase that has it.
2. Phrases whose head reaches the limit are given as texts, with their number, and added up over all blocks, dealt by heads as well;
   what is frequent is kept, with its exact count.
3. A Bloom filter of the frequent ones goes to all tasks. It has all of them and a few others, which only costs counting those.

Counts are of texts, so hashes decide nothing but what is not counted. A task holds one block, two filters and a bounded sum of what it has
found; nothing is sent back to blocks by a join. What tasks send of phrases are Arrow columns, one row for each run and range of
heads. There are 2^32 heads and their sums are spread over all tasks, so a rare phrase does not come to be counted because the input is
larger. Words are all counted in the shuffle: there are few of them, and how many stay would else grow faster than the input.

The first and last k - 1 words of a phrase lead to all its beginnings and ends, so cuts are scored from counts passed up the levels, and a
phrase lies inside a longer one with as many occurrences exactly if it is one of the two parts of such a one of the next level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, partitions, rows_of_batches, short, stored, text_of
from .wordhash import mix, runs
from .wordhash import words as words_of

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of one language in a block; a longer text makes a longer block.
BLOCK = 400_000
#: Rows that a task gets at once; a block is a row of up to a few megabytes.
BATCH = 8
#: Bytes of phrases that a task adds up before it gives them to Spark.
HELD = 8_000_000
#: Heads that a task adds up before it gives them to Spark.
HEADS = 2_000_000
#: Bits of a filter, as powers of two (64 kB to 32 MB), its probes, and the bytes of it that are merged at once.
LEAST_BITS, MOST_BITS, PROBES, SLICE_BYTES = 19, 28, 4, 1 << 16
#: What parts pieces, made a line break, and what parts words, made a space; A-Z are lower-cased.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class _Block:
    """Words of one language, numbered as they come; 0 stands between pieces."""

    def __init__(self):
        self.names: defaultdict[bytes, int] = defaultdict()
        self.names.default_factory = self.names.__len__
        self.names[b"\n"], self.names[b""]  # numbers 0 and 1; the second, between two spaces, is no word
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        tokens = text.translate(BYTES).replace(b"\n", b" \n ").split(b" ")
        run = np.fromiter(map(self.names.__getitem__, tokens), np.int32, len(tokens))
        run = run[run != 1]
        run = _compact(run)
        self.runs += [run, np.zeros(1, np.int32)]
        self.size += len(run)
        return len(run)

    def row(self, lang: str) -> dict:
        seq = np.concatenate(self.runs)
        counts = np.bincount(seq, minlength=len(self.names))
        names = list(self.names)
        some = np.flatnonzero(counts[2:]) + 2
        return {"lang": lang, "words": [names[k].decode() for k in some.tolist()], "counts": counts[some].tolist(), "seq": np.where(seq > 0, seq - 1, 0).astype(np.int32).tobytes()}


def blocks(documents: DataFrame, size: int = BLOCK) -> DataFrame:
    """lang, words, counts, seq: word k of a block, from 1, is k in seq; 0 is the end of a piece."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("seq", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = {}
        total = 0
        for b in short(batches):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                total += held.setdefault(lang, _Block()).add(text.encode())
                if total > size:
                    largest = max(held, key=lambda k: held[k].size)
                    total -= held[largest].size
                    yield made([held.pop(largest).row(largest)])
        for lang, x in held.items():
            yield made([x.row(lang)])

    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "lang string, words array<string>, counts array<long>, seq binary")


def _compact(seq: np.ndarray) -> np.ndarray:
    """With one 0 between runs of names: what stands in between is of no use to longer phrases."""
    return seq[(seq > 0) | np.append(False, seq[:-1] > 0)].astype(np.int32)


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(lang.encode()[:8], "little"))


class _Known:
    """A Bloom filter of phrases of one length by their hashes: all of them are in it, and a few others."""

    def __init__(self, size: int):
        self.size, self.bits = size, np.zeros(1 << size - 3, np.uint8)

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = mix(hashes) | np.uint64(1)
        for k in range(PROBES):
            yield ((hashes + np.uint64(k) * step) >> np.uint64(64 - self.size)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _phrase_hashes(b: pa.RecordBatch, k: int) -> np.ndarray:
    """Of phrases of k words, the same as in blocks."""
    each = words_of(b["phrase"]).hash.reshape(-1, k)
    langs = b["lang"].dictionary_encode()
    seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    return runs((each ^ seeds[:, None]).ravel(), k)[::k]


def _size(n: int) -> int:
    """Of a filter for n hashes: 16 bits for each, up to 2^MOST_BITS in all, beyond which it is less sharp."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


def known(names: DataFrame, k: int) -> _Known:
    """The filter of all phrases (lang, phrase) of k words."""
    size = _size(names.count())
    whole = _Known(size)

    def sliced(bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(bits), SLICE_BYTES):
            if (part := bits[first : first + SLICE_BYTES]).any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([first // SLICE_BYTES], pa.int32()), "bits": [part.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Known(size)
        for b in short(batches, 20_000):
            own.add(_phrase_hashes(b, k))
        yield from sliced(own.bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, bits in zip(b["slice"].to_pylist(), b["bits"].to_pylist(), strict=True):
                held[at] = np.frombuffer(bits, np.uint8) | held.get(at, np.uint8(0))
        for at, bits in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "bits": [bits.tobytes()]})

    kind = "slice int, bits binary"
    for r in names.select("lang", "phrase").mapInArrow(run, kind).repartition("slice").mapInArrow(add, kind).collect():  # 2^MOST_BITS bits at most
        whole.bits[r["slice"] * SLICE_BYTES :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return whole


def _heads(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _whole(heads: np.ndarray) -> np.ndarray:
    """Heads as the hashes by which a filter has them."""
    return heads.astype(np.uint64) << np.uint64(32)


def _ranges(heads: np.ndarray, parts: int) -> list[int]:
    """Where sorted heads are cut into so many ranges of equal width."""
    return np.searchsorted(heads.astype(np.uint64) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1)).tolist()


def _added(heads: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each head once, in order, and the sum of its numbers, or how often it is there."""
    order = None if n is None else np.argsort(heads, kind="stable")
    heads = np.sort(heads) if n is None else heads[order]
    first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
    if n is None:
        return heads[first], np.diff(np.append(first, len(heads)))
    return heads[first], np.add.reduceat(n[order], first) if len(first) else n


def head_sums(own: DataFrame, counted, least: int, parts: int) -> DataFrame:
    """heads, n: the heads of all blocks that occur `least` times and how often, as arrays in bytes; counted(batch) gives the hashes of a block's places.

    A task sends sums of HEADS places, one row for each range of heads. Ranges are added up where they meet, so a task holds its share of
    the different heads, which more partitions make smaller.
    """

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        heads, n = _added(np.concatenate(held))
        at = _ranges(heads, parts)
        some = [k for k in range(parts) if at[k] < at[k + 1]]
        n = n.astype(np.uint32)
        if some:
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "heads": [heads[at[k] : at[k + 1]].tobytes() for k in some], "n": [n[at[k] : at[k + 1]].tobytes() for k in some]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in short(batches, 1):
            held.append(_heads(counted(b)))
            if sum(map(len, held)) > HEADS:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0, 0
        together = lambda: _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for b in batches:
            for heads, n in zip(b["heads"].to_pylist(), b["n"].to_pylist(), strict=True):
                held.append((np.frombuffer(heads, np.uint32), np.frombuffer(n, np.uint32).astype(np.int64)))
                size += len(held[-1][0])
            if size > max(HEADS, 2 * before):
                held = [together()]
                size = before = len(held[0][0])
        heads, n = together()
        heads, n = heads[n >= least], n[n >= least]
        for k in range(0, len(heads), HEADS):
            yield pa.RecordBatch.from_pydict({"heads": [heads[k : k + HEADS].tobytes()], "n": [n[k : k + HEADS].tobytes()]})

    return own.mapInArrow(run, "part int, heads binary, n binary").repartitionById(parts, "part").mapInArrow(add, "heads binary, n binary")


def _often(rows: DataFrame, k: int, below: _Known, least: int) -> _Known:
    """The filter of the heads that `least` places of candidates and more have."""
    heads = stored(head_sums(rows, lambda b: _candidates(b, k, below)[2], least, partitions(rows.sparkSession)), tidy=True)
    n = heads.agg(F.sum(F.octet_length("heads"))).first()[0] or 0
    often = _Known(_size(n // 4))
    for r in heads.select("heads").toLocalIterator():  # no more than a filter's slices have, and one partition at a time
        often.add(_whole(np.frombuffer(r["heads"], np.uint32)))
    drop_stored(heads)
    return often


def _word_hashes(b: pa.RecordBatch) -> np.ndarray:
    return words_of(b["words"].flatten()).hash ^ _seed(b["lang"][0].as_py())


def _together(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def _summed(found: Iterator[tuple[str, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of what blocks give, added up while it fits HELD bytes; Spark adds up the rest."""
    held: list[pa.Table] = []
    size = 0
    added = lambda: _together(held)
    for lang, phrase, n in found:
        held.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)), "phrase": phrase, "n": pa.array(n, pa.int64())}))
        size += held[-1].nbytes
        if size > HELD:
            held = [added()]
            size = held[0].nbytes
            if size > HELD // 2:
                yield from held[0].to_batches(20_000)
                held, size = [], 0
    if held:
        yield from added().to_batches(20_000)


def words_in(own: DataFrame) -> DataFrame:
    """lang, phrase, n: the words of blocks; a word has several rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        for b in short(batches, 1):
            yield b["lang"][0].as_py(), b["words"].flatten(), b["counts"].flatten().to_numpy()

    return own.select("lang", "words", "counts").mapInArrow(lambda batches: _summed(found(batches)), "lang string, phrase string, n long")


def _candidates(b: pa.RecordBatch, k: int, below: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seq of a block, places where a phrase of k words begins whose first and last k - 1 words may both be frequent, and its hashes."""
    seq = np.frombuffer(b["seq"][0].as_py(), np.int32)
    each = np.append(np.uint64(0), _word_hashes(b))
    if k == 2:  # words are tried once for the block instead of at each place, and rare ones part runs
        some = np.append(False, below.has(runs(each[1:], 1)))
        seq = _compact(np.where(some[seq], seq, 0))
    m = max(len(seq) - k + 1, 0)
    whole = np.ones(m, bool)
    for j in range(k):
        whole &= seq[j : j + m] > 0
    at, each = np.flatnonzero(whole), each[seq]
    if k > 2 and len(at):
        low = np.union1d(at, at + 1)
        fine = np.zeros(m + 1, bool)
        fine[low] = below.has(runs(each, k - 1)[low])
        at = at[fine[at] & fine[at + 1]]
    return seq, at, runs(each, k)[at] if len(at) else np.zeros(0, np.uint64)


def _different(seq: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of one phrase each, and how often it is there. Phrases of one hash are compared word by word."""
    _, first, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    one = at[first]
    if all((seq[at + j] == seq[one[which] + j]).all() for j in range(k)):
        return one, n
    _, first, n = np.unique(np.stack([seq[at + j] for j in range(k)], axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], n


def _texts(words: pa.Array, ids: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
    """The phrases of rows of word numbers (from 1), in runs of about HELD bytes."""
    length = np.append(0, pc.binary_length(words).to_numpy(zero_copy_only=False))
    ends = np.cumsum(length[ids].sum(axis=1) + ids.shape[1])
    begin = 0
    while begin < len(ids):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD, "right")))
        yield slice(begin, end), pc.binary_join_element_wise(*(words.take(pa.array(c - 1)) for c in ids[begin:end].T), " ")
        begin = end


def _found(batches: Iterator[pa.RecordBatch], k: int, below: _Known, often: _Known) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for b in short(batches, 1):
        seq, at, hashes = _candidates(b, k, below)
        some = often.has(_whole(_heads(hashes)))
        at, n = _different(seq, at[some], hashes[some], k)
        for part, phrase in _texts(b["words"].flatten(), np.stack([seq[at + j] for j in range(k)], axis=1)):
            yield b["lang"][0].as_py(), phrase, n[part]


def phrases_in(own: DataFrame, k: int, below: _Known, least: int) -> DataFrame:
    """lang, phrase, n: phrases of k words in blocks whose two parts may be frequent, but for those that are certainly too rare; a phrase has several rows."""
    rows = own.select("lang", "words", "seq")
    often = _often(rows, k, below, least)
    return rows.mapInArrow(lambda batches: _summed(_found(batches, k, below, often)), "lang string, phrase string, n long")


def phrase_sums(own: DataFrame, k: int, below: _Known, least: int) -> DataFrame:
    """lang, phrase, f: phrases_in added up, those that occur `least` times.

    What a task sends are sums of what it has read: arrays, one row for each range of heads, and at most one element for a block and phrase.
    """
    rows = own.select("lang", "words", "seq")
    often, parts = _often(rows, k, below, least), partitions(own.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _summed(_found(batches, k, below, often)):
            heads = _heads(_phrase_hashes(b, k))
            order = np.argsort(heads)
            at = _ranges(heads[order], parts)
            some = [x for x in range(parts) if at[x] < at[x + 1]]
            cuts = pa.array([*(at[x] for x in some), b.num_rows], pa.int32())  # what lies between is empty
            b = b.take(pa.array(order))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), **{c: pa.ListArray.from_arrays(cuts, b[c]) for c in ("lang", "phrase", "n")}})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, 0
        for b in batches:
            held.append(pa.table({c: b[c].flatten() for c in ("lang", "phrase", "n")}))
            size += held[-1].nbytes
            if size > max(HELD, 2 * before):
                held = [_together(held)]
                size = before = held[0].nbytes
        if held:
            whole = _together(held).rename_columns(["lang", "phrase", "f"])
            yield from whole.filter(pc.field("f") >= least).to_batches(20_000)

    sent = rows.mapInArrow(run, "part int, lang array<string>, phrase array<string>, n array<long>")
    return sent.repartitionById(parts, "part").mapInArrow(add, "lang string, phrase string, f long")


def frequent(counted: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of the phrases that occur `least` times."""
    return stored(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), tidy=True)


def _up(names: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """lang, phrase, f, a, b, heads, tails: a, b are the first and last k - 1 words, heads[j], tails[j] the counts of the first and last j + 1."""
    left = below.select("lang", F.col("phrase").alias("a"), "heads")
    right = below.select("lang", F.col("phrase").alias("b"), "tails")
    x = names.withColumns({"a": F.substring_index("phrase", " ", k - 1), "b": F.substring_index("phrase", " ", 1 - k)}).join(left, ["lang", "a"]).join(right, ["lang", "b"])
    own = F.array("f")
    return x.select("lang", "phrase", "f", "a", "b", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails"))


def phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of two words and more, with k, their number of words, and within, whether a longer one holds them as often.

    Also lang, n: the words of each language.
    """
    with rows_of_batches(documents.sparkSession, BATCH):
        return _phrases(documents, longest, least, block)


def _phrases(documents: DataFrame, longest: int, least: int, block: int) -> tuple[DataFrame, DataFrame]:
    own = stored(blocks(documents, block), tidy=True)
    totals = stored(own.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")))
    names = frequent(words_in(own), least)
    up = names.select("lang", "phrase", "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels = []
    for k in range(2, longest + 1):
        new = stored(phrase_sums(own, k, known(names, k - 1), least), tidy=True)
        up = stored(_up(new, up, k), tidy=True)
        levels.append(up.withColumn("k", F.lit(k)))
        drop_stored(names)
        names = new
    drop_stored(names, own)
    out = []
    for now, above in zip(levels, [*levels[1:], None], strict=True):
        if above is None:
            out.append(now.withColumn("within", F.lit(False)))
            continue
        most = above.select("lang", F.col("a").alias("phrase"), F.col("f").alias("m")).union(above.select("lang", "b", "f")).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
        out.append(now.join(most, ["lang", "phrase"], "left").withColumn("within", F.coalesce(F.col("m") >= F.col("f"), F.lit(False))).drop("m"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole, totals


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language that hold together best, by score, count and phrase.

    A null lang counts as `und`, a null text as empty. Repeated rows and copies count each time. Words may be of any length and hold
    any other character. Other columns are ignored; a language without a frequent phrase has no row, nor has an empty table. Numbers
    are longs; products are decimals of up to 38 digits, which counts of 10^12 do not exceed. The top phrases of a language
    are found in each task first, so no task gets all of them.
    """
    whole, totals = phrases(documents, longest, least, block)
    x = whole.where(~F.col("within")).join(totals, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    x = x.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (wide(F.col("f")) * wide(F.col("n"))))
    cut = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda k: F.struct(
        F.call_function("div", F.col("top"), wide(F.get("heads", k - 1)) * wide(F.get("tails", F.col("k") - k - 1))).alias("score"),
        k.alias("cut"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("k") - k - 1).alias("r"),
    ))
    x = x.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(cut).alias("c")).select("lang", "phrase", "a", "n", "c.l", "c.r", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
