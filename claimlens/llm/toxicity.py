"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character 3- to 6-grams (with word ends) and of the word
itself, all hashed into one table, so an unseen misspelling shares most of its vectors with the word it
comes from. A passage of PASSAGE words is the average of its words (padded with zeros), a linear
softmax gives its log-odds, and a text's log-odds are the log-sum-exp over its passages, so one
passage decides in a text of any length. Table and softmax are trained jointly in numpy
from at most TRAIN_DOCS labelled documents, up to half of them toxic and weighted back to their share, by Adam, from a start at which the first dimension holds
how far a bucket exceeds chance in texts of label 1.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from string import punctuation
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short, text_of
from .labelled import remainder, sample

BUCKETS, WIDTH, PASSAGE = 1 << 17, 4, 16
TRAIN_DOCS, STEPS, RATE, DECAY = 2500, 40, 0.4, 1e-5
#: Standard deviations by which a bucket's texts must exceed chance to give it a start.
START = 3.0
#: Buckets of fewer training texts stay at zero; they would only be learnt by heart.
LEAST_TEXTS = 12
THRESHOLD = 0.3
#: Words whose value a worker remembers before it starts afresh, and bytes of text handled at once.
REMEMBERED, CHUNK = 400_000, 4_000_000


def grams(word: str) -> list[int]:
    """Buckets of the word, without punctuation at its ends, and of its character 3- to 6-grams."""
    w = f"<{word.strip(punctuation)}>"
    parts = [w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)]
    return [crc32(p.encode("utf-8", "replace")) & (BUCKETS - 1) for p in (w, *parts)]


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word at each position, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets


def passages(offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which passages start, and the first passage of each text; no text is without words."""
    count = np.diff(offsets)
    each = -(-count // size)
    first = np.cumsum(each) - each
    inside = np.arange(each.sum()) - np.repeat(first, each)
    return np.repeat(offsets[:-1], each) + inside * size, first


def pooled(logits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp over each text's passages, and each passage's weight in it."""
    n = np.diff(np.append(first, len(logits)))
    top = np.maximum.reduceat(logits, first)
    raised = np.exp(logits - np.repeat(top, n))
    total = np.add.reduceat(raised, first)
    return top + np.log(total), raised / np.repeat(total, n)


class Bag:
    """The trained model, reduced to one number per bucket and a bias."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), float(bias)

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        ids = [grams(w) if w else [] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((g for i in ids for g in i), np.int64, int(size.sum()))
        total = np.bincount(np.repeat(np.arange(len(ids)), size), self.value[flat], len(ids))
        return (total / np.maximum(size, 1)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None, steps: int = STEPS, rate: float = RATE, floor: float = 1e-5, least: int = LEAST_TEXTS, seed: int = 7) -> Bag:
    """Fit the table and the softmax; without both labels the score is the share of label 1."""
    y = np.asarray(labels, float)
    worth = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    share = (y @ worth + 0.5) / (worth.sum() + 1.0)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Bag(np.zeros(BUCKETS), prior)
    words, at, offsets = split(pa.array(texts, pa.string()))
    n_words, size, every = len(words), np.zeros(len(words), np.int32), array("i")
    for k, word in enumerate(words):
        if word:
            found = grams(word)
            size[k] = len(found)
            every.extend(found)
    del words
    flat = np.frombuffer(every, np.int32) if every else np.zeros(0, np.int32)
    begin = np.cumsum(size, dtype=np.int64) - size
    #: In how many texts, and in how many of label 1, each bucket occurs.
    held, toxic, seen = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, one, a, b in zip(y, worth, offsets[:-1], offsets[1:], strict=True):
        own = np.unique(at[a:b])
        n = size[own]
        got = np.unique(flat[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        held[got] += one
        toxic[got] += one * label
        seen[got] += 1
    owner = np.repeat(np.arange(n_words, dtype=np.int32), size)
    part = (1.0 / np.maximum(size, 1)).astype(np.float32)
    enough = seen[flat] >= least
    flat, owner = flat[enough], owner[enough]
    del every, enough
    starts, first = passages(offsets)
    n_passages = np.diff(np.append(first, len(starts)))
    widths = np.diff(np.append(starts, len(at)))

    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, WIDTH)) * 0.01).astype(np.float32)
    soft = np.concatenate([[[-0.5, 0.5]], rng.standard_normal((WIDTH - 1, 2)) * 0.1]).astype(np.float32)
    excess = (toxic - share * held) / np.sqrt(share * held + 1)
    start = np.sign(excess) * np.maximum(np.abs(excess) - START, 0)
    unit = np.add.reduceat((np.bincount(owner, start[flat], n_words) * part)[at], starts) / PASSAGE
    scale, offset = min(
        ((k, b) for k in (0.25, 0.5, 1, 2, 4, 8, 16, 32) for b in np.arange(-14.0, 0.0)),
        key=lambda kb: np.logaddexp(0, np.where(y > 0, -1, 1) * pooled(kb[0] * unit + kb[1], first)[0]) @ worth,
    )
    table[:, 0] += scale * start
    bias = np.array([0.0, offset], np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (table, soft, bias)]
    for step in range(1, steps + 1):
        mean = np.stack([np.add.reduceat((np.bincount(owner, table[flat, d], n_words) * part)[at], starts) for d in range(WIDTH)], 1) / PASSAGE
        both = mean @ soft + bias
        logit, weight = pooled(both[:, 1] - both[:, 0], first)
        error = (1 / (1 + np.exp(-logit)) - y) * worth / worth.sum()
        d_odds = np.repeat(error, n_passages) * weight
        d_both = np.stack([-d_odds, d_odds], 1)
        d_mean = (d_both @ soft.T) / PASSAGE
        d_table = DECAY * table
        for d in range(WIDTH):
            d_word = np.bincount(at, np.repeat(d_mean[:, d], widths), n_words) * part
            d_table[:, d] += np.bincount(flat, d_word[owner], BUCKETS)
        for (p, m, v), g in zip(state, (d_table, mean.T @ d_both, d_both.sum(0)), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + floor)
    return Bag(table @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


class Scorer:
    """Scores texts on a worker, remembering the words that it has met."""

    def __init__(self, bag: Bag):
        self.bag, self.known = bag, {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, at, offsets = split(texts)
        value = np.array([self.known.get(w, np.nan) for w in words], np.float32)
        new = np.flatnonzero(np.isnan(value))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        value[new] = self.bag.words([words[k] for k in new])
        self.known.update((words[k], value[k]) for k in new)
        starts, first = passages(offsets)
        logits = np.add.reduceat(value[at].astype(float), starts) / PASSAGE + self.bag.bias
        return 1 / (1 + np.exp(-pooled(logits, first)[0]))


def pieces(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """texts in runs of about size bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts[at:to]
        at = to


def score(documents: DataFrame, bag: Bag) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic): one row for each row; a null text is read as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(bag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for b in short(batches):
            got = [own(x) for x in pieces(b["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": np.concatenate(got) if got else np.zeros(0)})

    return documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows whose crc32 modulo 4 is not 2.

    One result row for each row of documents. Empty and null texts get the score of an empty text. No
    labels give a constant score. Other columns are dropped; an empty table gives an empty result.
    """
    held = remainder(4) == 2
    rows = sample(documents, labels, "toxic", held, train_docs, balanced=True)
    return (
        score(documents, train(rows["text"].tolist(), rows["label"].to_numpy(), rows["weight"].to_numpy()))
        .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
