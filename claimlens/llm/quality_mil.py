"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by a layer over two parts: the mean of the learnt
vectors of its words (WORDS hashed buckets of WIDTH numbers), and counts of its bytes by class, of its words, and of how much of it the
document says more than once. Gated attention, tanh times sigmoid, weighs the passages; a logistic unit scores the weighted passage
representation. Word vectors and all weights are learnt together from document labels, by Adam in numpy, on at most
TRAIN_DOCS labelled documents. Every passage of a text counts, in training and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short, text_of
from .labelled import remainder, sample
from .wordhash import pieces, runs, words

PASSAGE, HIDDEN, GATE = 64, 16, 8
WORDS, WIDTH = 2048, 6
TRAIN_DOCS, STEPS, RATE, DECAY = 4000, 120, 0.02, 1e-4
THRESHOLD = 0.3

#: The classes of ASCII bytes that a passage is counted by.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&", "|", "!?", ".,;:", "'\"`", "()[]{}", "<>/\\=", "\n", "@_-+~^"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _k
_CLASS[list(b" \t\r\x0b\x0c")] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
N_FEATURES = N_CLASSES + 9


@dataclass
class Bags:
    """Features of passages, the first passage of each text (a text has at least one), and the bucket and the passage of each word."""

    x: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    passage: np.ndarray

    @classmethod
    def joined(cls, parts: list[Bags]) -> Bags:
        shift = np.cumsum([0] + [len(p.x) for p in parts])
        return cls(
            np.concatenate([p.x for p in parts]), np.concatenate([p.first + s for p, s in zip(parts, shift, strict=False)]),
            np.concatenate([p.bucket for p in parts]), np.concatenate([p.passage + s for p, s in zip(parts, shift, strict=False)]),
        )


def passages(texts: pa.Array) -> Bags:
    """The passages of texts as bags."""
    w = words(texts)
    n_words = np.diff(w.text)
    each = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(each) - each
    total = int(each.sum())
    of = np.repeat(np.arange(len(n_words)), each)
    inside = np.arange(total) - first[of]
    start = w.text[:-1][of] + inside * PASSAGE
    stop = np.minimum(start + PASSAGE, w.text[1:][of])
    n = np.maximum(stop - start, 0)
    #: A passage's bytes run up to the next one's first word; a text's first starts with the text.
    lead = np.where(inside == 0, w.edge[:-1][of], w.begin[np.minimum(start, len(w.begin) - 1)] if len(w.begin) else 0)
    tail = np.append(lead[1:], w.edge[-1])
    tail = np.where(np.append(of[1:] != of[:-1], True), w.edge[1:][of], tail)
    owner = np.repeat(np.arange(total), tail - lead)
    counts = np.bincount(owner * N_CLASSES + _CLASS[w.data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    size = np.maximum(counts.sum(1), 1)[:, None]

    passage = np.repeat(np.arange(total), n)
    out = np.zeros((total, N_FEATURES))
    out[:, :N_CLASSES] = np.sqrt(counts / size)
    wide = np.maximum(n, 1)
    if len(w.hash):
        text = np.repeat(np.arange(len(n_words)), n_words)
        length = w.end - w.begin
        upper = np.isin(w.data[w.begin], np.arange(65, 91))
        last = w.data[w.end - 1]
        mark = ~(np.isin(last, np.arange(48, 58)) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))
        mean = lambda x: np.bincount(passage, x, total) / wide
        own = np.unique(passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.hash, return_index=True)[1]
        out[:, N_CLASSES] = np.bincount(passage[own], minlength=total) / wide
        out[:, N_CLASSES + 1] = mean(length) / 10
        out[:, N_CLASSES + 2] = np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length) ** 2, 0)) / 10
        out[:, N_CLASSES + 3] = mean(upper)
        out[:, N_CLASSES + 4] = mean(mark)
        for k, size_of_run in enumerate((3, 8)):
            run = runs(w.hash, size_of_run)
            if len(run):
                whole = text[: len(run)] == text[size_of_run - 1 :]
                keyed = run ^ (text[: len(run)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                _, back, often = np.unique(keyed, return_inverse=True, return_counts=True)
                again = np.append((often[back] > 1) & whole, np.zeros(size_of_run - 1, bool))
                out[:, N_CLASSES + 5 + k] = mean(again)
    out[:, N_CLASSES + 7] = np.log1p(n) / 5
    out[:, N_CLASSES + 8] = np.log1p(n_words[of]) / 10
    return Bags(out, first, (w.hash % np.uint64(WORDS)).astype(np.int64), passage)


class Network:
    """Word vectors, passage encoder, gated attention and logistic score."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.centre, self.scale = np.zeros(n), np.ones(n)
        self.p = {
            "word": rng.standard_normal((WORDS, WIDTH)) * 0.01, "encode": draw(n + WIDTH, HIDDEN), "encode_b": np.zeros(HIDDEN), "tanh": draw(HIDDEN, GATE), "sigmoid": draw(HIDDEN, GATE),
            "weigh": draw(GATE, 1), "score": draw(HIDDEN, 1), "score_b": np.zeros(1),
        }

    def forward(self, bags: Bags):
        p, first = self.p, bags.first
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bags.x))))
        part = 1 / np.maximum(np.bincount(bags.passage, minlength=len(bags.x)), 1)
        said = np.stack([np.bincount(bags.passage, p["word"][bags.bucket, d], len(bags.x)) for d in range(WIDTH)], 1) * part[:, None]
        x = np.hstack([(bags.x - self.centre) / self.scale, said])
        h = np.tanh(x @ p["encode"] + p["encode_b"])
        t = np.tanh(h @ p["tanh"])
        s = 1 / (1 + np.exp(-(h @ p["sigmoid"])))
        e = ((t * s) @ p["weigh"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        a = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(a[:, None] * h, first)
        return of, part, x, h, t, s, a, z, (z @ p["score"] + p["score_b"])[:, 0]

    def gradients(self, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, bags.first
        of, part, x, h, t, s, a, z, logit = self.forward(bags)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y))[:, None]
        d_z = d @ p["score"].T
        d_h = a[:, None] * d_z[of]
        pull = (h * d_z[of]).sum(1)
        d_e = (a * (pull - np.add.reduceat(a * pull, first)[of]))[:, None]
        d_ts = d_e @ p["weigh"].T
        d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_h = d_h + d_t @ p["tanh"].T + d_s @ p["sigmoid"].T
        d_x = d_h * (1 - h * h)
        d_said = (d_x @ p["encode"][-WIDTH:].T) * part[:, None]
        word = np.stack([np.bincount(bags.bucket, d_said[bags.passage, k], WORDS) for k in range(WIDTH)], 1)
        return {
            "word": word, "encode": x.T @ d_x, "encode_b": d_x.sum(0), "tanh": h.T @ d_t, "sigmoid": h.T @ d_s,
            "weigh": (t * s).T @ d_e, "score": z.T @ d, "score_b": d.sum(0),
        }

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(passages(texts))[-1]))


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> Network:
    """Fit the network; without both labels the score is near the share of label 1."""
    y = np.asarray(labels, float)
    net = Network(N_FEATURES)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.p["score_b"][:] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        net.p["score"][:] = 0
        return net
    bags = Bags.joined([passages(x) for x in pieces(pa.array(texts, pa.string()))])
    net.centre, net.scale = bags.x.mean(0), bags.x.std(0) + 0.05
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        for k, g in net.gradients(bags, y).items():
            m, v = state[k]
            g = g + DECAY * net.p[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (0 to 1, higher: good): one row for each row; a null text is read as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in short(batches):
            got = [own(x) for x in pieces(b["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": np.concatenate(got) if got else np.zeros(0)})

    return documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows whose crc32 modulo 5 is not 0.

    One result row for each row of documents. Empty and null texts get the score of an empty passage.
    No labels give a constant score. Other columns are dropped; an empty table gives an empty result.
    """
    held = remainder(5) == 0
    rows = sample(documents, labels, "quality", held, train_docs)
    return (
        score(documents, train(rows["text"].tolist(), rows["label"].to_numpy()))
        .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
