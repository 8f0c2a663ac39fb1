"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read here: pieces with scores and kinds, the normaliser's settings and the
byte fallback. A unigram model becomes models.Unigram with its scores; a BPE model becomes
models.BPE, its merges ranked by the score of the piece that they make. The normaliser's character
map, if any, and the metaspace marker are rebuilt as tokenizers components.

If no piece of the model holds the marker after another character, a text can be cut before each
marker without changing its pieces; such texts are cut so, which keeps the merges short. Texts
with runs of markers, and those for other models, are encoded uncut. Batches go to the library
whole, which spreads them over its threads.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short, text_of

#: Where the public tokenizer files are, unless a caller names another model.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces, and kinds of models, of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim_spaces = bool(normaliser.get(4, 1))

    def normaliser(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim_spaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def tokenizer(self):
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        if self.kind != BPE:
            raise ValueError("neither a unigram nor a BPE model")
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        plain = {p: -s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        merges = sorted(
            (rank, cut, piece[:cut], piece[cut:])
            for piece, rank in plain.items()
            for cut in range(1, len(piece))
            if piece[:cut] in plain and piece[cut:] in plain
        )
        return Tokenizer(models.BPE(
            ids, [(a, b) for _, _, a, b in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback,
        ))

    def cuttable(self) -> bool:
        """Whether no piece holds the marker after another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class Codec:
    """Encodes and decodes by one model; made once per worker."""

    def __init__(self, path: str):
        self.model = Model(path)
        from tokenizers import pre_tokenizers

        self.whole, self.cut = self.model.tokenizer(), self.model.tokenizer()
        self.cut.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.cuttable = self.model.cuttable()
        self.normaliser = self.model.normaliser()
        self.as_bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.encode() if kind != UNKNOWN else " ⁇ ".encode()
            for p, _, kind in self.model.pieces
        ]

    def normalised(self, text: str) -> str:
        if not self.model.charsmap and not self.model.trim_spaces:
            return (MARK + text if self.model.dummy_prefix and text else text).replace(" ", MARK)
        return self.normaliser.normalize_str(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """For each text its ids as little-endian int32 bytes."""
        plain = [self.normalised(t) for t in texts]
        out: list[bytes] = [b""] * len(plain)
        fast = [k for k, t in enumerate(plain) if self.cuttable and MARK * 2 not in t]
        slow = sorted(set(range(len(plain))).difference(fast))
        for rust, some in ((self.cut, fast), (self.whole, slow)):
            for k, got in zip(some, rust.encode_batch_fast([plain[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = array("i", got.ids).tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(documents: DataFrame, model: str, schema: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in short(batches):
            texts = b["text"].to_pylist()
            ids = own.encode(texts)
            ok = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            n = [len(i) // 4 for i in ids]
            out = [hashlib.sha256(i).hexdigest() for i in ids] if digest else pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "ids_sha256" if digest else "ids": out, "n_tokens": n, "round_trip": pa.array(ok)})

    return documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, schema)


def encode(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (binary, little-endian int32), n_tokens, round_trip: one row for each row.

    A null text is read as empty and has no ids. round_trip says that decoding gives the text that
    was read (models that change or drop characters when they normalise cannot). Other columns are
    dropped; a null doc_id stays null; an empty table gives an empty result.
    """
    return _coded(documents, model, "doc_id long, ids binary, n_tokens long, round_trip boolean", False)


def digest(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the little-endian int32 ids), round_trip."""
    return _coded(documents, model, "doc_id long, ids_sha256 string, n_tokens long, round_trip boolean", True)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [own.decode(i) for i in b["ids"]]})

    return encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.lit(b"")).alias("ids")).mapInPandas(run, "doc_id long, text string")
