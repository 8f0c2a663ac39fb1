"""Words of a column of texts and their 64-bit hashes, as numpy arrays over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import SPACES

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd factors by place in the word; places repeat after these, with the number of the round mixed in.
_PLACE = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (an invertible mixing step)."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """data: the bytes; begin, end: of each word; text: index of the first word of each text, and the end."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    edge: np.ndarray


#: For plain words: ASCII letters in lower case, and what is neither a letter, a digit nor beyond ASCII parts words.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


#: A-Z in lower case, all else as it is.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def words(texts: pa.Array, plain: bool = False, lower: bool = False) -> Words:
    """The maximal runs outside SPACES of each text, with A-Z in lower case if asked, or its plain words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    data = PLAIN[data] if plain else LOWERED[data] if lower else data
    space = _SPACE[data]
    solid = ~space
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = edge[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(begin, edge)
    if not len(begin):
        return Words(data, begin, end, text, np.zeros(0, np.uint64), edge)
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTE[data[solid]] * _PLACE[place & 1023]
    far = np.flatnonzero(place > 1023)
    value[far] = mix(value[far] + (place[far] >> 10).astype(np.uint64))
    value = np.add.reduceat(value ^ (value >> np.uint64(31)), first)
    return Words(data, begin, end, text, mix(value + length.astype(np.uint64)), edge)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbouring words, from each word on; n - 1 fewer than there are words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _PLACE[k]
    return mix(out)


def pieces(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """texts in runs of about size bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts[at:to]
        at = to
