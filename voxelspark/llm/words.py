"""Words and shingles of Arrow string columns, hashed with whole-array numpy operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on together up to so many bytes; a longer one is worked on alone.
CHUNK_BYTES = 1 << 18
#: Space and U+0009 to U+000D, as bytes of UTF-8, end words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPOTS = 64
_TABLE = np.random.default_rng(20_240_501).integers(0, 1 << 63, (_SPOTS, 256), dtype=np.uint64).ravel() * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n + 1 offsets of each in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of some texts: hash, first byte and end byte (in data) of each; text k has words from[k] to from[k + 1]."""

    first: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.of) - 1


def words(texts: pa.Array) -> Iterator[Words]:
    """Words of consecutive texts, some at a time; first is the number of the first text."""
    data, at = raw(texts)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK_BYTES, side="right")) - 1)
        yield _words(k, data[at[k] : at[end]], at[k : end + 1] - at[k])
        k = end


def _words(first: int, data: np.ndarray, at: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    spot = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
    letters = data[inside[:-1]].astype(np.int64)
    values = _TABLE[((spot & (_SPOTS - 1)) << 8) | letters]
    if total and lengths.max() > _SPOTS:
        values = values * (2 * (spot >> 6) + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)) if total else np.zeros(0, np.uint64)
    return Words(first, hashes, starts, ends, np.searchsorted(starts, at, side="left"), data, at)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each position at which size words begin (also across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _ODD[0]
    for j in range(1, size):
        out += hashes[j : j + n] * _ODD[j]
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles with the n + 1 offsets of each text's.

    A text of 1 to size - 1 words has one shingle, all its words; one without words has none.
    """
    counts = np.diff(w.of)
    short = (counts > 0) & (counts < size)
    n = np.where(counts >= size, counts - size + 1, short.astype(counts.dtype))
    offsets = np.r_[0, np.cumsum(n)]
    out = np.empty(offsets[-1], dtype=np.uint64)
    every = windows(w.hashes, size)
    full = counts >= size
    spots = np.arange(int(n[full].sum())) - np.repeat(np.cumsum(n[full]) - n[full], n[full])
    out[np.repeat(offsets[:-1][full], n[full]) + spots] = every[np.repeat(w.of[:-1][full], n[full]) + spots]
    for k in np.flatnonzero(short):
        h = w.hashes[w.of[k] : w.of[k + 1]]
        out[offsets[k]] = mix(np.array([(h * _ODD[: len(h)]).sum() + np.uint64(len(h))], dtype=np.uint64))[0]
    return out, offsets
