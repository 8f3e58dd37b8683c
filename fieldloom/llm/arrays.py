"""Texts of an Arrow batch as flat numpy arrays: bytes, pieces, and 64-bit hashes of the pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 19
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

# white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word counts before each text."""
    inside = ~SPACE[data]
    # a text's first byte starts a word even if the text before ends in one
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words and no others; words are in order and do not overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return encoded(data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)], ends - starts).indices.to_numpy()


def encoded(packed: np.ndarray, sizes: np.ndarray) -> pa.DictionaryArray:
    """Pieces of these sizes, one after the other, as a dictionary array."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()


def _grow(n: int) -> None:
    global _powers
    if len(_powers[0]) < n:
        for_base, for_inverse = np.full(n, _BASE), np.full(n, _INVERSE)
        for_base[0] = for_inverse[0] = 1
        _powers = (np.cumprod(for_base), np.cumprod(for_inverse))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece data[start:end]; pieces must be in order and not overlap.

    A polynomial modulo 2^64 from prefix sums, mixed with the length. Worked
    off in chunks, so memory follows the chunk and the longest piece.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        chunk = data[base:int(ends[j - 1])]
        _grow(len(chunk) + 1)
        total = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum((chunk.astype(np.uint64) + np.uint64(1)) * _powers[0][:len(chunk)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * _powers[1][s] + (e - s).astype(np.uint64) * _BASE)
        i = j
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the distinct shingles of ``width`` words, sorted.

    A text with fewer words has its whole sequence as one shingle, none without words.
    """
    rolled = hashes
    for j in range(1, width):
        rolled = mix(rolled[:len(rolled) - 1] * _BASE + hashes[j:]) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            whole = hashes[a:a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * _BASE + hashes[j:j + 1])
            # a short sequence is never equal to a full shingle
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out
