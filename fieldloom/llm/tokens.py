"""Token ids of whole texts by a public byte-level tokenizer, at array speed.

A byte-level tokenizer first splits a text by a pattern and never looks beyond
a split. Some splits can be told from two neighbouring bytes: a single space
belongs to what follows it, and punctuation never belongs to the letters before
it. Texts are cut at such places, the distinct parts of a batch are looked up
in a cache, and only new parts go to the tokenizer.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from fieldloom.llm.arrays import flat, mix, piece_hashes

CACHED_PARTS = 1 << 20
TOKENIZER = "byte_bpe_50k.tiktoken"
# fixed value: the special token of this vocabulary, which the tokenizer recognises inside a text
END_OF_TEXT = ("<|endoftext|>", 50256)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_PUNCTUATION = _VISIBLE & ~_LETTER
_PUNCTUATION[48:58] = False


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=dict([END_OF_TEXT]))


class BatchEncoder:
    """Encodes Arrow batches of texts; ``path`` names a rank file of the tiktoken library."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        if self.tokenizer.n_vocab > 1 << 16:
            raise ValueError("token ids are kept as 16-bit numbers: the vocabulary is too large")
        self.bytes_of = np.array([len(t) for t in self._token_bytes()], np.int64)
        self._forget()

    def _token_bytes(self) -> list[bytes]:
        return [self.tokenizer.decode_single_token_bytes(i) for i in range(self.tokenizer.n_vocab)]

    def _forget(self) -> None:
        # parts by ascending hash, with a second hash, and their ids as a stretch of the pool
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, allowed_special="all"), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and the n + 1 offsets between texts; null is empty."""
        data, offsets = flat(texts)
        raw = data.tobytes()
        found = None if END_OF_TEXT[0].encode() in raw else self._by_parts(data, raw, offsets)
        if found is None:
            bounds = offsets.tolist()
            each = [self.ids(raw[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return np.concatenate([*each, self.pool[:0]]), np.cumsum([0, *map(len, each)])
        return found

    def _by_parts(self, data: np.ndarray, raw: bytes, offsets: np.ndarray):
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, joinable = _parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        whole = piece_hashes(data, starts, ends)
        # a second hash, over the first bytes with the length and the first hash's low half left out
        check = _second_hash(data, starts, ends)
        hashes, first, which = np.unique(whole, return_index=True, return_inverse=True)
        if (check != check[first][which]).any():
            return None     # two parts of the batch share a hash: encode its texts one by one
        if len(self.hash) > CACHED_PARTS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        known = self.hash[at] == hashes if len(self.hash) else np.zeros(len(hashes), bool)
        if (self.check[at[known]] != check[first[known]]).any():
            self._forget()
            known[:] = False
        if not known.all():
            self._learn(data, raw, starts, ends, joinable, hashes[~known], first[~known], check)
            at = np.searchsorted(self.hash, hashes)
        n = self.n[at][which]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[at][which] - (end - n), n) + np.arange(end[-1])]
        return ids, np.concatenate(([0], end))[np.searchsorted(starts, offsets)]

    def _learn(self, data, raw, starts, ends, joinable, hashes, first, check) -> None:
        join = joinable[first]
        parts = np.concatenate((first[join], first[~join]))
        hashes = np.concatenate((hashes[join], hashes[~join]))
        a, b = starts[first[join]], ends[first[join]]
        end = np.cumsum(b - a)
        size = int(end[-1]) if len(end) else 0
        text = data[np.repeat(a - (end - (b - a)), b - a) + np.arange(size)].tobytes().decode()
        ids = self.ids(text)
        token_ends = np.cumsum(self.bytes_of[ids])
        lengths = np.diff(np.searchsorted(token_ends, end) + 1, prepend=0)
        alone = [self.ids(raw[i:j].decode()) for i, j in
                 zip(starts[first[~join]].tolist(), ends[first[~join]].tolist(), strict=True)]
        lengths = np.concatenate((lengths, np.array([len(x) for x in alone], np.int64)))
        at = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, ids, *alone])
        order = np.argsort(hashes)
        where = np.searchsorted(self.hash, hashes[order])
        self.hash = np.insert(self.hash, where, hashes[order])
        self.check = np.insert(self.check, where, check[parts][order])
        self.at = np.insert(self.at, where, at[order])
        self.n = np.insert(self.n, where, lengths[order])


def _second_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash independent of the polynomial one: sums of mixed (byte, place) pairs."""
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, ends - starts)
    return np.add.reduceat(_PAIRS[data, np.minimum(place, 63)], starts)


_PAIRS = mix(np.arange(256 * 64, dtype=np.uint64).reshape(256, 64) + np.uint64(1 << 40))


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts start, and which parts can be encoded in a row with others.

    A part starts at a text's start, at a space after a byte that surely is no
    white space (visible ASCII, or the end of a two-byte character from U+00C0
    on), and at ASCII punctuation after an ASCII letter. A part can be joined
    to others if it starts with a space and ends in such a byte.
    """
    firm = _VISIBLE[data]
    firm[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ((data[1:] == 0x20) & firm[:-1]) | (_PUNCTUATION[data[1:]] & _LETTER[data[:-1]])
    cut[offsets] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(data))
    return starts, (data[starts] == 0x20) & firm[ends - 1]


@lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    """One encoder, with its cache, per worker process."""
    return BatchEncoder(path)
