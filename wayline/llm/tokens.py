"""Token ids of whole texts, exactly as the tokenizers library gives them.

White space always begins a new pre-token in both vocabularies, so a text may be cut before white
space that follows a printing character, and each cut chunk encoded alone. Each worker keeps the ids
of the chunks that it has met; only new ones reach the library. The cache is bounded. A chunk is
looked up by a hash and then compared byte by byte.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .textvec import LOWER, SPACE, Block, distinct_spans, ragged, same_spans, span_hashes

#: Chunks that a worker keeps; beyond that it starts afresh.
CACHE_CHUNKS = 1_600_000
#: Longer chunks are encoded but not kept.
CACHE_CHUNK_BYTES = 256

_CODERS: dict[str, "Coder"] = {}


def _wide_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is one of Unicode's white spaces beyond ASCII."""
    b1 = data[at - 1]
    b2 = np.where(at >= 2, data[at - 2], 0)
    b3 = np.where(at >= 3, data[at - 3], 0)
    two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    general = (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
    other = ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    return two | general | other


def chunk_bounds(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and for each document where its chunks begin among them."""
    data, b = block.data, block.bounds
    if not len(data):
        return np.empty(0, dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data), dtype=bool)
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last = data[at - 1]
    plain = (last > 32) & (last < 127)
    wide = ~plain & (last >= 128)
    plain[wide] = ~_wide_space_before(data, at[wide])
    cut[at[plain]] = True
    cut[b[:-1][b[:-1] < b[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, b)


class Coder:
    """Ids of blocks of documents under one vocabulary file."""

    def __init__(self, path: str, words_only: bool = False):
        """words_only: the vocabulary drops white space and lower-cases, so chunks may do both."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words_only = words_only
        self.id_type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.starts = np.empty(0, dtype=np.int32)
        self.lengths = np.empty(0, dtype=np.uint16)
        self.pool = np.empty(0, dtype=self.id_type)
        self.text_at = np.zeros(0, dtype=np.int32)
        self.text_end = np.zeros(0, dtype=np.int32)
        self.text = np.empty(0, dtype=np.uint8)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.id_type, count=int(lengths.sum()))
        return flat, lengths

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents in order, and the number of ids of each document."""
        if self.words_only:
            data = LOWER[block.data]
            starts, ends, first = block.words(SPACE, data)
            # Special tokens are matched before the library lower-cases: words that may hold one keep their case.
            marks = np.flatnonzero((block.data[:-1] == 0x3C) & (block.data[1:] == 0x7C))
            for k in np.unique(np.searchsorted(starts, marks, side="right") - 1).tolist():
                data[starts[k] : ends[k]] = block.data[starts[k] : ends[k]]
        else:
            data = block.data
            starts, first = chunk_bounds(block)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.zeros(len(block), dtype=np.int64)
        begin, count, inverse, pool = self.lookup(data, starts, ends, span_hashes(data, starts, ends))
        lengths = count[inverse]
        ids = pool[ragged(begin[inverse], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[first[1:]] - total[first[:-1]]

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where in the returned pool each distinct span's ids begin, their numbers, which of them each span has, and the pool."""
        where, inverse, plain = distinct_spans(data, starts, ends, hashes)
        keys, s, e = hashes[where], starts[where], ends[where]
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            maybe = np.flatnonzero(self.keys[at] == keys)
            known[maybe] = same_spans(data, s[maybe], e[maybe], self.text, self.text_at[at[maybe]], self.text_end[at[maybe]])
        new = np.flatnonzero(~known)
        begin, count, pool = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), self.pool
        if len(self.keys):
            begin[known], count[known] = self.starts[at[known]], self.lengths[at[known]]
        if len(new):
            flat, lengths = self._encode([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(s[new].tolist(), e[new].tolist())])
            begin[new] = len(pool) + np.cumsum(lengths) - lengths
            count[new] = lengths
            pool = np.concatenate([pool, flat])
            # Not kept: long chunks, and those whose hash belongs to another chunk already.
            fit = ((e - s)[new] <= CACHE_CHUNK_BYTES) & (new < plain)
            if len(self.keys):
                fit &= self.keys[at[new]] != keys[new]
            some = new[fit]
            self._keep(keys[some], begin[some], count[some], pool, data, s[some], e[some])
        return begin, count, inverse, pool

    def _keep(self, keys, begin, lengths, pool, data, starts, ends) -> None:
        if len(self.keys) + len(keys) > CACHE_CHUNKS or len(pool) > 16 * CACHE_CHUNKS:
            self._clear()
            return
        spot = np.searchsorted(self.keys, keys)
        text_end = len(self.text) + np.cumsum(ends - starts)
        self.keys = np.insert(self.keys, spot, keys)
        self.starts = np.insert(self.starts, spot, begin)
        self.lengths = np.insert(self.lengths, spot, lengths)
        self.text_at = np.insert(self.text_at, spot, text_end - (ends - starts))
        self.text_end = np.insert(self.text_end, spot, text_end)
        self.text = np.concatenate([self.text, data[ragged(starts, ends - starts)]])
        self.pool = pool


def coder(path: str, words_only: bool = False) -> Coder:
    """This worker's coder for a file, with what it has cached."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path, words_only)
    return _CODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the counts with it."""
    counts = counts + 1
    out = np.empty(len(ids) + len(counts), dtype=np.uint32)
    own = np.ones(len(out), dtype=bool)
    own[np.cumsum(counts) - 1] = False
    out[own], out[~own] = ids, end_id
    return out, counts
