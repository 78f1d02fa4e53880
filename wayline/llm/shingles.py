"""Sets of word shingles and their MinHash signatures, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textvec import LOWER, SPACE, Block, blocks, mix, span_hashes

_ORDER = np.random.default_rng(0xC0DE).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATE = np.random.default_rng(0xABBA).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, sorted within each document, and each document's number of them.

    A document of fewer words, but not none, has its whole sequence as its one shingle. A shingle is known
    by 64 bits, a sum of its words' hashes times odd constants by place, mixed: two different ones are
    taken for one with a probability of 2^-64.
    """
    data = LOWER[block.data]
    starts, ends, first = block.words(SPACE, data)
    hashes, n = span_hashes(data, starts, ends), np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    width = np.minimum(n, words)[owner]
    total = np.zeros(len(owner), dtype=np.uint64)
    for k in range(words):
        has = width > k
        if has.all():
            total += hashes[begin + k] * _ORDER[k]
        else:
            total[has] += hashes[begin[has] + k] * _ORDER[k]
    total = mix(total + width.astype(np.uint64))
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.bincount(owner[new], minlength=len(n)).astype(np.int64)


def signatures(sets: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash of each non-empty set: a row of 32-bit minima for each; rows of empty sets are zero."""
    out = np.zeros((len(counts), coordinates), dtype=np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(((sets ^ _COORDINATE[0, k]) * _COORDINATE[1, k]) >> np.uint64(32), at)
    return out


def set_keys(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share."""
    full, out = np.flatnonzero(counts), []
    at = (np.cumsum(counts) - counts)[full]
    for salt in (0x0123456789ABCDEF, 0x13198A2E03707344):
        key = np.zeros(len(counts), dtype=np.uint64)
        if len(full):
            key[full] = mix(np.add.reduceat(mix(sets + np.uint64(salt)), at))
        out.append(key.view(np.int64))
    return out[0], out[1]


def signature_rows(words: int, coordinates: int):
    """mapInArrow function over (doc_id, text, member): doc_id, member, n_shingles, key1, key2, signature tokens (coordinate and value in one long)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, counts = shingle_sets(block, words)
                key1, key2 = set_keys(sets, counts)
                tokens = signatures(sets, counts, coordinates).astype(np.int64) | (np.arange(coordinates, dtype=np.int64) << 32)
                n = len(counts)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * coordinates, coordinates, dtype=np.int32)), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(block.first, n) for k in (0, 2)), pa.array(counts), pa.array(key1), pa.array(key2), listed], names=["doc_id", "member", "n_shingles", "key1", "key2", "tokens"])

    return run


#: Bits of a parity sketch; 64-bit words that hold them.
PARITY_BITS, PARITY_WORDS = 512, 8


def parities(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set the parities of its numbers of hashes in PARITY_BITS buckets, in 64-bit words.

    Each member that one of two sets lacks flips one bit, so two sketches differ in at most as many bits
    as their sets have members that are not common.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(owner * PARITY_BITS + (sets % np.uint64(PARITY_BITS)).astype(np.int64), minlength=len(counts) * PARITY_BITS) % 2
    return np.packbits(odd.reshape(len(counts), PARITY_BITS).astype(np.uint8), axis=1).view(np.int64)


def set_rows(words: int):
    """mapInArrow function over (text, key1, key2): rep (the first key), shingles and parities of the rows whose set has these keys."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(0)):
                sets, counts = shingle_sets(block, words)
                n = len(counts)
                want = [batch.column(k).slice(block.first, n) for k in (1, 2)]
                same = np.ones(n, dtype=bool)
                for key, column in zip(set_keys(sets, counts), want):
                    same &= key == column.to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * PARITY_WORDS, PARITY_WORDS, dtype=np.int32)), pa.array(parities(sets, counts).ravel()))
                yield pa.RecordBatch.from_arrays([want[0], listed, sketch], names=["rep", "shingles", "parity"]).filter(pa.array(same))

    return run
