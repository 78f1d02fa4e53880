"""Vectorised text primitives shared by the text operators.

Arrow hands a batch of strings over as one byte buffer with offsets. Everything here works on that
buffer with numpy, so that a word or a chunk never becomes a Python object on the hot path. Blocks
bound memory: rows are taken together up to ``BLOCK_BYTES``; a longer document is a block by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together.
BLOCK_BYTES = 1 << 20

#: An odd constant whose multiples salt the lanes of a span.
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first 0 to 8 bytes of a lane.
_FILL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Lanes of long spans that are worked on together.
_LANES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Everything in ASCII but digits and a-z (after lower-casing) separates; bytes from 0x80 belong to words.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _lanes(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` the eight bytes from there on as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _pieces(size: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of the spans longer than a lane, in groups of bounded total length where no span is longer itself."""
    long = np.flatnonzero(size > 8)
    if len(long):
        group = np.cumsum((size[long] - 1) >> 3) // _LANES
        yield from np.split(long, np.flatnonzero(np.diff(group)) + 1)


def _tail(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For lanes after the first of the given spans, a bounded number at once: places, lengths in bytes, numbers in their span, spans."""
    more = (ends - starts - 1) >> 3
    whole = np.cumsum(more)
    for low in range(0, int(whole[-1]), _LANES):
        flat = np.arange(low, min(low + _LANES, int(whole[-1])))
        span = np.searchsorted(whole, flat, side="right")
        number = flat - (whole - more)[span] + 1
        at = starts[span] + 8 * number
        yield at, np.minimum(ends[span] - at, 8), number, span


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand.

    A span is lanes of eight bytes. Each lane goes through a bijective mixer salted by its number, and the
    results are summed: no polynomial whose terms could cancel. Different spans of one length of at most
    eight bytes never share a hash; any others do with a probability of 2^-64, so what must be exact
    compares bytes as well (``distinct_spans``).
    """
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lanes, size = _lanes(data), ends - starts
    h = mix((lanes[starts] & _FILL[np.minimum(size, 8)]) ^ _STEP)
    for some in _pieces(size):
        for at, left, number, span in _tail(starts[some], ends[some]):
            value = mix((lanes[at] & _FILL[left]) ^ mix((number + 1).astype(np.uint64) * _STEP))
            first = np.flatnonzero(np.diff(span, prepend=-1))
            h[some[span[first]]] += np.add.reduceat(value, first)
    return mix(h + size.astype(np.uint64) * _STEP)


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which spans of ``a`` and of ``b`` have the same bytes."""
    size = a_ends - a_starts
    x, y = _lanes(a), _lanes(b)
    same = (size == b_ends - b_starts) & (((x[a_starts] ^ y[b_starts]) & _FILL[np.minimum(size, 8)]) == 0)
    for group in _pieces(np.where(same, size, 0)):
        for at, left, number, span in _tail(a_starts[group], a_ends[group]):
            differs = ((x[at] ^ y[b_starts[group][span] + 8 * number]) & _FILL[left]) != 0
            same[group[span[differs]]] = False
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each distinct span a number of it, which distinct one each span is, and how many of the distinct have the hash to themselves or came first with it.

    Those stand first, in the order of their hashes; equality is of bytes, not of hashes.
    """
    keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    other = where[which]
    odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[other], ends[other]))
    if len(odd):  # two texts under one hash: named by their bytes
        names: dict[bytes, int] = {}
        for k in odd.tolist():
            which[k] = len(where) + names.setdefault(data[starts[k] : ends[k]].tobytes(), len(names))
        firsts = {int(which[k]): k for k in reversed(odd.tolist())}
        where = np.concatenate([where, [firsts[len(where) + n] for n in range(len(names))]]).astype(np.int64)
    return where, which, len(keys)


class Block:
    """Some rows' text: ``data`` bytes, ``bounds`` with a document at data[bounds[i]:bounds[i+1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, separator: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of non-separators, and for each document where its words begin."""
        data = self.data if data is None else data
        inside = ~separator[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if len(inside):
            b = self.bounds
            full = b[:-1] < b[1:]
            before[b[:-1][full]] = False
            after[b[1:][full] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def _libc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _libc_trim()


def one_thread() -> None:
    """Keeps numpy's matrix products to the caller's thread: tasks run side by side already, and waiting helpers burn their cores."""
    for path in Path(f"{np.__path__[0]}.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def _give_back() -> None:
    """Returns free memory to the system: workers live for many stages, and numpy's blocks would stay with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = (column if pa.types.is_large_binary(column.type) else column.cast(wide if pa.types.is_binary(column.type) else pa.large_string()).cast(wide)).fill_null(b"")
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    return (np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, dtype=np.uint8)), offsets


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a text column in order, in blocks of at most ``limit`` bytes or of one row."""
    data, offsets = column_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
    _give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of all spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def run_of_text(text, size: int):
    """Spark column: a text of at most ``size`` characters whole, of a longer one ``size`` characters from a place given by its hash."""
    from pyspark.sql import functions as F

    spare = F.greatest(F.length(text) - size, F.lit(0))
    return F.substring(text, (F.pmod(F.xxhash64(text), spare + 1) + 1).cast("int"), F.lit(size))


def crc_bucket(column):
    """Spark column: crc32 of an id's decimal text; of a missing id that of no text, 0."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0).cast("long"))


def keep_rows(docs, run, flag: str):
    """The rows of ``docs``, all columns, for which a mapInArrow function over (doc_id, text) sets ``flag``: no join, no shuffle."""
    names = docs.columns
    at = names.index("doc_id"), names.index("text")

    def apply(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=["doc_id", "text"])
            flags = [x.column(x.schema.get_field_index(flag)) for x in run(iter([pair]))]
            yield batch.filter(pa.concat_arrays(flags)) if flags else batch

    return docs.mapInArrow(apply, docs.schema)
