"""Benchmark decontamination with suffix arrays over the training documents.

Documents are dealt with in shards of bounded size. Each shard's words (lower-cased A-Z; runs of
digits, letters and non-ASCII characters) get a suffix array, sorted by ``DEPTH`` words or the window
if that is longer, by prefix doubling, in which no suffix runs over its document's end. Every distinct
window of the benchmark (in ``longest_matches`` every suffix of every item) is then binary-searched,
word by word, which narrows the interval of training suffixes that begin alike.
A *window* is ``window`` consecutive words of an item, or a shorter item as a whole; what is left of
the interval after a whole window is all its occurrences in the shard. Occurrences that follow each other
as their windows do make the longest verbatim matches. Words are equal if their bytes
are; hashes only find them.

The benchmark is the query set: it is searched in blocks of at most ``block_bytes`` of text. Blocks of
at most ``broadcast_bytes`` together are broadcast and searched in one pass over the documents; a
larger benchmark takes several passes, whose hits are written and united by row. So neither a
broadcast nor a worker's memory grows with it. Nothing but hits is shuffled.

Defined results: a null text has no words and is never contaminated, and a null or wordless item has
no window; rows of one item_id count as one item; items with a null id mark words and count together
as one item, but have no place among the joined ids; rows of one doc_id are each reported by
themselves; a document longer than a block is a shard by itself; an empty benchmark leaves every
document clean; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .textvec import LOWER, NOT_ALNUM, Block, blocks, distinct_spans, keep_rows, ragged, same_spans, span_hashes

#: Words by which training suffixes are sorted at least; longer matches are compared directly.
DEPTH = 16

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item long, item_offset long, doc_offset long, clean boolean"


class Words:
    """The words of a block: ``number`` of each among the distinct ones, whose bytes are kept, and where each document's words begin."""

    def __init__(self, block: Block):
        data = LOWER[block.data]
        starts, ends, first = block.words(NOT_ALNUM, data)
        hashes = span_hashes(data, starts, ends)
        where, self.number, self.plain = distinct_spans(data, starts, ends, hashes)
        self.first, self.hashes = first.astype(np.int64), hashes[where]
        size = (ends - starts)[where]
        self.data, self.ends = data[ragged(starts[where], size)], np.cumsum(size)
        self.starts = self.ends - size

    def find(self, other: "Words") -> np.ndarray:
        """The numbers here of ``other``'s distinct words, -2 for those that are not here."""
        out = np.full(len(other.starts), -2, dtype=np.int64)
        if not len(self.starts) or not len(out):
            return out
        at = np.minimum(np.searchsorted(self.hashes[: self.plain], other.hashes), self.plain - 1)
        same = np.flatnonzero(self.hashes[at] == other.hashes)
        equal = same_spans(other.data, other.starts[same], other.ends[same], self.data, self.starts[at[same]], self.ends[at[same]])
        out[same[equal]] = at[same[equal]]
        if self.plain < len(self.starts):  # words here that share a hash
            named = {self.data[i:j].tobytes(): k + self.plain for k, (i, j) in enumerate(zip(self.starts[self.plain :], self.ends[self.plain :]))}
            for k in same[~equal].tolist():
                out[k] = named.get(other.data[other.starts[k] : other.ends[k]].tobytes(), -2)
        return out


class SuffixArray:
    """The sorted suffixes of a shard's documents, whose words are numbers."""

    def __init__(self, word: np.ndarray, first: np.ndarray, least_depth: int = DEPTH):
        n = len(word)
        self.word, self.depth = word, DEPTH
        while self.depth < least_depth:
            self.depth *= 2
        self.end = np.repeat(first[1:], np.diff(first))
        self.order = np.argsort(self.word, kind="stable")
        rank = np.searchsorted(self.word[self.order], self.word)  # the first place of each group of ties
        depth = 1
        while depth < self.depth:
            sizes = np.bincount(rank, minlength=n)
            tied = self.order[sizes[rank[self.order]] > 1]
            if not len(tied):
                break
            ahead = tied + depth
            inside = ahead < self.end[tied]
            key = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
            group = rank[tied]
            by = np.lexsort((key, group))
            tied, key, group = tied[by], key[by], group[by]
            new = np.ones(len(tied), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            slot = group + np.arange(len(tied)) - np.searchsorted(group, group)
            self.order[slot] = tied
            rank[tied] = slot[np.flatnonzero(new)][np.cumsum(new) - 1]
            depth *= 2

    def _at(self, place: np.ndarray, depth: int) -> np.ndarray:
        ahead = self.order[place] + depth
        inside = ahead < self.end[self.order[place]]
        return np.where(inside, self.word[np.where(inside, ahead, 0)], -1)

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that are alike in ``depth`` words, narrowed by binary search to those whose next word is ``want``."""
        bounds = []
        for right in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                value = self._at(np.where(open_, mid, 0), depth)
                less = open_ & ((value <= want) if right else (value < want))
                a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
            bounds.append(a)
        return bounds[0], bounds[1]

    def find(self, query: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes of ``query`` (word numbers) cut to ``length``: the longest match up to the array's depth and its interval."""
        low, high = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), len(self.order), dtype=np.int64)
        matched = np.zeros(len(begin), dtype=np.int64)
        live = np.arange(len(begin))
        for depth in range(min(self.depth, int(length.max(initial=0)))):
            live = live[(length[live] > depth)]
            live = live[query[begin[live] + depth] >= 0]
            a, b = self.narrow(low[live], high[live], depth, query[begin[live] + depth])
            hit = a < b
            live = live[hit]
            low[live], high[live], matched[live] = a[hit], b[hit], depth + 1
            if not len(live):
                break
        return matched, low, high


class Items:
    """A block of benchmark items: their words, and their distinct windows with the items that each stands in."""

    def __init__(self, ids: list, words: Words, window: int):
        self.ids, self.words, self.window = ids, words, window
        first = words.first
        n = np.diff(first)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), count)
        begin = first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n, window)[item]
        last = np.arange(window) < length[:, None]
        table = np.where(last, words.number.astype(np.int32)[np.where(last, begin[:, None] + np.arange(window), 0)] if len(words.number) else -1, np.int32(-1))
        _, at, which = np.unique(table, axis=0, return_index=True, return_inverse=True) if len(item) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
        self.begin, self.length = begin[at], length[at]
        pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0) if len(item) else np.empty((0, 2), dtype=np.int64)
        self.owner, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))
        # All places of each distinct window, in whatever item.
        by = np.argsort(which.ravel(), kind="stable")
        self.place, self.placed = begin[by], np.searchsorted(which.ravel()[by], np.arange(len(at) + 1))


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """The benchmark's bytes, and its blocks, one at a time on the driver."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // block_bytes))

    def each() -> Iterator[Items]:
        for k in range(number):
            part = items.where(F.pmod(F.xxhash64("text"), F.lit(number)) == k).toArrow()
            if part.num_rows:
                yield Items(part.column(0).to_pylist(), Words(next(blocks(part.column(1), 1 << 62))), window)

    return total, each()


def _longest_hits(items: Items, at: np.ndarray, which: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[int, tuple]:
    """For documents with occurrences of windows (``at`` in the shard, ``which`` window) the longest verbatim match with an item, as a key that orders matches: fewer words, item, place in it, place in the document.

    Occurrences that follow each other in the document as their windows do in the item make one match,
    one word longer for each.
    """
    count = np.diff(items.placed)[which]
    place = items.place[ragged(items.placed[which], count)]
    at, which, doc = np.repeat(at, count), np.repeat(which, count), np.repeat(doc, count)
    item = np.searchsorted(items.words.first, place, side="right") - 1
    by = np.lexsort((at, at - place, item, doc))
    at, which, doc, place, item = at[by], which[by], doc[by], place[by], item[by]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(new)
    words = np.diff(np.append(start, len(at))) - 1 + items.length[which[start]]
    # Items are compared by id, those without one last.
    known = np.array([i is not None for i in items.ids])
    value = np.array([i or 0 for i in items.ids], dtype=np.int64)
    own = item[start]
    order = np.lexsort((at[start] - first[doc[start]], place[start] - items.words.first[own], value[own], ~known[own], -words, doc[start]))
    out: dict[int, tuple] = {}
    docs, one = np.unique(doc[start][order], return_index=True)
    for d, k in zip(docs.tolist(), order[one].tolist()):
        i = int(own[k])
        out[d] = (-int(words[k]), not known[i], int(value[i]), int(place[start[k]] - items.words.first[i]), int(at[start[k]] - first[d]))
    return out


def _shards(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[tuple]:
    """For each shard: its batch, its block, its words, and for each of its documents that has any the word spans [a, b) of hits, overlapping or not, the items found and the longest match."""
    depth = max((one.value.window for one in shared), default=0)
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = Words(block)
            array = SuffixArray(words.number, words.first, depth)
            spans: dict[int, list] = {}
            found: dict[int, set] = {}
            longest: dict[int, tuple] = {}
            for one in shared:
                items = one.value
                query = words.find(items.words)[items.words.number] if len(items.words.number) else np.empty(0, np.int64)
                matched, low, high = array.find(query, items.begin, items.length)
                whole = np.flatnonzero((matched == items.length) & (high > low))
                size = (high - low)[whole]
                at, which = array.order[ragged(low[whole], size)], np.repeat(whole, size)
                doc = np.searchsorted(words.first, at, side="right") - 1
                if len(at):
                    for d, key in _longest_hits(items, at, which, doc, words.first).items():
                        longest[d] = min(longest.get(d, key), key)
                by = np.lexsort((at, doc))
                for part in np.split(by, np.flatnonzero(np.diff(doc[by])) + 1) if len(by) else ():
                    d = int(doc[part[0]])
                    a = at[part] - words.first[d]
                    spans.setdefault(d, []).append(np.stack([a, a + items.length[which[part]]], axis=1))
                    for w in np.unique(which[part]).tolist():
                        found.setdefault(d, set()).update(items.ids[i] for i in items.owner[items.owned[w] : items.owned[w + 1]].tolist())
            yield batch, block, words, spans, found, longest


def _united(parts: list) -> np.ndarray:
    """Spans as disjoint ones in order."""
    spans = np.concatenate(parts)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], np.append(reach[new[1:] - 1], reach[-1])], axis=1)


def _digest(found: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()


#: The longest match: its words, item, and places in words in the item and in the document.
LONGEST = ("longest_words", "longest_item", "item_offset", "doc_offset")


def _longest_columns(keys: list) -> list[pa.Array]:
    shown = [(0, None, None, None) if k is None else (-k[0], None if k[1] else k[2], k[3], k[4]) for k in keys]
    return [pa.array([s[c] for s in shown], type=pa.int64()) for c in range(4)]


def _scan(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, words, spans, found, longest in _shards(batches, shared):
            n, n_hit = len(block), np.zeros(len(block), dtype=np.int64)
            for d, parts in spans.items():
                whole = _united(parts)
                n_hit[d] = (whole[:, 1] - whole[:, 0]).sum()
            digests = [_digest(found[d]) if d in found else _NONE for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, n), pa.array(np.diff(words.first)), pa.array(n_hit), pa.array([len(found.get(d, ())) for d in range(n)], type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(n_hit > 0), *_longest_columns([longest.get(d) for d in range(n)]), pa.array(n_hit == 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *LONGEST, "clean"],
            )

    return run


def _hits(shared: list):
    """mapInArrow function over (row, text): the rows that are hit, their disjoint spans, their items and the key of the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, _, spans, found, longest in _shards(batches, shared):
            rows = batch.column(0).slice(block.first, len(block)).to_pylist()
            hit = sorted(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[d] for d in hit], type=pa.int64()), pa.array([_united(spans[d]).ravel().tolist() for d in hit], type=pa.list_(pa.int64())), pa.array([list(found[d]) for d in hit], type=pa.list_(pa.int64())), pa.array([[int(x) for x in longest[d]] for d in hit], type=pa.list_(pa.int64()))],
                names=["row", "spans", "items", "longest"],
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (row, lists of spans, lists of items, keys of longest matches): hit words, items and their digest, the longest match."""
    for batch in batches:
        rows, best = [], []
        for row, spans, items, keys in zip(*(c.to_pylist() for c in batch.columns)):
            whole, found = _united([np.array(s, dtype=np.int64).reshape(-1, 2) for s in spans]), {i for x in items for i in x}
            rows.append((row, int((whole[:, 1] - whole[:, 0]).sum()), len(found), _digest(found)))
            best.append(min(keys))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)), *_longest_columns(best)], names=["row", "n_hit", "n_items", "items_sha256", *LONGEST])


_NONE = hashlib.sha256(b"").hexdigest()


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, broadcast_bytes: int) -> tuple[bool, Iterator[list]]:
    """Whether one pass is enough, and for each pass its broadcast blocks; a pass's blocks go when the next is asked for."""
    if window < 1:
        raise ValueError("a window has at least one word")
    total, each = item_blocks(benchmark, window, block_bytes)

    def groups() -> Iterator[list]:
        own, limit = [], max(1, broadcast_bytes // block_bytes)
        for items in each:
            own.append(docs.sparkSession.sparkContext.broadcast(items))
            if len(own) == limit and total > broadcast_bytes:
                yield own
                for one in own:
                    one.unpersist()
                own = []
        yield own

    return total <= broadcast_bytes, groups()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with row numbers, written, so that rows that are read anew keep them, and the numbers' column, which no other is named like."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _united_hits(numbered: DataFrame, name: str, passes: Iterator[list]) -> DataFrame:
    """row, n_hit, n_items, items_sha256 and the longest match of the rows that any pass hits; each pass is written before the next."""
    texts, hits = numbered.select(F.col(name).alias("row"), F.col("text").cast("string").alias("text")), None
    for shared in passes:
        found = keep(texts.mapInArrow(_hits(shared), "row long, spans array<long>, items array<long>, longest array<long>"), "hits")
        hits = found if hits is None else hits.union(found)
    return hits.groupBy("row").agg(F.collect_list("spans"), F.collect_list("items"), F.collect_list("longest")).mapInArrow(_summed, "row long, n_hit long, n_items long, items_sha256 string, longest_words long, longest_item long, item_offset long, doc_offset long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its words, those inside an occurrence of a window of ``benchmark`` (item_id, text), the items found, and the longest verbatim match.

    longest_words is 0 where no window occurs; of equally long matches that with the smallest item_id (a null
    one last), then the first place in the item (item_offset, in words), then in the document (doc_offset) is given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once, passes = _passes(docs, benchmark, window, block_bytes, broadcast_bytes)
    if once:
        return docs.mapInArrow(_scan(next(passes)), SCHEMA).drop("clean")
    numbered, name = _numbered(docs)
    counted = numbered.select(F.col(name).alias("doc_id"), "text").mapInArrow(_scan([]), SCHEMA).select(F.col("doc_id").alias("row"), "n_words")
    out = numbered.select(F.col(name).alias("row"), "doc_id").join(counted, "row").join(_united_hits(numbered, name, passes), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(_NONE)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), zero("longest_words"), *LONGEST[1:])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) in which no window of the benchmark occurs."""
    once, passes = _passes(docs, benchmark, window, block_bytes, broadcast_bytes)
    if once:
        return keep_rows(docs, _scan(next(passes)), "clean")
    numbered, name = _numbered(docs)
    return numbered.join(_united_hits(numbered, name, passes).select(F.col("row").alias(name)), name, "left_anti").select(*docs.columns)


_PLACE = "item_id long, match_words long, item_offset long, doc_id long, doc_offset long"


def _longest_of(items: Items, words: Words, array: SuffixArray, ids: np.ndarray) -> list[tuple]:
    """Of each item the longest match in a shard, at the smallest item_offset, then doc_id, then doc_offset."""
    query = words.find(items.words)[items.words.number] if len(items.words.number) else np.empty(0, np.int64)
    begin = np.arange(len(query))
    item = np.searchsorted(items.words.first, begin, side="right") - 1
    left = items.words.first[item + 1] - begin
    matched, low, high = array.find(query, begin, left)
    top = np.zeros(len(items.ids), dtype=np.int64)
    np.maximum.at(top, item, matched)
    # Suffixes whose match is the item's longest so far: those at full depth go on, of others the first one counts.
    some = np.flatnonzero((matched > 0) & (matched == top[item]))
    deep = matched[some] == array.depth
    shallow = some[~deep]
    _, at = np.unique(item[shallow], return_index=True)
    some = np.concatenate([shallow[at], some[deep]])
    rows: dict[int, tuple] = {}
    for s in some.tolist():
        i, p = int(item[s]), array.order[low[s] : high[s]]
        n = np.full(len(p), matched[s])
        most = np.minimum(left[s], array.end[p] - p)
        live = np.flatnonzero(n < most) if matched[s] == array.depth else np.empty(0, np.int64)
        while len(live):
            live = live[array.word[p[live] + n[live]] == query[s + n[live]]]
            n[live] += 1
            live = live[n[live] < most[live]]
        best = int(n.max())
        p = p[n == best]
        doc = np.searchsorted(words.first, p, side="right") - 1
        k = np.lexsort((p - words.first[doc], ids[doc]))[0]
        key = (-best, s - int(items.words.first[i]), int(ids[doc[k]]), int(p[k] - words.first[doc[k]]))
        rows[i] = min(rows.get(i, key), key)
    return [(items.ids[i], -n, offset, doc if doc != _NO_ID else None, place) for i, (n, offset, doc, place) in rows.items()]


#: Orders documents without an id after all others.
_NO_ID = 2**63 - 1


def _longest(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = Words(block)
                array = SuffixArray(words.number, words.first)
                ids = batch.column(0).slice(block.first, len(block)).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                rows = [r for one in shared for r in _longest_of(one.value, words, array, ids)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in range(5)], names=[f.split()[0] for f in _PLACE.split(", ")])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """For each item its longest verbatim match over all shards: item_id, match_words, item_offset, doc_id, doc_offset (in words).

    Of equally long matches that with the smallest item_offset is given, then the smallest doc_id (null
    last) and doc_offset. An item without a common word has no row; items with a null id count as one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once, passes = _passes(docs, benchmark, DEPTH, block_bytes, broadcast_bytes)
    if once:
        found = docs.mapInArrow(_longest(next(passes)), _PLACE)
    else:
        found = None
        for shared in passes:
            part = keep(docs.mapInArrow(_longest(shared), _PLACE), "longest")
            found = part if found is None else found.union(part)
    best = F.min_by(F.struct("match_words", "item_offset", "doc_id", "doc_offset"), F.struct(-F.col("match_words"), F.col("item_offset"), F.coalesce("doc_id", F.lit(_NO_ID)), F.col("doc_offset")))
    return found.groupBy("item_id").agg(best.alias("x")).select("item_id", "x.*")
