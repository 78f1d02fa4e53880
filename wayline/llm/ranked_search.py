"""The best documents for each item of a query set, by term-at-a-time scoring with limited accumulators.

One pass over the documents keeps, for each, its number of terms and the terms that any item has, with
their frequencies; document counts and total lengths are aggregates of that table. The second pass takes
the table in shards of one Arrow batch. A shard's postings are sorted by term, and each posting's share
of a score is computed once for all items. An item's terms are then taken rarest first. A document gets
an accumulator when a term first meets it, until what all remaining terms could add at most falls below
the k-th best partial score: from then on no new accumulators, while those that exist are updated to
their exact scores. The k-th score that earlier shards of the task have reached counts as a partial
score too. Every task keeps k documents an item; these meet in two rounds, by groups of tasks first.

The query set is read in blocks of at most ``block_bytes`` of text, one pass each, so neither what is
broadcast nor what a worker holds of it grows. Equality of terms is that of bytes.

Scores are 64-bit integers: 25 times a document's length times the number of documents must stay below
2^63. Defined results: a null text has no terms, and a null or termless item, or one whose terms no
document has, no rows; every row of the items is an item by itself, whatever its id, and of the documents
a document by itself; a null doc_id comes after others of equal score; an empty table on either side
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decontaminate import Words
from .scratch import keep
from .textvec import blocks

#: Tasks whose best documents meet before all others'.
TASKS = 512
#: Orders documents without an id after all others.
_NO_ID = 2**63 - 1


def _postings(shared):
    """mapInArrow function over (doc_id, text): doc_id, n, and the vocabulary's terms with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, n = Words(block), len(block)
                number = vocabulary.find(words)[words.number] if len(words.number) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(n), np.diff(words.first))
                known = number >= 0
                pairs, tf = np.unique(doc[known] * max(1, len(vocabulary.starts)) + number[known], return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(vocabulary.starts)))
                at = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), pa.array(np.diff(words.first)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Shard:
    """Postings of some documents by term: ``docs`` and ``share`` (a posting's part of a score before its weight) of a term stand together."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n: np.ndarray, documents: int, words: int):
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 75 + (25 * n * documents) // words
        by = np.argsort(terms, kind="stable")
        tf = tfs[by].astype(np.int64)
        self.size, self.docs = len(n), doc[by]
        self.share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        self.terms, first = np.unique(terms[by], return_index=True)
        self.first = np.append(first, len(by))
        self.most = np.maximum.reduceat(self.share, first) if len(by) else np.empty(0, np.int64)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best of an item whose ``terms`` come rarest first, and their exact scores."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        # What the terms from each on can add at most.
        rest = np.append(np.cumsum((weights * self.most[at])[::-1])[::-1], 0)
        score, live = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=bool)
        kept, least = None, floor
        for j, (a, w) in enumerate(zip(at.tolist(), weights.tolist())):
            docs, share = self.docs[self.first[a] : self.first[a + 1]], self.share[self.first[a] : self.first[a + 1]]
            if kept is None:
                score[docs] += w * share
                live[docs] = True
                if rest[j + 1] < max(floor, int(score.max())):  # else no k-th score can be beyond what remains
                    held = np.flatnonzero(live)
                    if len(held) >= k:
                        least = max(least, int(np.partition(score[held], len(held) - k)[len(held) - k]))
                    if rest[j + 1] < least:
                        kept = held
            elif len(kept) * 16 < len(docs):
                place = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
                both = docs[place] == kept
                score[kept[both]] += w * share[place[both]]
            else:
                own = live[docs]
                score[docs[own]] += w * share[own]
        found = np.flatnonzero(live & (score > 0))
        return found, score[found]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by ascending id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _scored(shared, k: int, documents: int, words: int):
    """mapInArrow function over the postings table: item (its number), item_id, doc_id and score of the task's k best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        tops = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for batch in batches:
            lists = [batch.column(i) for i in (2, 3)]
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            shard = Shard(*flat, sizes, batch.column(1).to_numpy(zero_copy_only=False), documents, words)
            for i, (_, terms, weights) in enumerate(items):
                held, scores = tops[i]
                found, new = shard.top(terms, weights, k, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    held, scores = np.concatenate([held, ids[found]]), np.concatenate([scores, new])
                    some = best(held, scores, k)
                    tops[i] = held[some], scores[some]
        sizes = np.array([len(t[0]) for t in tops], dtype=np.int64)
        if sizes.sum():
            number = np.repeat(np.arange(len(items)), sizes)
            ids = np.concatenate([t[0] for t in tops])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array([items[i][0] for i in number.tolist()], type=pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([t[1] for t in tops]))],
                names=["item", "item_id", "doc_id", "score"],
            )

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, Words]]:
    """The items' ids and words, a bounded part at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    number = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for part in range(number):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == part).toArrow()
        if rows.num_rows:
            yield rows.column(0).to_pylist(), Words(next(blocks(rows.column(1), 1 << 62)))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _of_block(docs: DataFrame, ids: list, words: Words, k: int) -> DataFrame:
    """item, item_id, doc_id and score of each task's k best for one block of items."""
    context = docs.sparkSession.sparkContext
    postings = keep(docs.mapInArrow(_postings(context.broadcast(words)), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    documents, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the block has terms, whatever the documents.
    holding = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}
    items = []
    for i, item_id in enumerate(ids):
        terms, repeats = np.unique(words.number[words.first[i] : words.first[i + 1]], return_counts=True)
        some = [(holding[t], t, r * weight(documents, holding[t])) for t, r in zip(terms.tolist(), repeats.tolist()) if t in holding]
        some.sort()
        items.append((item_id, np.array([t for _, t, _ in some], dtype=np.int64), np.array([w for _, _, w in some], dtype=np.int64)))
    return postings.where(F.size("terms") > 0).mapInArrow(_scored(context.broadcast(items), k, documents, max(1, total)), "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for part, (ids, words) in enumerate(_blocks(items, block_bytes)):
        own = _of_block(docs, ids, words, k).withColumn("item", F.col("item") + (part << 32)).withColumn("some", F.floor(F.spark_partition_id() / TASKS))
        found = own if found is None else found.union(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
