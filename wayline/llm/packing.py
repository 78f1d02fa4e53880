"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Piece lengths are whole numbers up to the capacity, so best-fit decreasing depends on the number of
pieces of each length alone. The driver packs that histogram (one number a length): a segment tree
over remaining capacities finds the tightest open sequence in logarithmic time, and equal pieces are
placed together. The resulting plan is a list of segments (length, ranks, sequences, offsets) whose
size depends on the capacity, not on the corpus. Executors then rank their pieces within each length
and look their places up in the plan. The result is the same as placing the pieces one by one.

Defined results: a null or empty text is one piece with the end id; an empty table gives no rows;
repeated rows are packed as separate documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep
from .textvec import blocks
from .tokens import coder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class CapacityTree:
    """Segment tree over capacities 0..n: how many open sequences have each remaining capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, number: int) -> None:
        at = remaining + self.size
        while at:
            self.count[at] += number
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open sequence has."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, first sequence, offset, pieces per sequence) and the number of sequences.

    Pieces are taken by falling length; each goes to the tightest open sequence that holds it, or opens one.
    """
    tree, open_at, opened, segments = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0, []
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, number = opened, -(-left // each)
                opened += number
            else:
                each = remaining // length
                first, have = open_at[remaining].popleft()
                number = min(have, -(-left // each))
                tree.add(remaining, -number)
                if number < have:
                    open_at[remaining].appendleft((first + number, have - number))
            placed = min(left, number * each)
            segments.append((length, rank, first, capacity - remaining, each))
            full, rest = divmod(placed, each)
            for begin, n, used in ((first, full, each * length), (first + full, 1 if rest else 0, rest * length)):
                if n:
                    open_at[remaining - used].append((begin, n))
                    tree.add(remaining - used, n)
            left -= placed
            rank += placed
    return np.array(segments, dtype=np.int64).reshape(-1, 5), opened


def _cut(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), coder(tokenizer_path)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, counts = with_end(*own.encode(block), end_id)
                pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = counts - (pieces - 1) * capacity  # the first piece of a document may be shorter
                length = np.where(number == 0, first[owner], capacity)
                start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order)) - np.searchsorted(run_of, run_of)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                view, ends = memoryview(ids.astype("<u4", copy=False).tobytes()), np.cumsum(length)
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                columns = [batch.column(0).take(pa.array(owner + block.first)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, type=pa.int64()), pa.array(np.full(len(owner), part, dtype=np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _place(segments: np.ndarray):
    """length and rank become sequence and offset by binary search in the plan."""
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    length, rank, first, offset, each = segments[order].T
    keys = (length << 44) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size, own = table["length"].to_numpy(zero_copy_only=False), table.pop("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (size << 44) + own, side="right") - 1
            within = own - rank[at]
            table["sequence_id"] = pa.array(first[at] + within // each[at])
            table["offset"] = pa.array(offset[at] + within % each[at] * size)
            yield pa.RecordBatch.from_pydict(table)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Places the pieces of all ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    with_ids: also the pieces' ids, from which a trainer reads whole sequences in (sequence_id, offset) order.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = keep(docs.mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids), schema), "pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    segments, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return ranked.select(*out, "rank").mapInArrow(_place(segments), placed + ", sequence_id long, offset long")
