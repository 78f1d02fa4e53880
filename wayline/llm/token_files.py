"""Token-id files: Parquet list columns with chosen encodings, row groups and page indexes.

Documents are written in ascending id order. Token ids are a ``list<int32>`` column; its dictionary
fits a 49k vocabulary, so a page holds about 16 bits an id or fewer. Metadata columns are delta
encoded (format version 2 pages). Row groups are bounded by ``row_group_bytes`` and pages by
``page_bytes``; Parquet's column and offset indexes then let a reader fetch the pages of a range of
doc_ids alone (``read_documents``), or metadata without any ids.

Defined results: a null text is an empty one and gives the end id alone; a null doc_id sorts first;
repeated doc_ids stand together, ordered by a hash of their text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textvec import blocks
from .tokens import coder, with_end

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(tokenizer_path: str, end_id: int, words_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, own = TaskContext.get().partitionId(), 0, coder(tokenizer_path, words_only)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, counts = with_end(*own.encode(block), end_id)
                ends = np.cumsum(counts)
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, n),
                        pa.array(np.full(n, part, dtype=np.int32)),
                        pa.array(done + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    words_only: bool = False,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    dictionary: bool = True,
) -> None:
    """Encodes ``docs`` (doc_id, text) and writes them under ``path`` in ascending doc_id order.

    ``part`` numbers the files' ranges of doc_ids in ascending order; ``local_start`` counts the ids
    before a document within its part, so that a global start needs one sum a part.
    """
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode(tokenizer_path, end_id, words_only), SCHEMA).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": str(dictionary).lower(),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
        }
    ).parquet(path)


def read_documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a range of doc_ids; the bounds reach the page indexes as pushed filters."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def part_starts(df: DataFrame) -> DataFrame:
    """part and the ids in all parts before it: one row a part."""
    sums = df.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    return sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(lists) else np.empty(0, dtype=np.int64)
        view, begin, crcs = memoryview(values), 0, []
        for end in ends.tolist():
            crcs.append(zlib.crc32(view[4 * begin : 4 * end]))
            begin = end
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends, prepend=0)), pa.array(crcs, type=pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the stored files."""
    stored = read_documents(spark, path)
    digests = stored.select("doc_id", "part", "local_start", "ids").mapInArrow(_checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(part_starts(stored)), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
