"""From raw documents to packed training sequences: STAGES, each written and read again before the next.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of ``docs``; the last returns the places of all pieces in sequences of 1024 tokens.

Defined results: a row whose text is null or has no letters goes in the first stage; a null lang or source
doesn't matter; rows with a null doc_id are learned from and judged like others; of equal rows, whatever their
ids, the third stage keeps one; very long texts are judged whole; an empty table gives an empty result, since
nothing is learned and nothing kept; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, language_id, near_dedup, packing, quality
from wayline.llm.queries import table, tokenizer_file
from wayline.llm.scratch import keep
from wayline.llm.textvec import crc_bucket


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and read like one of the learned languages."""
    return language_id.keep_accepted(docs, F.pmod(crc_bucket(F.col("doc_id")), F.lit(4)) != 2)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.pmod(crc_bucket(F.col("doc_id")), F.lit(5)) != 0)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.keep_distinct(docs, words=5, per_hundred=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed best-fit decreasing."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("language_id", language), ("quality", good), ("near_dedup", distinct), ("decontamination", uncontaminated), ("packing", packed)]

#: The stages learn, hash and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
