"""A corpus pipeline of the training-data operators, each stage on all that its predecessor kept.

Stages: quality rules, near-duplicates, repeated strings, benchmark passages, packing. All but
the last return the columns of ``documents``; each result is written to shared storage and read again.

All stages take tables with further columns, whatever their names and types, and hand them on; rows that are repeated
stay repeated or go together; an empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import materialise
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.packing import pack_documents
from millrace.llm.quality_rules import keep_good
from millrace.llm.simhash import keep_one
from millrace.llm.suffix_dedup import drop_repeats


#: Less than any 51 words in a row of the documents labelled good at sf0.1, the shortest of which take 238 bytes. Runs of
#: shorter words, as in tables and lists, are missed where 51 of them take less (see README).
REPEAT_BYTES = 232


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the decision list learned from ``labels`` reject; null and empty texts go. Without labels the base rules alone decide."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Rows without an id stay; texts without words are alike.
    """
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of REPEAT_BYTES or more that occur twice or more; drop documents of which no word is left. A null text becomes an empty one."""
    return drop_repeats(docs, length=REPEAT_BYTES)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half or more of a benchmark item's words in shared passages; null and empty texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in sequences of at most 2048 tokens; a null or empty text is its end id."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeats),
    ("benchmark passages", benchmark),
    ("packing", packing),
]

#: Learning, components and tokenising have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
