"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs:
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecflow.llm import jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup
from codecflow.llm.common import checkpointed, small_batches, table


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled threshold go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote against go."""
    small_batches(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest doc_id stays, and of its repeated rows one."""
    small_batches(spark)
    return jaccard_join.keep_one(jaccard_join.one_row_each(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur twice in what is left are cut out of the texts."""
    small_batches(spark)
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of bounded length."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", drop_by_rules),
    ("quality classifier", drop_by_classifier),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: SQL has no tokenizer, no fitted classifier and no column generation; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
