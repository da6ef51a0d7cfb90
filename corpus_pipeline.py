"""The corpus pipeline: from documents to packed training sequences, each stage an operator of grist.llm.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

What all stages do with unusual rows: documents with null or empty text don't get past the first; a text without words is in no group of copies; equal
rows are copies of each other, of which one stays, and documents that share a doc_id but not their text are documents of their own, null ids included. A
very long text is read whole and cut into several pieces at last. Ties go by doc_id and hashes of rows, so results don't depend on partitions. Without labels of both
classes nothing is rejected. Columns besides doc_id and text, whatever their names, pass through all stages but the last; source may be null. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grist.llm import mixing, ngram_join, packing, quality_classifier, secret_scan
from grist.llm.common import discard, materialise, scratch, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the naive Bayes support vectors, fitted to the labelled of them, don't reject; a null or empty text is rejected."""
    ship(spark)
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id (one without only if no other is there), of each group that n-gram Jaccard pairs connect."""
    ship(spark)
    return ngram_join.drop_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced by a mark."""
    ship(spark)
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at their target weights, as far as their supplies go, shard by shard in shuffled order."""
    ship(spark)
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of permitted lengths, a row for each piece of a document, with its token ids."""
    ship(spark)
    return packing.packed(docs)


STAGES = [("quality classifier", quality), ("near copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("packing", sequences)]

#: SQL can't express the fitted classifier, MinHash banding or the seeded draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; what is between them goes to the folder that all executors share, and is deleted when the next stage has been written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return docs
