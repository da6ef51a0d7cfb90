"""Structured Streaming: an index that grows by a segment with each micro-batch, and queries answered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.search import search, with_numbers
from ..settings import IndexSettings, SearchSettings
from ..sources.readers import numbered


def index_stream(passages: DataFrame, path: str, checkpoint: str, settings: IndexSettings | None = None) -> StreamingQuery:
    """Indexes a stream of (doc_no, content): each micro-batch becomes a segment of the index at path.

    A segment is named by its batch and written whole, so a batch that is repeated after a failure replaces itself. Ends when all that is there has been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Index.of(numbered(batch), settings).write(path, f"batch{number}")

    return passages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, settings: SearchSettings | None = None) -> StreamingQuery:
    """Answers a stream of (query_id, text); each micro-batch's results (doc_id, doc_no, query_id, rank, score) go to a folder of their own under path."""

    def answer(batch: DataFrame, number: int) -> None:
        with_numbers(search(index, batch, settings), index.docs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_segments(spark: SparkSession, path: str, to: str) -> Index:
    """The index at path, of any number of segments, written as one to another place."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("segments can't be merged in place")
    parts = Index.load(spark, path)
    return Index(parts.docs, parts.postings.drop("bucket"), parts.lexicon, parts.stats, parts.settings).write(to)
