"""Scores of all queries, document by document, and the best of each query: in a task's own memory, without a shuffle of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

#: Terms of queries that are told to each task; of more, hits are joined and pairs shuffled.
MOST_TERMS = 200_000
#: Pairs and cells that are scored at once, and rows that are kept or given at once.
_PAIRS, _ROWS = 2_000_000, 200_000


@dataclass
class Asked:
    """The terms of all queries: words by number; those of word i are for queries query[starts[i]:starts[i + 1]], so many times each."""

    words: list[str]
    ids: pa.Array
    starts: np.ndarray
    query: np.ndarray
    times: np.ndarray
    id_type: str

    @classmethod
    def of(cls, terms: DataFrame) -> Asked | None:
        """Of (query_id, term, qtf), or None if they are too many."""
        rows = terms.select("term", "query_id", "qtf").limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            return None
        kind = terms.schema["query_id"].dataType
        words = {w: i for i, w in enumerate(sorted({r[0] for r in rows}))}
        ids = {q: i for i, q in enumerate(dict.fromkeys(r[1] for r in rows))}
        word, query, times = (np.array(x, np.int64) for x in ([words[r[0]] for r in rows], [ids[r[1]] for r in rows], [r[2] for r in rows]))
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(words) + 1))
        return cls(list(words), pa.array(list(ids), to_arrow_type(kind)), starts, query[order], times[order], kind.simpleString())

    def table(self, spark: SparkSession, df: dict[int, int] | None = None) -> DataFrame:
        """(nth, term), or (nth, term, df) of the known ones."""
        at = sorted(range(len(self.words)) if df is None else df)
        columns = {"nth": pa.array(at, pa.int32()), "term": pa.array([self.words[i] for i in at], pa.string())}
        return spark.createDataFrame(pa.table(columns | ({} if df is None else {"df": pa.array([df[i] for i in at], pa.int64())})))

    def needed(self, df: dict[int, int]) -> np.ndarray:
        """How many known terms each query has."""
        known = np.zeros(len(self.words), bool)
        known[list(df)] = True
        word = np.repeat(np.arange(len(self.words)), np.diff(self.starts))
        return np.bincount(self.query[known[word]], minlength=len(self.ids))


def hits(listed: DataFrame, asked: Asked) -> DataFrame:
    """(doc_id, size, nths, tfs) of (doc_id, size, tokens): the asked words of each document by number, and how often they are there."""
    words = asked.words

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, most = pa.array(words, pa.string()), max(1, len(words))
        for batch in batches:
            lists = batch.column(2)
            nth = pc.index_in(lists.flatten(), value_set=wanted)
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            there = pc.is_valid(nth).to_numpy(zero_copy_only=False)
            keys, counts = np.unique(owner[there] * most + nth.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(keys // most, np.arange(batch.num_rows + 1)), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % most, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "size", "nths", "tfs"])

    listed = listed.select("doc_id", "size", "tokens")
    return listed.mapInArrow(task, "doc_id bigint, size bigint, nths array<int>, tfs array<int>")


class _Best:
    """The k best of each query among the rows so far, ties to the smaller doc_id."""

    def __init__(self, k: int, queries: int):
        self.k, self.least, self.rows, self.held = k, np.full(queries, -np.inf), [], 0
        self.limit = max(_ROWS, 2 * k * queries)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, exact: np.ndarray) -> None:
        may = score >= self.least[query]
        self.rows.append(tuple(x[may] for x in (query, doc, score, exact)))
        self.held += len(self.rows[-1][0])
        if self.held > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, doc, score, exact = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((doc, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        out = tuple(x[order[place < self.k]] for x in (query, doc, score, exact))
        last = order[place == self.k - 1]
        self.least[query[last]] = score[last]
        self.rows, self.held = [out], len(out[0])
        return out


def best(weighted: DataFrame, asked: Asked, k: int, needed: np.ndarray | None = None) -> DataFrame:
    """(query_id, doc_id, score, exact) of (doc_id, nth, weight), in which a document's rows lie together in one partition.

    The k best of each query in each partition, all pairs if k is 0. needed: so many terms each query must have in a document; one if it is None.
    A task holds a batch and what is best so far.
    """
    ids, starts, query, times, queries = asked.ids, asked.starts, asked.query, asked.times, max(1, len(asked.ids))

    def scored(doc: np.ndarray, nth: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, doc, score, exact) of whole documents."""
        first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
        sizes = starts[nth + 1] - starts[nth]
        if len(first) > 1 and (sizes.sum() > _PAIRS or len(first) * queries > _PAIRS):
            at = first[len(first) // 2]
            yield from scored(doc[:at], nth[:at], weight[:at])
            yield from scored(doc[at:], nth[at:], weight[at:])
            return
        row = np.repeat(np.arange(len(doc)), sizes)
        at = np.arange(len(row)) + np.repeat(starts[nth] - np.cumsum(sizes) + sizes, sizes)
        owner = np.zeros(len(doc), np.int64)
        owner[first[1:]] = 1
        key = np.cumsum(owner)[row] * queries + query[at]
        sums = np.bincount(key, weight[row] * times[at], len(first) * queries)
        found = np.bincount(key, minlength=len(first) * queries)
        cell = np.flatnonzero(found > 0 if needed is None else (found > 0) & (found == np.tile(needed, len(first))))
        yield cell % queries, doc[first][cell // queries], np.floor(sums[cell] * 1e6 + 0.5) / 1e6, sums[cell]

    def rows(query: np.ndarray, doc: np.ndarray, score: np.ndarray, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(doc), _ROWS):
            part = [x[i : i + _ROWS] for x in (query, doc, score, exact)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(part[0])), *map(pa.array, part[1:])], ["query_id", "doc_id", "score", "exact"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, over = _Best(k, queries), None

        def put(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for x in scored(*part) if len(part[0]) else ():
                if k:
                    top.add(*x)
                else:
                    yield from rows(*x)

        for batch in batches:
            part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if over is not None:
                part = tuple(np.concatenate(x) for x in zip(over, part))
            changes = np.flatnonzero(part[0][1:] != part[0][:-1])
            end = changes[-1] + 1 if len(changes) else 0  # the last document may go on
            yield from put(tuple(x[:end] for x in part))
            over = tuple(x[end:] for x in part)
        if over is not None:
            yield from put(over)
        if top.rows:
            yield from rows(*top.cut())

    return weighted.select("doc_id", "nth", "weight").mapInArrow(task, f"query_id {asked.id_type}, doc_id bigint, score double, exact double")
