"""Sizes that posting lists take as varint gaps and unary frequencies, as Column expressions, and the codecs themselves for single lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap): each doc_id less the one before it in its list, the first as it is.

    One shuffle, by term: no list has more rows than there are documents, and Spark sorts it on disk if it has to.
    """
    before = F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id"))
    return postings.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce(before, F.lit(0))).alias("gap"))


def from_gaps(df: DataFrame) -> DataFrame:
    """(term, nth, doc_id) from (term, nth, gap), nth from 0: the running sum. What gaps() gave is by term already and isn't shuffled again."""
    running = F.sum("gap").over(Window.partitionBy("term").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.select("term", "nth", running.alias("doc_id"))


def varint_bytes(x: Column) -> Column:
    """Bytes of x in base 128."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < (1 << 7 * n), n).otherwise(out)
    return out.cast("bigint")


def list_sizes(postings: DataFrame) -> DataFrame:
    """(term, df, raw_bytes, varint_bytes, unary_bytes): of document ids as 32-bit numbers and as varint gaps, of frequencies in unary."""
    sized = gaps(postings).groupBy("term").agg(F.count("*").alias("df"), F.sum(varint_bytes(F.col("gap"))).alias("varint_bytes"), F.sum("tf").alias("bits"))
    return sized.select("term", "df", (F.col("df") * 4).alias("raw_bytes"), "varint_bytes", F.ceil(F.col("bits") / 8).cast("bigint").alias("unary_bytes"))


def encode_deltas(values: Iterable[int]) -> bytes:
    """Ascending numbers as varint gaps."""
    out, last = bytearray(), 0
    for v in values:
        gap, last = v - last, v
        while gap >= 0x80:
            out.append(gap & 0x7F | 0x80)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def decode_deltas(data: bytes) -> list[int]:
    """The numbers of encode_deltas()."""
    out, value, shift, last = [], 0, 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            last += value
            out.append(last)
            value = shift = 0
    return out


def encode_unary(values: Iterable[int], least: int = 0) -> bytes:
    """Each number as so many ones above least and a zero, from the highest bit; the rest of the last byte is ones."""
    bits = "".join("1" * (v - least) + "0" for v in values)
    if not bits:
        return b""
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def decode_unary(data: bytes, least: int = 0) -> list[int]:
    """The numbers of encode_unary()."""
    if not data:
        return []
    bits = bin(int.from_bytes(b"\1" + data, "big"))[3:]
    return [len(ones) + least for ones in bits.split("0")[:-1]]


#: Blocks that are coded at once.
_AT_ONCE = 2000


def _ends(lists: pa.Array) -> np.ndarray:
    """The offsets of lists or of binary values, from 0."""
    lengths = pc.binary_length(lists) if pa.types.is_binary(lists.type) else pc.list_value_length(lists)
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]).astype(np.int64)


def _bytes_of(blocks: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other."""
    start, end = blocks.offset, blocks.offset + len(blocks)
    ends = np.frombuffer(blocks.buffers()[1], np.int32)
    data = blocks.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[start] : ends[end]] if data is not None else np.zeros(0, np.uint8)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def encode_blocks(ids: np.ndarray, tfs: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """encode_deltas() and encode_unary() above 1 of many lists at once; ends: their offsets, from 0. Ids may have all 64 bits."""
    gap = ids.astype(np.int64).view(np.uint64).copy()
    gap[1:] -= gap[:-1].copy()
    first = ends[:-1][ends[:-1] < ends[1:]]
    gap[first] = ids[first].astype(np.int64).view(np.uint64)
    size = np.ones(len(gap), np.int64)
    for n in range(1, 10):
        size += gap >= np.uint64(1 << 7 * n)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(at[-1], np.uint8)
    for n in range(size.max(initial=0)):
        more = size > n
        part = (gap[more] >> np.uint64(7 * n)) & np.uint64(0x7F)
        data[at[:-1][more] + n] = part.astype(np.uint8) | np.where(size[more] > n + 1, 0x80, 0).astype(np.uint8)
    bits = np.concatenate([[0], np.cumsum(tfs)])
    used = bits[ends[1:]] - bits[ends[:-1]]
    whole = np.concatenate([[0], np.cumsum((used + 7) // 8)])
    ones = np.ones(whole[-1] * 8, np.uint8)
    ones[bits[1:] - 1 + np.repeat(whole[:-1] * 8 - bits[ends[:-1]], np.diff(ends))] = 0
    return _binary(data, at[ends]), _binary(np.packbits(ones), whole)


def decode_blocks(ids: pa.Array, tfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tfs, lengths) of encode_blocks()."""
    data, ends = _bytes_of(ids), _ends(ids)
    last = np.flatnonzero(data < 0x80)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - begin + 1
    shift = (np.arange(len(data)) - np.repeat(begin, size)) * 7
    parts = (data & 0x7F).astype(np.uint64) << shift.astype(np.uint64)
    gap = np.add.reduceat(parts, begin) if len(begin) else parts
    starts = np.searchsorted(last, ends)  # of lists, among the numbers
    lengths = np.diff(starts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gap, dtype=np.uint64)])
    docs = (sums[1:] - np.repeat(sums[starts[:-1]], lengths)).view(np.int64)
    whole = _ends(tfs) * 8
    zeros = np.flatnonzero(np.unpackbits(_bytes_of(tfs)) == 0)
    if (np.diff(np.searchsorted(zeros, whole)) != lengths).any():
        raise ValueError("a block has other numbers of documents and of frequencies")
    before = np.concatenate([[-1], zeros[:-1]]) if len(zeros) else zeros
    return docs, zeros - np.maximum(before, np.repeat(whole[:-1] - 1, lengths)), lengths


def compress(lists: DataFrame) -> DataFrame:
    """(term, block, ids, tfs): blocks of postings lists, document ids as varint gaps and frequencies in unary above 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(i, _AT_ONCE)
                flat = batch.column(2).flatten()
                ids, tfs = (flat.field(n).to_numpy(zero_copy_only=False) for n in (0, 1))
                coded = encode_blocks(ids, tfs, _ends(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *coded], ["term", "block", "ids", "tfs"])

    return lists.select("term", "block", "postings").mapInArrow(task, "term string, block bigint, ids binary, tfs binary")


def decompress(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of compress()."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(i, _AT_ONCE)
                ids, tfs, lengths = decode_blocks(batch.column(1), batch.column(2))
                terms = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), lengths)))
                yield pa.RecordBatch.from_arrays([terms, pa.array(ids), pa.array(tfs, pa.int64())], ["term", "doc_id", "tf"])

    return blocks.select("term", "ids", "tfs").mapInArrow(task, "term string, doc_id bigint, tf bigint")
