"""Best-fit packing (operator 2): adapted best-fit decreasing with several permitted sequence lengths.

Documents are cut into tokens of a public byte-level BPE vocabulary, and into pieces at the longest permitted length; pieces go,
longest first, into the open bin that they fill best, or into a new bin of the size that costs least for each token of its own,
among those that may be opened and that they fit; if there is none, of the least permitted length. Which sizes may be opened is optimised jointly:
each shard is packed once for every set of sizes, and the packing whose bins cost least, shrunk to their contents, stays. At last each bin shrinks to the smallest
permitted length that holds its contents.

A bin of c tokens costs OVERHEAD + c + c * c / SQUARE: a fixed part, a linear one, and attention.

Pieces are spread by a hash over shards of about SHARD pieces and no more than SHARD_BYTES of token ids, and each shard is packed on its own; what moves is token ids, in two bytes
where the vocabulary allows it, once. Defined results: documents without tokens (null or empty text) are in no bin. Each row is an item of
its own, repeated or not; null ids stay null. An empty table gives no bins. Other columns are passed over.
"""

from __future__ import annotations

import base64
import functools
import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, row_key

LENGTHS = (1024, 2048, 4096, 8192)
OVERHEAD, SQUARE, SHARD, SHARD_BYTES = 128.0, 32768.0, 8192, 32 << 20
_NUMBERS = ["bin", "length", "used", "position", "doc_id", "start", "tokens"]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def width(e: tiktoken.Encoding) -> str:
    """The NumPy type that a token of this vocabulary needs."""
    return "<u2" if e.max_token_value < 1 << 16 else "<u4"


def cost(size: int) -> float:
    return OVERHEAD + size + size * size / SQUARE


def _packed(items: list[int], openable: Sequence[int], lengths: Sequence[int]) -> tuple[float, list[int], list[int]]:
    """items descend. (cost, each item's bin, each bin's contents)."""
    choice = sorted(openable, key=lambda c: (cost(c) / c, c))
    room: list[int] = []  # the room of open bins, ascending, each value once
    bins_of: dict[int, list[int]] = {}
    used: list[int] = []
    size: list[int] = []
    where = []
    for n in items:
        k = bisect_left(room, n)
        if k < len(room):
            left = room[k]
            at = bins_of[left].pop()
            if not bins_of[left]:
                del room[k], bins_of[left]
        else:
            at, left = len(used), next((c for c in choice if c >= n), None) or lengths[bisect_left(lengths, n)]
            used.append(0)
            size.append(left)
        where.append(at)
        used[at] += n
        if left := left - n:
            if left not in bins_of:
                insort(room, left)
                bins_of[left] = []
            bins_of[left].append(at)
    return sum(cost(lengths[bisect_left(lengths, u)]) for u in used), where, used


def pack(items: list[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """items (1 to the longest length, descending): each one's bin; each bin's contents and its length after shrinking."""
    lengths = sorted(lengths)
    sets = [c for k in range(1, len(lengths) + 1) for c in combinations(lengths, k)]
    _, where, used = min((_packed(items, openable, lengths) for openable in sets), key=lambda x: x[0])
    return where, used, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, longest: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, h, start, n, ids) of each piece of each row of docs: its place and number of tokens, and the tokens as little-endian bytes. Whole texts, special strings as ordinary text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(vocabulary)
        kind = width(e)
        for batch in batches:
            rows = []
            for doc, key, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "key").to_pylist(), column(batch, "text")):
                ids = np.array(e.encode_ordinary(text.as_py()) if text.is_valid else [], kind)
                rows += [(doc, key, k, len(ids[k : k + longest]), ids[k : k + longest].tobytes()) for k in range(0, len(ids), longest)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            parts = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(parts, types)], ["doc_id", "key", "start", "n", "ids"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").mapInArrow(task, "doc_id bigint, key bigint, start bigint, n bigint, ids binary")
    return found.select("doc_id", F.xxhash64("key", "start").alias("h"), "start", "n", "ids")


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, vocabulary: str = VOCABULARY, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(bin, length, used, position, doc_id, start, tokens, token_ids): a row for each piece of a document.

    length: of the bin after shrinking; used: its tokens; position: the piece's first token in the bin; start: in the document; tokens: of the piece. The sequence of
    a bin is its token_ids in the order of position.
    """
    lengths = sorted(lengths)
    items = materialise(pieces(docs, lengths[-1], vocabulary))
    total = items.agg(F.count("*").alias("items"), F.sum(F.octet_length("ids")).alias("bytes")).first()
    shards = max(1, math.ceil(total["items"] / shard), math.ceil((total["bytes"] or 0) / shard_bytes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = width(encoding(vocabulary))
        held: list[tuple[int, int | None, int, bytes]] = []
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            where, used, size = pack([x[0] for x in held], lengths)
            filled = [0] * len(used)
            for lo in range(0, len(held), 1024):
                part = list(zip(held[lo : lo + 1024], where[lo : lo + 1024]))
                rows = []
                for (n, doc, start, _), at in part:
                    rows.append((current << 32 | at, size[at], used[at], filled[at], doc, start, n))
                    filled[at] += n
                ends = np.cumsum([0] + [x[0] for x, _ in part], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x[3] for x, _ in part), kind).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows)), ids], [*_NUMBERS, "token_ids"])
            held.clear()

        for batch in batches:
            for s, *row in zip(*(column(batch, c).to_pylist() for c in ("shard", "n", "doc_id", "start", "ids"))):
                if s != current:
                    if held:
                        yield from flush()
                    current = s
                held.append(row)
        if held:
            yield from flush()

    spread = items.select(F.pmod("h", F.lit(shards)).alias("shard"), "n", "doc_id", "start", "ids", "h")
    spread = spread.repartition("shard").sortWithinPartitions("shard", F.desc("n"), "h", "doc_id", "start")
    return spread.mapInArrow(task, ", ".join(f"{c} bigint" for c in _NUMBERS) + ", token_ids array<int>")
