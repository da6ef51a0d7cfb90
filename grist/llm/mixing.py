"""Mixing sources to target weights (operator 4): a multivariate-hypergeometric splitting tree over blocks.

Each source's documents, in the order of a seeded hash, are its permuted order, cut into blocks of BLOCK documents, the last one
possibly short. The mixture has a size in documents, by default the share KEEP of those that there are. Each source's quota is its share, by weight,
of that size, up to the rounding to blocks; a source whose quota exceeds its supply gives everything it has, once, and what it lacks is spread
over the others by weight. So sources that have enough are in the ratios of their weights, and no source, small or hot, bounds the others.
The root of the tree holds the quotas of all sources;
a node splits its quotas between the two halves of its output shards by a multivariate hypergeometric draw, down to
single shards, so shards are equal in blocks and jointly distributed as a uniform shuffle of all chosen blocks. A shard takes the
next blocks of each source, so blocks are disjoint, and shuffles its own documents.

Nodes draw from generators seeded by their place; any task can compute any part of the tree, and the driver only
ever holds one count for each source, as a node of the tree does. Draws are exact at every size. Ranks come from a shuffle of keys by (source, leading bits of
the hash), whose groups have about BUCKET documents at every size, so a hot source is no skew.

Defined results: null is a source of its own. A source of weight 0 or null, or that isn't named in weights, gives none; one whose quota is
far below a block may give none. Rows that agree in source, doc_id and text share a rank and stay together, so quotas are exact if rows are distinct.
An empty table gives an empty mixture. Other columns are passed over, or passed through by mixed().
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, row_key, small_or_not

BLOCK, SHARD, BUCKET, TEMPERATURE, SEED = 8, 4096, 4096, 0.7, 4
#: The share of all documents that a mixture without a size has.
KEEP = 0.9


def quotas(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None = None, size: int | None = None, block: int = BLOCK, temperature: float = TEMPERATURE) -> dict[str | None, int]:
    """Blocks for each source, of size documents in all. Without weights, a source weighs its number of documents to the power of temperature."""
    w = {s: float(n) ** temperature if weights is None else float(weights.get(s) or 0.0) for s, n in counts.items()}
    w = {s: x for s, x in w.items() if x > 0 and counts[s] > 0}
    supply = sum(counts[s] for s in w)
    left, free = min(supply, math.ceil(KEEP * supply) if size is None else size), sum(w.values())
    out = {}
    for s in sorted(w, key=lambda s: (counts[s] / w[s], s is None, s or "")):
        if left * w[s] < counts[s] * free:
            break
        out[s] = math.ceil(counts[s] / block)
        left, free = left - counts[s], free - w[s]
    exact = {s: left * x / free / block for s, x in w.items() if s not in out}
    own = {s: math.floor(e + 1e-9) for s, e in exact.items()}
    more = math.ceil(sum(exact.values()) - 1e-9) - sum(own.values())
    for s in sorted(exact, key=lambda s: (own[s] - exact[s], s is None, s or ""))[:more]:  # by largest remainder
        own[s] += 1
    return {s: n for s, n in (out | own).items() if n}


def _draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Hypergeometric, at any size: how many of n draws from good + bad are good.

    NumPy's own ends at 10**9. Beyond it each item is kept with chance n / all, which is binomial for good and for bad ones; given how many are kept, they are a uniform
    sample of that many, and the few that are missing or too many are drawn in the same way.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if n <= 1000:
        got = 0
        for k in range(n):
            got += int(rng.integers(good + bad - k)) < good - got
        return got
    x, y = (int(rng.binomial(k, n / (good + bad))) for k in (good, bad))
    if x + y > n:
        return x - _draw(x, y, x + y - n, rng)
    return x + _draw(good - x, bad - y, n - x - y, rng)


def split(colours: list[int], n: int, rng: np.random.Generator) -> list[int]:
    """How many of each colour n draws without replacement get."""
    out, rest = [], sum(colours)
    for c in colours:
        rest -= c
        x = _draw(c, rest, n, rng)
        out.append(x)
        n -= x
    return out


def tree(blocks: list[int], shards: int, lo: int, hi: int, seed: int = SEED) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, first block of each source, blocks of each source) for the shards from lo to hi - 1 of all."""
    total = sum(blocks)
    todo = [(0, shards, [0] * len(blocks), list(blocks))]
    while todo:
        a, b, first, have = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, first, have
            continue
        mid = (a + b) // 2
        left = split(have, total * mid // shards - total * a // shards, np.random.default_rng([seed, a, b]))
        todo.append((mid, b, [f + x for f, x in zip(first, left)], [h - x for h, x in zip(have, left)]))
        todo.append((a, mid, first, left))


def _source(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    key = row_key(F.lit(seed), docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return [_source(docs["source"]).alias("__s"), key.alias("__h")]


def _assigned(docs: DataFrame, weights: Mapping[str | None, float] | None, size: int | None, block: int, shard: int, seed: int) -> tuple[DataFrame, int]:
    """(doc_id, source, __s, __h, __bucket, __shard) of the documents that are chosen; the bits of __bucket."""
    spark = docs.sparkSession
    keys = materialise(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), *_keys(docs, seed)))
    counts = {r["__s"]: r["n"] for r in keys.groupBy("__s").agg(F.count("*").alias("n")).collect()}  # one row a source
    own = None if weights is None else {("n" if s is None else "s" + s): w for s, w in weights.items()}
    blocks = quotas(counts, own, size, block)
    names = sorted(blocks)
    have = [blocks[s] for s in names]
    shards = max(1, math.ceil(sum(have) * block / shard))
    bits = max(0, math.ceil(math.log2(max([1, *counts.values()]) / BUCKET)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = column(batch, "id").to_numpy()
            rows = [(names[k], first[k] + j, m) for m, first, n in (tree(have, shards, int(part[0]), int(part[-1]) + 1, seed) if len(part) else ()) for k in range(len(names)) for j in range(n[k])]
            s, b, m = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], ["__s", "__block", "__shard"])

    plan = spark.range(0, shards if names else 0, 1, max(1, math.ceil(shards / 256))).mapInArrow(walk, "__s string, __block bigint, __shard bigint")
    # Spark shifts by the amount modulo 64.
    bucket = F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("bigint")
    keys = keys.withColumn("__bucket", bucket)
    sizes = keys.groupBy("__s", "__bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("n"))
    ranked = keys.withColumn("__rank", F.rank().over(Window.partitionBy("__s", "__bucket").orderBy("__h")) - 1)
    ranked = ranked.join(small_or_not(sizes, 40), ["__s", "__bucket"])
    ranked = ranked.withColumn("__block", F.floor((F.col("__rank") + F.col("__before")) / block))
    return ranked.join(small_or_not(materialise(plan), 32), ["__s", "__block"]).select("doc_id", "source", "__s", "__h", "__bucket", "__shard"), bits


def mix_plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, position, doc_id, source) of the mixture: every chosen document, and its place in its shard's own shuffle."""
    chosen, _ = _assigned(docs, weights, size, block, shard, seed)
    order = Window.partitionBy("__shard").orderBy(F.xxhash64(F.lit(seed + 1), "__h"), "__h", "source")
    return chosen.select(F.col("__shard").alias("shard"), (F.row_number().over(order) - 1).cast("bigint").alias("position"), "doc_id", "source")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The rows of docs that are chosen, all columns, each shard together in its shuffled order; the texts are shuffled once.

    What a shard takes of a source is an interval of hashes, so documents find their shard by comparing, without being joined by id.
    """
    chosen, bits = _assigned(docs, weights, size, block, shard, seed)
    ends = chosen.groupBy("__s", "__shard").agg(F.min(F.struct("__bucket", "__h")).alias("lo"), F.max(F.struct("__bucket", "__h")).alias("hi"))
    ends = materialise(ends.withColumn("__bucket", F.explode(F.sequence("lo.__bucket", "hi.__bucket"))))
    own = docs.select(F.struct("*").alias("__row"), *_keys(docs, seed))  # a struct, so that no column of docs clashes
    own = own.withColumn("__bucket", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    here = F.struct("__bucket", "__h")
    placed = own.join(small_or_not(ends, 64), ["__s", "__bucket"]).filter((here >= F.col("lo")) & (here <= F.col("hi")))
    placed = placed.repartition("__shard").sortWithinPartitions("__shard", F.xxhash64(F.lit(seed + 1), "__h"), "__h")
    return placed.select("__row.*")
