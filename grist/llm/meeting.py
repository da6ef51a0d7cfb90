"""From band hashes to verified links, with traffic in proportion to the items and not to their pairs.

An item's label is the least item that it meets in any band, followed twice. Items of one label are verified together: each
ships its load (a set, a vector) there once. Bands whose items have several labels are verified too, between labels: two such items
as a pair of their own, more as a group. Groups of more than BLOCK items or BLOCK_BYTES bytes are cut into blocks that meet
pairwise, each pair of blocks in a task of its own. So every pair that shares a band is verified, exactly once, in groups of any size.

No group is ever collected: bands, labels and groups are counted by partial aggregates, and what a task holds is bounded by two blocks. A task gives each
item's number of links and no more edges than connect its items; pairs are never written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, column, discard, materialise, small_or_not

BLOCK, BLOCK_BYTES = 2000, 16 << 20

#: (loads, parts, labels, forest) -> (i, j), i < j: the alike among pairs that allowed() admits; with forest, edges enough to connect these.
Verify = Callable[[list[bytes], np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]

TASK = "rep bigint, kind int, g bigint, g2 bigint, part int, label bigint, wide array<bigint>"
SHIPPED = ["rep", "kind", "g", "g2", "part", "label", "wide"]


def allowed(i: int, parts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the items after i it is to be compared with."""
    ok = labels[i + 1 :] != labels[i]
    return ok if parts[i] < 0 else ok & (parts[i + 1 :] != parts[i])


def _blocks(members: DataFrame, groups: DataFrame, kind: int, block: int, block_bytes: int) -> DataFrame:
    """The tasks of members (rep, g, label) of groups (g, n, bytes)."""
    sizes = groups.select("g", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes, F.lit(1.0))).alias("blocks"))
    cut = members.join(small_or_not(sizes, 16), "g").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    part = F.when(lo == hi, -1).when(F.col("own") == lo, 0).otherwise(1)
    return cut.select("rep", F.lit(kind).alias("kind"), "g", F.shiftleft(lo, 32).bitwiseOR(hi).alias("g2"), part.alias("part"), "label")


def tasks(items: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rep, kind, g, g2, part, label, wide) for materialised items (rep, size, bands): who has to be verified with whom, by (kind, g, g2).

    size: bytes of the item's load; part and label: see allowed(); wide: the bands of several labels and more than two items that the item is in.
    """
    each = items.select("rep", F.explode("bands").alias("band"))
    bands = materialise(each.groupBy("band").agg(F.min("rep").alias("lo"), F.count("*").alias("n")).filter("n > 1").select("band", "lo"))
    met = materialise(each.join(small_or_not(bands, 16), "band").select("band", "rep", "lo"))
    least = materialise(met.groupBy("rep").agg(F.min("lo").alias("up")))
    few = least.count() * 24 <= BROADCAST_BYTES
    maybe = F.broadcast if few else lambda df: df
    labels = least
    for _ in range(2):  # to the least item of the least item met, so that all of a dense group agree
        labels = labels.join(maybe(least.select(F.col("rep").alias("up"), F.col("up").alias("top"))), "up").select("rep", F.col("top").alias("up"))
    labels = materialise(items.select("rep", "size").join(maybe(labels), "rep"))

    named = met.select("band", "rep").join(maybe(labels), "rep")
    total = (F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = named.groupBy("band").agg(*total, F.min("rep").alias("a"), F.max("rep").alias("b"), F.min("up").alias("lo"), F.max("up").alias("hi"))
    mixed = materialise(mixed.filter("lo < hi").select(F.col("band").alias("g"), "n", "bytes", "a", "b"))
    wide = mixed.filter("n > 2")
    across = materialise(named.select("rep", F.col("band").alias("g"), F.col("up").alias("label")).join(small_or_not(wide.select("g"), 8), "g"))

    groups = materialise(labels.groupBy(F.col("up").alias("g")).agg(*total).filter("n > 1"))
    inside = _blocks(labels.select("rep", F.col("up").alias("g"), F.col("rep").alias("label")), groups, 0, block, block_bytes)
    pairs = mixed.filter("n = 2").select("a", "b").distinct()
    two = pairs.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).alias("kind"), F.col("a").alias("g"), F.col("b").alias("g2"), F.lit(-1).alias("part"))
    apart = two.withColumn("label", F.col("rep")).unionByName(_blocks(across, wide, 2, block, block_bytes))
    lists = across.groupBy("rep").agg(F.sort_array(F.collect_list("g")).alias("wide"))  # no more than an item has bands
    apart = apart.join(lists, "rep", "left")
    needed = materialise(inside.withColumn("wide", F.lit(None).cast("array<bigint>")).unionByName(apart))
    discard(bands, met, least, labels, mixed, across, groups)
    return needed


def placed(needed: DataFrame, items: DataFrame) -> DataFrame:
    """tasks() with the keys (r1, r2) of the rows that have the loads, marked for broadcast if they are few."""
    keys = items.select("rep", "r1", "r2").join(small_or_not(materialise(needed.select("rep").distinct()), 8), "rep", "left_semi")
    return small_or_not(materialise(needed.join(small_or_not(materialise(keys), 24), "rep")), 96)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's group, given edges."""
    root = np.arange(n)
    while True:
        new, a, b = root.copy(), root[i], root[j]
        lo = np.minimum(a, b)
        np.minimum.at(new, a, lo)
        np.minimum.at(new, b, lo)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def verified(shipped: DataFrame, verify: Verify, forest: bool = False) -> DataFrame:
    """What verify accepts among the rows (rep, kind, g, g2, part, label, wide, load) of each task: (a, b, n).

    b is null: a has n links to others (not with forest). b isn't: an edge, such that edges connect what links connect.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        current = None
        out: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []

        def flush() -> None:
            if len(held) < 2:
                return
            reps = np.array(sorted(held), np.int64)
            rows = [held[r] for r in reps.tolist()]
            parts, labels = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
            i, j = verify([x[3] for x in rows], parts, labels, forest)
            kind, g = current[:2]
            if kind and not forest and len(i):  # a pair that meets in several of these counts in the first only, one that meets in a wide band not by itself
                sets = [frozenset(x[2] or ()) for x in rows]
                first = np.array([not any(kind == 1 or w < g for w in sets[p] & sets[q]) for p, q in zip(i.tolist(), j.tolist())], bool)
                i, j = i[first], j[first]
            if not len(i):
                return
            if not forest:
                links = np.bincount(i, minlength=len(reps)) + np.bincount(j, minlength=len(reps))
                some = np.flatnonzero(links)
                out.append((reps[some], None, links[some]))
            root = _roots(len(reps), i, j)
            tied = np.flatnonzero(root != np.arange(len(root)))
            out.append((reps[root[tied]], reps[tied], None))

        def batch_of() -> pa.RecordBatch:
            a = [pa.array(x[0], pa.int64()) for x in out]
            b, n = ([pa.nulls(len(x[0]), pa.int64()) if x[k] is None else pa.array(x[k], pa.int64()) for x in out] for k in (1, 2))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) if x else pa.array([], pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

        for batch in batches:
            for rep, kind, g, g2, *row in zip(*(column(batch, c).to_pylist() for c in (*SHIPPED, "load"))):
                if (kind, g, g2) != current:
                    flush()
                    held.clear()
                    current = (kind, g, g2)
                held.setdefault(rep, row)
            yield batch_of()
        flush()
        yield batch_of()

    own = shipped.select(*SHIPPED, "load").repartition("kind", "g", "g2").sortWithinPartitions("kind", "g", "g2")
    return own.mapInArrow(compare, "a bigint, b bigint, n bigint")


def components(edges: DataFrame) -> DataFrame:
    """(rep, root): the least member of each connected group of (a, b). Labels halve their way to the root; each round is written to the shared folder."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(now.select(F.col("rep").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = now.join(near, now["rep"] == near["a"], "left").select("rep", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = now.select(F.col("rep").alias("root"), F.col("root").alias("top"))
        new = materialise(step.join(up, "root", "left").select("rep", "was", F.least("root", "top").alias("root")))
        discard(now)
        if new.filter("root <> was").isEmpty():
            discard(both)
            return new.select("rep", "root")
        now = new


def classes(found: DataFrame, matches: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of the rows of found (id, r1, r2, f1, f2, size, bands); rows that agree in f1 and f2 are copies.

    matches takes items (rep, r1, r2, f1, f2, size, bands), a row for each of the different ones, and gives verified(). Results, all materialised: found without
    bands; (f1, f2, root, links) of each one with copies or links, root for its class; (root, best) with the class's least (none, id, r1, r2).
    """
    found = materialise(found)
    who = F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")
    items = found.groupBy("f1", "f2").agg(F.min(who).alias("who"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    # The ids are fixed by being written; that they are different is all that counts.
    items = materialise(items.select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", "who", F.col("who.r1").alias("r1"), F.col("who.r2").alias("r2"), "copies", "size", "bands"))
    met = materialise(matches(items))
    roots = components(met.filter("b IS NOT NULL"))
    links = met.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = items.select("rep", "f1", "f2", "who", "copies").join(roots, "rep", "left").join(links, "rep", "left").filter("root IS NOT NULL OR copies > 1")
    named = materialise(named.select("f1", "f2", "who", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))
    best = materialise(named.groupBy("root").agg(F.min("who").alias("best")))
    return found.drop("bands"), named.drop("who"), best


def class_rows(found: DataFrame, named: DataFrame, best: DataFrame) -> DataFrame:
    """(id, class_id, links) of each row that has a copy or a link."""
    where = named.join(small_or_not(best.select("root", F.col("best.id").alias("class_id")), 16), "root").select("f1", "f2", "class_id", "links")
    return found.select("id", "f1", "f2").join(small_or_not(materialise(where), 32), ["f1", "f2"]).select("id", "class_id", "links")


def surplus(found: DataFrame, named: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r1, r2) of the rows that aren't their class's best, and of best rows that are there more than once."""
    where = materialise(named.join(small_or_not(best, 40), "root").select("f1", "f2", F.col("best.r1").alias("b1"), F.col("best.r2").alias("b2")))
    each = found.select("r1", "r2", "f1", "f2").join(small_or_not(where, 32), ["f1", "f2"])
    each = materialise(each.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.max((F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2"))).alias("best")))
    return each.filter("NOT best").select("r1", "r2"), each.filter("best AND n > 1").select("r1", "r2")


def without(rows: DataFrame, keys: tuple[Column, Column], gone: DataFrame, once: DataFrame) -> DataFrame:
    """rows without those whose keys are in gone; of those in once, one each."""
    keyed = rows.select(F.struct("*").alias("__row"), keys[0].alias("__r1"), keys[1].alias("__r2"))
    on = ["__r1", "__r2"]
    gone, once = (df.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")) for df in (gone, once))
    if once.isEmpty():
        return keyed.join(small_or_not(gone, 16), on, "left_anti").select("__row.*")
    kept = keyed.join(small_or_not(gone.union(once), 16), on, "left_anti").select("__row.*")
    return kept.unionByName(keyed.join(small_or_not(once, 16), on, "left_semi").dropDuplicates(on).select("__row.*"))
