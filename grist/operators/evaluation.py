"""Retrieval measures for each query, and their means. Unjudged documents aren't relevant; grade 1 and more is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, grade, total) for the queries that have judgments; total: the query's relevant documents."""
    totals = qrels.groupBy("query_id").agg(F.sum((F.col("grade") >= 1).cast("bigint")).alias("total"))
    graded = run.select("query_id", "rank", "doc_id").join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    return totals.join(graded, "query_id", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


#: Bytes of queries that are told to every task.
_TOLD = 16 << 20


def containment(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade 1) of documents (doc_id, text) that contain a query's (query_id, text) whole text.

    A word inside of the query's text, between white space, is such a word of each document that contains it; the longest is a key to join by before texts are compared.
    Texts without such a word, of two words or fewer, are compared with every document. Queries that fit are told to every task, so that documents don't move.
    """
    words = F.split("text", r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = queries.filter("text IS NOT NULL").select("query_id", F.col("text").alias("part"), longest.alias("word"))
    keyed = asked.filter("word IS NOT NULL")
    body = docs.select("doc_id", F.col("text").alias("body"))
    if (keyed.agg(F.sum(F.octet_length("part") + 64)).first()[0] or 0) <= _TOLD:
        wanted = F.broadcast(keyed.agg(F.collect_set("word").alias("wanted")))  # one row
        found = body.filter("body IS NOT NULL").crossJoin(wanted).select("doc_id", "body", F.explode_outer(F.array_intersect(F.split("body", r"\s+"), "wanted")).alias("word"))
        near = found.join(F.broadcast(keyed), "word").filter("contains(body, part)")
    else:
        there = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(keyed, "word").select("doc_id", "query_id", "part")
        near = there.join(body, "doc_id").filter("contains(body, part)")
    rest = body.join(asked.filter("word IS NULL"), F.expr("contains(body, part)"))
    return near.select("query_id", "doc_id").unionByName(rest.select("query_id", "doc_id")).distinct().withColumn("grade", F.lit(1))


def _mean_of(df: DataFrame, value, name: str) -> DataFrame:
    return df.groupBy("query_id").agg(F.round(value, 6).alias(name))


def _relevant():
    return (F.col("grade") >= 1).cast("double")


def precision(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): relevant ones among the first k, over k."""
    return _mean_of(judged(run, qrels), F.sum(F.when(F.col("rank") < k, _relevant()).otherwise(0.0)) / k, "precision")


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): relevant ones among the first k, over all relevant ones; 0 without any."""
    found = F.sum(F.when(F.col("rank") < k, _relevant()).otherwise(0.0))
    total = F.max("total")
    return _mean_of(judged(run, qrels), F.when(total > 0, found / total).otherwise(0.0), "recall")


def average_precision(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, average_precision), cut at k."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = judged(run, qrels).withColumn("hits", F.sum(_relevant()).over(w))
    gain = F.sum(F.when((F.col("rank") < k) & (F.col("grade") >= 1), F.col("hits") / (F.col("rank") + 1)).otherwise(0.0))
    total = F.max("total")
    return _mean_of(at, F.when(total > 0, gain / total).otherwise(0.0), "average_precision")


def _ideal(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the largest gain that k documents can have."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    return qrels.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("best"))


def _within(k: int, value):
    return F.sum(F.when(F.col("rank") < k, value).otherwise(0.0))


def ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg), cut at k, gain equal to grade."""
    got = judged(run, qrels).groupBy("query_id").agg(_within(k, F.col("grade") / F.log2(F.col("rank") + 2)).alias("dcg"))
    both = got.join(_ideal(qrels, k), "query_id", "left")
    return both.select("query_id", F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"))


def evaluate(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of means over the judged queries: p_5, p_10, recall_1000, ndcg_cut_10, map_cut_10. Run and judgments meet once."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = judged(run, qrels).withColumn("hits", F.sum(_relevant()).over(w))
    total, relevant = F.max("total"), F.col("grade") >= 1
    share = lambda x: F.round(F.when(total > 0, x / total).otherwise(0.0), 6)
    each = at.groupBy("query_id").agg(
        F.round(_within(5, _relevant()) / 5, 6).alias("p_5"),
        F.round(_within(10, _relevant()) / 10, 6).alias("p_10"),
        share(_within(1000, _relevant())).alias("recall_1000"),
        _within(10, F.col("grade") / F.log2(F.col("rank") + 2)).alias("dcg"),
        share(_within(10, F.when(relevant, F.col("hits") / (F.col("rank") + 1)).otherwise(0.0))).alias("map_cut_10"),
    )
    gain = F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg_cut_10")
    each = each.join(_ideal(qrels, 10), "query_id", "left").select("p_5", "p_10", "recall_1000", gain, "map_cut_10")
    return each.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_5", "p_10", "recall_1000", "ndcg_cut_10", "map_cut_10")])


def latency(lines: DataFrame) -> DataFrame:
    """(mean_ms, stddev_ms) of the latency lines among the lines (value) of a session; the deviation is the population's."""
    ms = lines.filter(F.col("value").rlike(r"^#\t\d")).select((F.element_at(F.split("value", "\t"), -1).cast("double") / 1000).alias("ms"))
    return ms.agg(F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.stddev_pop("ms"), 3).alias("stddev_ms"))
