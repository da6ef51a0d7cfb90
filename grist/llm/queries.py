"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, embedding_dedup, html_extract, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_classes(table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_best_fit_packing,
        op3_embedding_near_dedup,
        op4_source_mixing,
        op5_quality_rules,
        op6_ngram_jaccard_join,
        op7_chat_formatting,
        op8_quality_classifier,
        op9_pii,
        op10_secret_scan,
    )
}

#: All pairs by brute force; the others have fitted models, seeded draws, parsers or tokenizers, which SQL can't express.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": f"""
        WITH RECURSIVE r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e = b.e AS equal, b.e AS other FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.e = b.e OR list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
        reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
        SELECT a AS vec_id, least(a, min(b)) AS class_id, (SELECT count(DISTINCT other) FROM p WHERE p.a = reach.a AND NOT equal) AS links FROM reach GROUP BY a
    """,
}
