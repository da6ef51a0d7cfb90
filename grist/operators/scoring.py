"""Scorers: a registry of functions that make a Column of a term's score in a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.3, 0.5

#: (tf, df, size, n, adl) -> score
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


def idf(df: Column, n: Column) -> Column:
    """ln(N / df), without smoothing."""
    return F.log(n / df)


def tfidf(tf: Column, df: Column, size: Column, n: Column, adl: Column) -> Column:
    return (F.lit(1.0) + F.log(tf)) * idf(df, n)


def bm25(tf: Column, df: Column, size: Column, n: Column, adl: Column) -> Column:
    return tf / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / adl) + tf) * idf(df, n)


SCORERS: dict[str, Scorer] = {"BM25": bm25, "TFIDF": tfidf}


def parse_metric(name: str) -> str:
    """The name of a scorer, whatever its case."""
    if name.upper() not in SCORERS:
        raise ValueError(f"unknown metric {name}, allowed: {'|'.join(sorted(SCORERS))}")
    return name.upper()
