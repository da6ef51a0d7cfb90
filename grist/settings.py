"""Settings of an index and of a search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexSettings:
    """How texts were analysed; kept with the index, and used for its queries too. buckets: folders that postings are spread over, by a hash of the term."""

    stopwords_removal: bool = True
    stemming: bool = True
    compression: bool = True
    version: int = 2
    buckets: int = 16


@dataclass(frozen=True)
class SearchSettings:
    """k: results for each query, 0 for all; metric: BM25 or TFIDF in any case; conjunctive: all known terms have to be there."""

    k: int = 10
    metric: str = "BM25"
    conjunctive: bool = False

    def __post_init__(self) -> None:
        from .operators.scoring import parse_metric

        if self.k < 0:
            raise ValueError("k must not be negative")
        object.__setattr__(self, "metric", parse_metric(self.metric))
