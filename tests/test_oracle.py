import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from grist.plans import catalogue
from tests.oracle import SF, same


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_conjunctive_search_of_whole_texts(spark):
    """Every document that contains a whole benchmark text is found for it."""
    at = SF.replace("sf0.001", "sf0.01")
    held = {(r["query_id"], r["doc_id"]) for r in catalogue._judgments(spark, at).collect()}
    got = {(r["query_id"], r["doc_id"]) for r in catalogue.QUERIES["unbounded_k"](spark, at).collect()}
    assert len(held) == 26 and held <= got
