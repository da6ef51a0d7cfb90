"""What must hold whatever the size: no shuffle of texts or pairs, blocks of any content, and the order of a sampled range."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from grist.functions.porter import stem
from grist.operators import codecs, evaluation, index, ranking
from grist.operators.index import ordered
from grist.operators.search import search, search_collection
from grist.settings import IndexSettings, SearchSettings
from grist.sources import readers

PLAIN = IndexSettings(False, False)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def docs(spark, n=300):
    return readers.collection(spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common running runs " + "x " * (i % 5)) for i in range(n)], "doc_id bigint, text string"))


def test_order_of_more_terms_than_a_sample_holds(spark):
    words = spark.range(300_000).selectExpr("CAST(reverse(CAST(id AS string)) AS string) AS term", "id AS df", "1L AS max_tf", "id AS cf")
    got = ordered(words).agg(F.count("*"), F.countDistinct("place"), F.max("place")).first()
    assert tuple(got) == (300_000, 300_000, 299_999)


def test_tokens_are_counted_without_a_shuffle(spark):
    texts = docs(spark).repartition(8).localCheckpoint()
    for settings in (PLAIN, IndexSettings(True, True)):
        df = index.build_postings(texts, settings)
        assert "Exchange" not in plan(df)[1].replace("Exchange RoundRobin", "")
        assert df.filter("term = 'common'").count() == 300


def test_pairs_are_not_shuffled_before_the_best_are_chosen(spark):
    asked = spark.createDataFrame([(1, "common w3"), (2, "runs x")], "query_id bigint, text string")
    df = search_collection(docs(spark), asked, SearchSettings(3), PLAIN)
    assert plan(df)[1].count("Exchange hashpartitioning") == 1  # by query, of what is best in each partition
    assert df.count() == 6


def test_best_of_many_batches_and_more_terms_than_are_told(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "common w3 w10"), (2, "runs x x"), (3, "")], "query_id bigint, text string")
    for k, conjunctive in ((0, False), (4, False), (0, True), (4, True)):
        rows = []
        for pairs, kept, most in ((2_000_000, 200_000, 200_000), (5, 3, 200_000), (5, 3, 1)):
            for name, value in (("_PAIRS", pairs), ("_ROWS", kept), ("MOST_TERMS", most)):
                monkeypatch.setattr(ranking, name, value)
            found = search_collection(docs(spark, 60), asked, SearchSettings(k, "BM25", conjunctive), IndexSettings(False, True))
            rows.append(sorted(map(tuple, found.collect())))
        assert rows[0] and rows[0] == rows[1] == rows[2]


def test_written_index_of_stems(spark, tmp_path):
    asked = spark.createDataFrame([(1, "common run")], "query_id bigint, text string")
    built = index.Index.of(docs(spark, 50), IndexSettings(True, True)).write(str(tmp_path / "i"))
    want = search_collection(docs(spark, 50), asked, SearchSettings(0), IndexSettings(True, True))
    assert sorted(map(tuple, search(built, asked, SearchSettings(0)).collect())) == sorted(map(tuple, want.collect()))


def test_a_long_word_has_a_stem():
    assert stem("y" * 5000) and stem("by" * 3000)


def test_gaps_are_made_and_summed_in_one_shuffle(spark):
    p = spark.range(100).selectExpr("CAST(id % 3 AS string) AS term", "id AS doc_id", "1L AS tf")
    df = codecs.from_gaps(codecs.gaps(p).selectExpr("term", "row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1L AS nth", "gap"))
    assert plan(df)[1].count("Exchange") == 1
    assert sorted(r["doc_id"] for r in df.collect()) == list(range(100))


def test_blocks_are_coded_as_single_lists_are():
    lists = [([3, 4, 200, 70000], [1, 9, 1, 30]), ([], []), ([1 << 40], [1]), ([0], [8]), ([127, 128, 255, 256], [2, 2, 2, 2])]
    ends = np.cumsum([0] + [len(a) for a, _ in lists])
    ids, tfs = (np.array(sum((x[i] for x in lists), []), np.int64) for i in (0, 1))
    a, b = codecs.encode_blocks(ids, tfs, ends)
    assert a.to_pylist() == [codecs.encode_deltas(x) for x, _ in lists] and b.to_pylist() == [codecs.encode_unary(x, 1) for _, x in lists]
    for part in (slice(0, 5), slice(2, 5), slice(1, 2)):
        i, t, n = codecs.decode_blocks(a[part], b[part])
        assert i.tolist() == sum((x for x, _ in lists[part]), []) and t.tolist() == sum((x for _, x in lists[part]), []) and n.tolist() == [len(x) for x, _ in lists[part]]
    negative = np.array([-(2**63), -5, 7])
    i, _, _ = codecs.decode_blocks(*codecs.encode_blocks(negative, np.ones(3, np.int64), np.array([0, 3])))
    assert i.tolist() == negative.tolist() and pa.types.is_binary(a.type)


def test_documents_stay_where_they_are_for_judgments(spark):
    texts = docs(spark).select("doc_id", F.col("content").alias("text"))
    asked = spark.createDataFrame([(1, "w3 common running"), (2, "nowhere to be found")], "query_id bigint, text string")
    got = evaluation.containment(texts, asked)
    assert "SortMergeJoin" not in plan(got)[1] and got.count() == texts.filter("contains(text, 'w3 common running')").count()
