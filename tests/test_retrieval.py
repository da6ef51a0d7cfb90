import io
import math

import pytest
from pyspark.sql import functions as F

from grist import cli, storage
from grist.functions.analysis import analyze, byte_length
from grist.functions.porter import stem, stem_vocabulary
from grist.functions.sql import plain_tokens, register
from grist.operators import codecs, evaluation
from grist.operators.index import Index, ordered
from grist.operators.scoring import parse_metric
from grist.operators.search import run_line, search, search_collection, search_one
from grist.settings import IndexSettings, SearchSettings
from grist.sources import readers
from grist.streaming.incremental import index_stream, merge_segments, search_stream

PLAIN = IndexSettings(False, False)
DOCS = [
    (0, "The cat and the dog; the end."),
    (1, "A dog is the only purpose"),
    (2, "the offender, the court"),
    (11, "An offender's café — the naïve one"),
    (12, ""),
    (13, "rare " * 40 + "the"),
]


def frame(spark, docs=DOCS):
    return readers.collection(spark.createDataFrame(docs, "doc_id bigint, text string"))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")


def found(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select("query_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Don't STOP!", ["don", "t", "stop"]),
        ("Crème brûlée à l'école", ["creme", "brulee", "a", "l", "ecole"]),
        ("<b class='x'>bold</b> text <i\n>two", ["bold", "text", "two"]),
        ("soft­hyphen zero‍width﻿", ["softhyphen", "zerowidth"]),
        ("a\r b\tc\nd", ["a", "b", "c", "d"]),
        ("smile \U0001f600 © 5 + 3 = $8", ["smile", "\U0001f600", "©", "5", "3", "8"]),
        ("ΣΑΣ &amp; <open", ["σασ", "amp", "open"]),
        ("  ", []),
        (None, []),
    ],
)
def test_analysis(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(analyze(F.col("t"))).first()[0] == tokens


def test_stopwords_and_byte_length(spark):
    df = spark.createDataFrame([("\t The résumé of them \n",)], "t string")
    assert df.select(analyze(F.col("t"), True)).first()[0] == ["resume"]
    assert df.select(byte_length(F.col("t"))).first()[0] == len("The résumé of them".encode())


def test_porter_published_examples(spark):
    pairs = dict(
        caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat", troubled="troubl", sized="size",
        hopping="hop", falling="fall", hissing="hiss", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", valenci="valenc", vietnamization="vietnam",
        operator="oper", triplicate="triplic", formative="form", hopeful="hope", goodness="good", revival="reviv", adoption="adopt", effective="effect", probate="probat", rate="rate", cease="ceas",
        controll="control", roll="roll", running="run", jumps="jump", a="a", by="by", yes="ye",
    )
    assert {w: stem(w) for w in pairs} == pairs
    df = stem_vocabulary(spark.createDataFrame([(w,) for w in pairs], "term string"))
    assert dict(map(tuple, df.collect())) == pairs
    assert df.filter("stem = 'run'").count() == 1  # a filter passes through all steps


def test_porter_of_the_whole_vocabulary(spark):
    """The rules as SQL against the rules as Python, which measures words letter by letter."""
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(analyze(F.col("text"))).alias("term")).distinct()
    odd = spark.createDataFrame([(w,) for w in ("yyy", "yed", "ying", "bed", "sses", "eed", "ion", "tion", "sion", "llll", "aeiou", "happyyy", "ate", "ational", "fulness", "é", "élan", "42nd", "s", "ss")], "term string")
    assert [r for r in stem_vocabulary(words.union(odd)).collect() if stem(r["term"]) != r["stem"]] == []


def test_functions_of_sql(spark):
    register(spark)
    assert spark.sql("SELECT porter_stem('running'), porter_stem('yes')").first() == ("run", "ye")
    texts = ["Don't STOP!", "Crème <b>x</b> \u00ad soft\u00adhyphen", "ΣΑΣ İstanbul ©\U0001f600 5+3", "", "a\r b\tc\nd\x0be", "ǅ ﬁ Å"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r["i"]: r["x"] for r in df.select("i", analyze(F.col("t")).alias("x")).collect()}
    assert {i: plain_tokens(t) for i, t in enumerate(texts)} == want
    got = spark.sql("SELECT i, array_agg(term) AS x FROM {df}, LATERAL tokenize(t, true) GROUP BY i", df=df)
    stopped = df.select("i", analyze(F.col("t"), True).alias("x")).filter("size(x) > 0")
    assert {r["i"]: sorted(r["x"]) for r in got.collect()} == {r["i"]: sorted(r["x"]) for r in stopped.collect()}


def test_index_tables(spark):
    index = Index.of(frame(spark), PLAIN)
    words = {r["term"]: (r["df"], r["max_tf"], r["cf"]) for r in index.lexicon.collect()}
    assert words["the"] == (5, 3, 8) and words["offender"] == (2, 1, 2) and words["purpose"] == (1, 1, 1) and words["rare"] == (1, 40, 40)
    n, adl = index.stats.first()
    assert n == len(DOCS) and adl == pytest.approx(sum(len(t.strip().encode()) for _, t in DOCS) / len(DOCS))


def brute(query, metric, conjunctive, docs=DOCS):
    import re

    words = lambda t: re.findall(r"[a-z]+", t.lower().replace("é", "e").replace("ï", "i"))
    bags = {i: words(t) for i, t in docs}
    size = {i: len(t.strip().encode()) for i, t in docs}
    adl = sum(size.values()) / len(size)
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    known = [w for w in words(query) if w in df]
    out = []
    for i, b in bags.items():
        if known and (all if conjunctive else any)(w in b for w in known):
            s = 0.0
            for w in known:
                if tf := b.count(w):
                    idf = math.log(len(docs) / df[w])
                    s += (1 + math.log(tf)) * idf if metric == "TFIDF" else tf / (1.3 * (0.5 + 0.5 * size[i] / adl) + tf) * idf
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("metric", ["BM25", "TFIDF"])
@pytest.mark.parametrize("conjunctive", [False, True])
def test_search_against_brute_force(spark, metric, conjunctive):
    queries = ["the dog", "dog dog offender", "rare unknownword the", "unknownword", "", "cafe naive"]
    got = found(search_collection(frame(spark), asked(spark, *queries), SearchSettings(0, metric, conjunctive), PLAIN))
    want = [(q, r, i, s) for q, text in enumerate(queries) for r, (i, s) in enumerate(brute(text, metric, conjunctive))]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)


def test_search_invariants(spark):
    docs = frame(spark)
    once = found(search_collection(docs, asked(spark, "dog offender"), SearchSettings(0), PLAIN))
    twice = found(search_collection(docs, asked(spark, "dog offender dog offender"), SearchSettings(0), PLAIN))
    assert [x[3] * 2 for x in once] == pytest.approx([x[3] for x in twice], abs=3e-6)
    assert found(search_collection(docs, asked(spark, "dog offender"), SearchSettings(2), PLAIN)) == once[:2]
    assert found(search_collection(docs.repartition(7), asked(spark, "dog offender"), SearchSettings(0), PLAIN)) == once
    assert found(search_collection(docs.limit(0), asked(spark, "dog"), SearchSettings(), PLAIN)) == []


@pytest.mark.parametrize("segments", [1, 2, 6])
def test_written_index_of_any_number_of_segments(spark, tmp_path, segments):
    at = str(tmp_path / "index")
    for k in range(segments):
        Index.of(frame(spark, DOCS[k::segments]), PLAIN).write(at, f"s{k}")
    index = Index.load(spark, at)
    want = found(search_collection(frame(spark), asked(spark, "the dog"), SearchSettings(0), PLAIN))
    assert found(search(index, asked(spark, "the dog"), SearchSettings(0))) == want
    one = search_one(index, "the dog", SearchSettings(3)).orderBy("rank").collect()
    assert [(0, *r) for r in one] == want[:3]
    merged = merge_segments(spark, at, str(tmp_path / "merged"))
    assert found(search(merged, asked(spark, "the dog"), SearchSettings(0))) == want
    with pytest.raises(ValueError):
        Index.of(frame(spark), IndexSettings(True, True)).write(at, "other")


def test_written_tables(spark, tmp_path):
    at = str(tmp_path / "index")
    index = Index.of(frame(spark), PLAIN).write(at)
    terms = [r["term"] for r in ordered(index.lexicon).orderBy("place").collect()]
    assert terms == sorted(terms) and len(terms) == index.lexicon.count()
    plan = index.postings_of(spark.createDataFrame([("dog",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]
    one = search_one(index, "dog")._jdf.queryExecution().toString()
    assert "bucket" in one.split("PartitionFilters")[1][:120] and "In(term" in one or "EqualTo(term,dog)" in one
    storage.remove(spark, f"{at}/segments/0")  # a segment without its mark isn't there yet
    Index.of(frame(spark, DOCS[:2]), PLAIN).write(at, "b")
    assert Index.load(spark, at).stats.first()["n"] == 2
    with pytest.raises(ValueError, match="share"):
        Index.of(frame(spark, [(1, "a"), (1, "b")]), PLAIN).write(str(tmp_path / "twice"))


def test_numbers_are_names(spark):
    df = spark.createDataFrame([(n, "x") for n in ("7", "007", "-7", "D7", "9223372036854775807", "9223372036854775808")], "doc_no string, content string")
    ids = [r["doc_id"] for r in readers.numbered(df).collect()]
    assert ids[0] == 7 and ids[4] == 2**63 - 1 and len(set(ids)) == 6 and all(ids[k] < 0 for k in (1, 2, 3, 5))


def test_containment(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "zone two threefold"), (3, "two  three"), (4, None)], "doc_id bigint, text string")
    queries = ["ne two three", "two", "two three", "", "one two three four", "o  three"]
    got = {(r["query_id"], r["doc_id"]) for r in evaluation.containment(docs, asked(spark, *queries)).collect()}
    assert got == {(q, r["doc_id"]) for q, t in enumerate(queries) for r in docs.collect() if r["text"] is not None and t in r["text"]}


def test_gaps_over_blocks(spark):
    rows = [("a", i, 1) for i in (3, 1023, 1024, 5000, 5001, 900_000)] + [("b", 2048, 2)]
    got = codecs.gaps(spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint")).orderBy("term", "doc_id").collect()
    assert [r["gap"] for r in got] == [3, 1020, 1, 3976, 1, 894_999, 2048]
    nth = spark.createDataFrame([("a", k, 2) for k in range(3000)], "term string, nth bigint, gap bigint")
    assert codecs.from_gaps(nth).filter("doc_id <> 2 * (nth + 1)").count() == 0


def test_codecs():
    for values in ([], [0], [3, 4, 200, 70000], [1 << 40]):
        assert codecs.decode_deltas(codecs.encode_deltas(values)) == values
    assert codecs.encode_deltas([1, 129, 300]) == bytes([1, 128, 1, 171, 1])
    for values in ([], [1, 1, 3], [9, 2, 1, 30]):
        assert codecs.decode_unary(codecs.encode_unary(values, 1), 1) == values
    assert codecs.encode_unary([1, 2, 0]) == bytes([0b10110011])


def test_sizes(spark):
    p = spark.createDataFrame([("a", 5, 1), ("a", 200, 2), ("a", 20000, 9)], "term string, doc_id bigint, tf bigint")
    assert tuple(codecs.list_sizes(p).first()) == ("a", 3, 12, 1 + 2 + 3, 2)


def test_evaluation(spark):
    run = spark.createDataFrame([(1, r, d, 1.0) for r, d in enumerate("abcd")], "query_id bigint, rank bigint, doc_id string, score double")
    qrels = spark.createDataFrame([(1, "b", 1), (1, "d", 2), (1, "z", 1), (1, "a", 0), (2, "a", 1)], "query_id bigint, doc_id string, grade int")
    one = lambda df: {r[0]: r[1] for r in df.collect()}
    assert one(evaluation.precision(run, qrels, 5)) == {1: 0.4, 2: 0.0}
    assert one(evaluation.recall(run, qrels, 1000)) == {1: round(2 / 3, 6), 2: 0.0}
    assert one(evaluation.average_precision(run, qrels, 10))[1] == round((1 / 2 + 2 / 4) / 3, 6)
    best = 2 + 1 / math.log2(3) + 1 / math.log2(4)
    assert one(evaluation.ndcg(run, qrels, 10))[1] == round((1 / math.log2(3) + 2 / math.log2(5)) / best, 6)


def test_sources(spark, tmp_path):
    good = tmp_path / "p.tsv"
    good.write_bytes(b'1\t "quoted" start\n2\t  spaced out \r\n3\tlast without line end')
    assert [tuple(r) for r in readers.passages(spark, str(good)).collect()] == [("1", '"quoted" start'), ("2", "spaced out"), ("3", "last without line end")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("none\n1\tone\n1\ttwo\tthree\n")
    assert readers.passages(spark, str(bad), strict=False).count() == 1
    with pytest.raises(Exception, match="malformed"):
        readers.passages(spark, str(bad)).collect()
    asked_at = tmp_path / "q.tsv"
    asked_at.write_text("7\tfirst\textra\nshort\n8\tsecond\n")
    assert [tuple(r) for r in readers.query_file(spark, str(asked_at)).collect()] == [(7, "first"), (8, "second")]
    assert list(readers.interactive([" a \n", "b\n"])) == [(0, "a"), (1, "b")]
    with pytest.raises(FileNotFoundError):
        readers.check_file(str(tmp_path / "nothing"))
    with pytest.raises(IsADirectoryError):
        readers.check_file(str(tmp_path))


def test_settings():
    assert parse_metric("bm25") == "BM25" and SearchSettings(metric="tfidf").metric == "TFIDF"
    with pytest.raises(ValueError):
        SearchSettings(metric="other")


def test_run_line(spark):
    df = spark.createDataFrame([(3, "D7", 0, 1.23456), (3, "D7", 0, 5.766849999)], "query_id bigint, doc_no string, rank bigint, exact double")
    assert [r[0].split("\t")[4] for r in df.select(run_line()).collect()] == ["1.2346", "5.7668"]  # not of the score of six places, 5.766850
    assert df.select(run_line()).first()[0] == "3\tQ0\tD7\t0\t1.2346\tRANDOMID"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.tsv").write_text("".join(f"{i}\t{t}\n" for i, t in DOCS[k::3]))
    index_stream(readers.passage_stream(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "c1"), PLAIN).awaitTermination()
    index = Index.load(spark, str(tmp_path / "index"))
    assert index.stats.first()["n"] == len(DOCS)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('{"query_id": 4, "text": "dog"}')
    search_stream(spark.readStream.schema("query_id bigint, text string").json(str(tmp_path / "q")), index, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert {r["doc_no"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"0", "1"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "p.tsv").write_text("".join(f"{i}\t{t}\n" for i, t in DOCS))
    at = str(tmp_path / "index")
    cli.main(["index", str(tmp_path / "p.tsv"), "-o", at, "--no-stopwords", "-w", "2"], spark)
    assert "postings\t" in capsys.readouterr().out
    cli.main(["search", "-x", at, "-q", "dogs", "-k", "5", "-m", "tfidf"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[2] for x in lines[:-1]] == ["0", "1"] and lines[-1].startswith("#\t0\t")
    (tmp_path / "q.tsv").write_text("5\tdog\n")
    cli.main(["search", "-x", at, "-f", str(tmp_path / "q.tsv"), "-o", str(tmp_path / "run")], spark)
    assert capsys.readouterr().out.startswith("#\tall\t")
    cli.main(["search", "-x", at, "-f", str(tmp_path / "q.tsv"), "--each"], spark)
    assert capsys.readouterr().out.splitlines()[-1].startswith("#\t5\t")
    (tmp_path / "qrels").write_text("5 0 0 1\n")
    cli.main(["eval", str(tmp_path / "run"), str(tmp_path / "qrels")], spark)
    assert "p_5\tall\t0.2000" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["search", "-x", at, "-q", "a", "-i"], spark)
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"1\tfrom standard input\n")))
    cli.main(["index", "-o", at, "--chunk", "10", "--max-memory", "5"], spark)
    assert Index.load(spark, at).stats.first()["n"] == 1
