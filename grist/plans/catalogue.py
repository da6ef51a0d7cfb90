"""Every query of the retrieval engine over the standard tables, with the SQL that gives the same rows.

documents is the collection, its source plays the index partition; the texts of benchmark are the queries, and a
document that contains a query's text is relevant for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.analysis import analyze, byte_length, clean, lower
from ..functions.porter import duckdb_stems
from ..functions.sql import register
from ..functions.stopwords import STOPWORDS
from ..operators import codecs, evaluation, index, search
from ..operators.scoring import B, K1
from ..settings import IndexSettings, SearchSettings
from ..sources import readers
from ..sources.readers import collection
from ..streaming import incremental

PLAIN = IndexSettings(stopwords_removal=False, stemming=False)
STOPPED = IndexSettings(stopwords_removal=True, stemming=False)
STEMMED = IndexSettings(stopwords_removal=False, stemming=True)
FULL = IndexSettings(stopwords_removal=True, stemming=True)
LITERAL = "released under the license of the first and the other"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- the same in SQL ---------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g'), '<[^>]*>', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{So}}\s]+', ' ', 'g')"
_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOPWORDS)) + ")"


def _clean(column: str) -> str:
    return _CLEAN.format(column)


def _tokens(table: str, key: str, column: str = "text", stop: bool = False) -> str:
    more = f" AND term NOT IN {_STOP}" if stop else ""
    return f"SELECT {key}, term FROM (SELECT {key}, unnest(regexp_split_to_array({_clean(column)}, '[ \\t\\n]+')) AS term FROM {table}) WHERE term <> ''{more}"


def _index(settings: IndexSettings = PLAIN, table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTEs d (documents), tok, post, lex, st."""
    tok = _tokens(table, f"{key} AS doc_id", column, settings.stopwords_removal).replace(f"SELECT {key} AS doc_id, term FROM (", "SELECT doc_id, term FROM (")
    stem = f", tok AS MATERIALIZED (SELECT doc_id, stem AS term FROM raw JOIN ({duckdb_stems('(SELECT DISTINCT term FROM raw)')}) s USING (term))" if settings.stemming else ", tok AS (SELECT * FROM raw)"
    return f"""d AS (SELECT {key} AS doc_id, CAST(strlen(trim({column}, chr(32) || chr(9) || chr(10) || chr(13))) AS BIGINT) AS size FROM {table}),
        raw AS MATERIALIZED ({tok}){stem},
        post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id),
        lex AS (SELECT term, count(*) AS df, max(tf) AS max_tf, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term),
        st AS (SELECT count(*) AS n, avg(size) AS adl FROM d)"""


def _asked(settings: IndexSettings = PLAIN, source: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    """CTEs q (queries) and qt (query_id, term), repeated tokens as often as they are there."""
    tok = _tokens("q", "query_id", "text", settings.stopwords_removal)
    if not settings.stemming:
        return f"q AS ({source}), qt AS ({tok})"
    return f"q AS ({source}), qraw AS MATERIALIZED ({tok}), qt AS MATERIALIZED (SELECT query_id, stem AS term FROM qraw JOIN ({duckdb_stems('(SELECT DISTINCT term FROM qraw)')}) s USING (term))"


_BM25 = f"tf / ({K1} * ({1 - B} + {B} * size / adl) + tf) * ln(n / df)"
_TFIDF = "(1 + ln(tf)) * ln(n / df)"


def _search(score: str, k: int = 10, conjunctive: bool = False, settings: IndexSettings = PLAIN, asked: str | None = None, **tables: str) -> str:
    """CTEs up to res (query_id, rank, doc_id, score)."""
    having = "HAVING count(DISTINCT term) = max(needed)" if conjunctive else ""
    cut = f"WHERE place <= {k}" if k else ""
    asked_sql = _asked(settings, asked) if asked else _asked(settings)
    return f"""WITH {_index(settings, **tables)}, {asked_sql},
        known AS (SELECT query_id, term, df FROM qt JOIN lex USING (term)),
        need AS (SELECT query_id, count(DISTINCT term) AS needed FROM known GROUP BY query_id),
        hit AS (SELECT query_id, doc_id, round(sum({score}), 6) AS score, sum({score}) AS exact FROM known JOIN need USING (query_id) JOIN post USING (term) JOIN d USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id {having}),
        res AS (SELECT query_id, place - 1 AS rank, doc_id, score, exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM hit) {cut})"""


_RES = " SELECT query_id, rank, doc_id, score FROM res"


# --- inputs ------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(_table(spark, sf_dir, "documents"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _found(spark: SparkSession, sf_dir: str, metric: str = "BM25", k: int = 10, conjunctive: bool = False, settings: IndexSettings = PLAIN, exact: bool = False) -> DataFrame:
    return search.search_collection(_docs(spark, sf_dir), _queries(spark, sf_dir), SearchSettings(k, metric, conjunctive), settings, exact)


# --- analysis ----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", clean(lower(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({_clean('text')}, '[ \\t\\n]+'), lambda t: t <> ''), ' ') AS tokens FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(analyze(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM ({_tokens('documents', 'doc_id')}) GROUP BY doc_id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select("doc_id", analyze(F.col("text")).alias("t"))
    counted = tokens.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("terms"))
    return counted.filter("tokens > 0")


@query(f"SELECT doc_id, count(*) AS tokens FROM ({_tokens('documents', 'doc_id', stop=True)}) GROUP BY doc_id")
def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select("doc_id", F.size(analyze(F.col("text"), True)).cast("bigint").alias("tokens"))
    return tokens.filter("tokens > 0")


@query(f"SELECT lang, count(*) AS tokens, round(avg(CASE WHEN term IN {_STOP} THEN 1.0 ELSE 0.0 END), 6) AS stop_share FROM ({_tokens('documents', 'lang')}) GROUP BY lang")
def stopword_share_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _table(spark, sf_dir, "documents").select("lang", F.size(analyze(F.col("text"))).alias("a"), F.size(analyze(F.col("text"), True)).alias("b"))
    return both.groupBy("lang").agg(F.sum("a").alias("tokens"), F.round(F.sum(F.col("a") - F.col("b")) / F.sum("a"), 6).alias("stop_share"))


@query(f"WITH v AS (SELECT DISTINCT term FROM ({_tokens('documents', 'doc_id')})) {duckdb_stems('v')}")
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.porter import stem_vocabulary

    return stem_vocabulary(_table(spark, sf_dir, "documents").select(F.explode(analyze(F.col("text"))).alias("term")).distinct())


@query("SELECT doc_id, CAST(strlen(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS BIGINT) AS size FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", byte_length(F.col("text")).alias("size"))


# --- index -------------------------------------------------------------------------------------------------------


@query(f"WITH {_index()} SELECT doc_id, term, tf FROM post")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_postings(_docs(spark, sf_dir), PLAIN).select("doc_id", "term", "tf")


@query(f"WITH {_index(FULL)} SELECT doc_id, term, tf FROM post")
def term_frequencies_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_postings(_docs(spark, sf_dir), FULL).select("doc_id", "term", "tf")


@query(f"WITH {_index()} SELECT term, df, max_tf, cf FROM lex")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_lexicon(index.build_postings(_docs(spark, sf_dir), PLAIN))


@query(f"WITH {_index()} SELECT term, df, max_tf, cf FROM lex")
def lexicon_partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("content"))
    counts = index.term_counts(docs, ["source", "doc_id"], "content", PLAIN)
    parts = counts.groupBy("source", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.sum("tf").alias("cf"))
    return index.merge_lexicons(parts)


@query(f"WITH {_index()} SELECT n, round(adl, 6) AS adl FROM st")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_stats(index.documents(_docs(spark, sf_dir))).withColumn("adl", F.round("adl", 6))


@query(f"WITH {_index()} SELECT n, round(adl, 6) AS adl FROM st")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "documents").select("source", byte_length(F.col("text")).alias("size"))
    parts = sized.groupBy("source").agg(F.count("*").alias("n"), F.avg("size").alias("adl"))
    return index.merge_stats(parts).withColumn("adl", F.round("adl", 6))


@query(f"WITH {_index()} SELECT term, doc_id >> {index.BLOCK_BITS} AS block, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM post GROUP BY ALL")
def postings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.postings_lists(index.build_postings(_docs(spark, sf_dir), PLAIN))
    joined = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ")
    return lists.select("term", "block", joined.alias("postings"))


@query(f"WITH {_index()} SELECT term, doc_id, tf FROM post")
def postings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.expand_postings(index.postings_lists(index.build_postings(_docs(spark, sf_dir), PLAIN)))


# --- search ------------------------------------------------------------------------------------------------------


@query(f"WITH {_index()}, {_asked()} SELECT query_id, term, count(*) AS qtf, max(df) AS df FROM qt JOIN lex USING (term) GROUP BY query_id, term")
def query_lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = index.build_lexicon(index.build_postings(_docs(spark, sf_dir), PLAIN))
    return search.lookup(search.query_terms(_queries(spark, sf_dir), PLAIN), words)


@query(f"WITH {_index(table='conversations', key='conv_id')}, {_asked()} SELECT query_id, term, count(*) AS qtf FROM qt WHERE term NOT IN (SELECT term FROM lex) GROUP BY query_id, term")
def unknown_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "conversations").select(F.explode(analyze(F.col("text"))).alias("term")).distinct()
    return search.query_terms(_queries(spark, sf_dir), PLAIN).join(words, "term", "left_anti").select("query_id", "term", "qtf")


@query(_search(_BM25) + _RES)
def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(_search(_TFIDF) + _RES)
def tfidf_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "TFIDF")


@query(_search(_BM25, conjunctive=True) + _RES)
def bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, conjunctive=True)


@query(_search(_TFIDF, conjunctive=True) + _RES)
def tfidf_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "TFIDF", conjunctive=True)


@query(_search(_BM25, settings=STOPPED) + _RES)
def bm25_stop_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, settings=STOPPED)


@query(_search(_BM25, settings=STEMMED) + _RES)
def bm25_stem_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, settings=STEMMED)


@query(_search(_BM25, settings=FULL) + _RES)
def bm25_full_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, settings=FULL)


@query(_search(_TFIDF, settings=FULL) + _RES)
def tfidf_full_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "TFIDF", settings=FULL)


@query(_search(_BM25, asked="SELECT item_id AS query_id, text || ' ' || text AS text FROM benchmark") + _RES)
def repeated_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _queries(spark, sf_dir).select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    return search.search_collection(_docs(spark, sf_dir), twice, SearchSettings(), PLAIN)


@query(_search(_BM25, k=0, conjunctive=True) + _RES)
def unbounded_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, k=0, conjunctive=True)


@query(
    "WITH e AS (SELECT doc_id, text || ' everywhere' AS text FROM documents), "
    + _search(_BM25, k=0, table="e", asked="SELECT CAST(1 AS BIGINT) AS query_id, 'everywhere' AS text").removeprefix("WITH ")
    + _RES
)
def zero_idf_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term of every document: all of them are found, with a score of 0."""
    docs = _docs(spark, sf_dir).withColumn("content", F.concat("content", F.lit(" everywhere")))
    one = spark.createDataFrame([(1, "everywhere")], "query_id bigint, text string")
    return search.search_collection(docs, one, SearchSettings(k=0), PLAIN)


@query(_search(_BM25, asked=f"SELECT 0 AS query_id, '{LITERAL}' AS text") + " SELECT rank, doc_id, score FROM res")
def single_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_one(index.Index.of(_docs(spark, sf_dir), PLAIN), LITERAL, SearchSettings())


@query(_search(_BM25) + " SELECT printf('%d\tQ0\t%s\t%d\t%.4f\tRANDOMID', query_id, CAST(doc_id AS VARCHAR), rank, exact) AS line FROM res")
def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, exact=True).withColumn("doc_no", F.col("doc_id").cast("string"))
    return found.select(search.run_line().alias("line"))


@query(_search(_BM25, table="pages", key="page_id", column="html") + _RES)
def search_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = collection(_table(spark, sf_dir, "pages"), "page_id", "html")
    return search.search_collection(pages, _queries(spark, sf_dir), SearchSettings(), PLAIN)


@query("WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), " + _search(_BM25, table="c").removeprefix("WITH ") + _RES)
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return search.search_collection(collection(turns), _queries(spark, sf_dir), SearchSettings(), PLAIN)


# --- sizes -------------------------------------------------------------------------------------------------------

_GAPS = "gap AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post)"
_VARINT = "CASE " + " ".join(f"WHEN gap < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


@query(f"WITH {_index()}, {_GAPS} SELECT term, doc_id, tf, gap FROM gap")
def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.gaps(index.build_postings(_docs(spark, sf_dir), PLAIN))


@query(f"WITH {_index()}, {_GAPS} SELECT term, CAST(sum({_VARINT}) AS BIGINT) AS varint_bytes FROM gap GROUP BY term")
def varint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.list_sizes(index.build_postings(_docs(spark, sf_dir), PLAIN)).select("term", "varint_bytes")


@query(f"WITH {_index()} SELECT term, CAST(ceil(sum(tf) / 8) AS BIGINT) AS unary_bytes FROM post GROUP BY term")
def unary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.list_sizes(index.build_postings(_docs(spark, sf_dir), PLAIN)).select("term", "unary_bytes")


@query(f"""WITH {_index()}, {_GAPS}, l AS (SELECT term, count(*) AS df, sum({_VARINT}) AS v, ceil(sum(tf) / 8) AS u FROM gap GROUP BY term)
    SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(df * 4) AS BIGINT) AS raw_bytes, CAST(sum(v) AS BIGINT) AS varint_bytes, CAST(sum(u) AS BIGINT) AS unary_bytes FROM l""")
def index_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = codecs.list_sizes(index.build_postings(_docs(spark, sf_dir), PLAIN))
    total = {"postings": "df", "raw_bytes": "raw_bytes", "varint_bytes": "varint_bytes", "unary_bytes": "unary_bytes"}
    return sizes.agg(F.count("*").alias("terms"), *[F.sum(c).alias(a) for a, c in total.items()])


# --- evaluation --------------------------------------------------------------------------------------------------

_JUDGED = """, rel AS (SELECT b.item_id AS query_id, doc_id FROM benchmark b JOIN documents ON contains(documents.text, b.text)),
    tot AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id),
    g AS (SELECT t.query_id, t.total, res.rank, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS grade FROM tot t LEFT JOIN res ON res.query_id = t.query_id LEFT JOIN rel ON rel.query_id = res.query_id AND rel.doc_id = res.doc_id)"""


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.containment(_table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir))


@query(_search(_BM25) + _JUDGED + " SELECT query_id, round(sum(CASE WHEN rank < 10 THEN grade ELSE 0 END) / 10, 6) AS precision FROM g GROUP BY query_id")
def eval_p_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision(_found(spark, sf_dir), _judgments(spark, sf_dir), 10)


@query(_search(_BM25, k=1000) + _JUDGED + " SELECT query_id, round(sum(CASE WHEN rank < 1000 THEN grade ELSE 0 END) / max(total), 6) AS recall FROM g GROUP BY query_id")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall(_found(spark, sf_dir, k=1000), _judgments(spark, sf_dir), 1000)


@query(
    _search(_BM25)
    + _JUDGED
    + ", ideal AS (SELECT query_id, sum(1 / log2(place + 1)) AS best FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS place FROM rel) WHERE place <= 10 GROUP BY query_id)"
    + " SELECT query_id, round(sum(CASE WHEN rank < 10 THEN grade / log2(rank + 2) ELSE 0 END) / max(best), 6) AS ndcg FROM g JOIN ideal USING (query_id) GROUP BY query_id"
)
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ndcg(_found(spark, sf_dir), _judgments(spark, sf_dir), 10)


@query(
    _search(_BM25)
    + _JUDGED
    + ", h AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM g)"
    + " SELECT query_id, round(sum(CASE WHEN rank < 10 AND grade = 1 THEN hits / (rank + 1) ELSE 0 END) / max(total), 6) AS average_precision FROM h GROUP BY query_id"
)
def eval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(_found(spark, sf_dir), _judgments(spark, sf_dir), 10)


@query(
    _search(_BM25, k=1000)
    + _JUDGED
    + """, ideal AS (SELECT query_id, sum(1 / log2(place + 1)) AS best FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS place FROM rel) WHERE place <= 10 GROUP BY query_id),
    h AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM g),
    m AS (SELECT query_id, round(sum(CASE WHEN rank < 5 THEN grade ELSE 0 END) / 5, 6) AS p5, round(sum(CASE WHEN rank < 10 THEN grade ELSE 0 END) / 10, 6) AS p10,
        round(sum(CASE WHEN rank < 1000 THEN grade ELSE 0 END) / max(total), 6) AS r, round(sum(CASE WHEN rank < 10 THEN grade / log2(rank + 2) ELSE 0 END) / max(best), 6) AS nd,
        round(sum(CASE WHEN rank < 10 AND grade = 1 THEN hits / (rank + 1) ELSE 0 END) / max(total), 6) AS ap FROM h JOIN ideal USING (query_id) GROUP BY query_id)
    SELECT round(avg(p5), 6) AS p_5, round(avg(p10), 6) AS p_10, round(avg(r), 6) AS recall_1000, round(avg(nd), 6) AS ndcg_cut_10, round(avg(ap), 6) AS map_cut_10 FROM m"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(_found(spark, sf_dir, k=1000), _judgments(spark, sf_dir))


@query(
    _search(_BM25)
    + _JUDGED.replace("SELECT b.item_id AS query_id, doc_id FROM", "SELECT b.item_id AS query_id, doc_id, 1 + length(documents.text) % 3 AS given FROM").replace("THEN 0 ELSE 1 END AS grade", "THEN 0 ELSE given END AS grade")
    + ", ideal AS (SELECT query_id, sum(given / log2(place + 1)) AS best FROM (SELECT query_id, given, row_number() OVER (PARTITION BY query_id ORDER BY given DESC) AS place FROM rel) WHERE place <= 10 GROUP BY query_id)"
    + " SELECT query_id, round(sum(CASE WHEN rank < 10 THEN grade / log2(rank + 2) ELSE 0 END) / max(best), 6) AS ndcg FROM g JOIN ideal USING (query_id) GROUP BY query_id"
)
def eval_graded_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of 1 to 3, by the length of the document."""
    graded = _judgments(spark, sf_dir).drop("grade").join(_table(spark, sf_dir, "documents").select("doc_id", (1 + F.length("text") % 3).alias("grade")), "doc_id")
    return evaluation.ndcg(_found(spark, sf_dir), graded, 10)


# --- the stored index, files and streams --------------------------------------------------------------------------

_BUILT: dict[tuple, object] = {}


def _once(spark: SparkSession, make: Callable[[str], object], *key: object):
    """What make(folder) gives, made once a session and kept in the shared folder until the driver ends."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _BUILT:
        _BUILT[key] = make(storage.new_folder(spark))
    return _BUILT[key]


def _stored(spark: SparkSession, sf_dir: str, settings: IndexSettings = PLAIN, segments: int = 1) -> index.Index:
    """The documents, written as an index of so many segments and loaded from there."""

    def make(at: str) -> str:
        docs = _docs(spark, sf_dir)
        for k in range(segments):
            part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(segments)) == k) if segments > 1 else docs
            index.Index.of(part, settings).write(f"{at}/index", f"s{k}")
        return f"{at}/index"

    return index.Index.load(spark, _once(spark, make, "index", sf_dir, settings, segments))


_LINE = r"trim(regexp_replace({0}, '[\t\n\r ]+', ' ', 'g'))"
_FILED = "f AS (SELECT doc_id, " + _LINE.format("text") + " AS text FROM documents), "


def _line(text: str) -> Column:
    return F.trim(F.regexp_replace(text, r"[\t\n\r ]+", " "))


def _passage_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files of passages, a line each."""

    def make(at: str) -> str:
        lines = _table(spark, sf_dir, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), _line("text")).alias("value"))
        (lines if lines.rdd.getNumPartitions() >= 3 else lines.repartition(3)).write.text(f"{at}/passages")
        return f"{at}/passages"

    return _once(spark, make, "passages", sf_dir)


def _query_files(spark: SparkSession, sf_dir: str) -> str:
    def make(at: str) -> str:
        lines = _queries(spark, sf_dir).select(F.concat_ws("\t", F.col("query_id").cast("string"), _line("text"), F.lit("further field")).alias("value"))
        lines.coalesce(1).write.text(f"{at}/queries")
        return f"{at}/queries"

    return _once(spark, make, "queries", sf_dir)


@query(_search(_BM25) + _RES)
def stored_bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir), _queries(spark, sf_dir))


@query(_search(_TFIDF, k=1000) + _RES)
def stored_tfidf_or_top1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir), _queries(spark, sf_dir), SearchSettings(1000, "TFIDF"))


@query(_search(_BM25, conjunctive=True) + _RES)
def stored_bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir), _queries(spark, sf_dir), SearchSettings(conjunctive=True))


@query(_search(_BM25, settings=FULL) + _RES)
def stored_full_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir, FULL), _queries(spark, sf_dir))


@query(_search(_BM25, asked=f"SELECT 0 AS query_id, '{LITERAL}' AS text") + " SELECT rank, doc_id, score FROM res")
def stored_single_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_one(_stored(spark, sf_dir), LITERAL)


@query(_search(_BM25, settings=FULL, asked=f"SELECT 0 AS query_id, '{LITERAL}' AS text") + " SELECT rank, doc_id, score FROM res")
def stored_single_query_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_one(_stored(spark, sf_dir, FULL), LITERAL)


@query(_search(_BM25) + _RES)
def stored_uncompressed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir, IndexSettings(stopwords_removal=False, stemming=False, compression=False, buckets=5)), _queries(spark, sf_dir))


@query(_search(_BM25) + _RES)
def segmented_search_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir, segments=2), _queries(spark, sf_dir))


@query(_search(_TFIDF, conjunctive=True, k=0) + _RES)
def segmented_search_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir, segments=5), _queries(spark, sf_dir), SearchSettings(0, "TFIDF", True))


@query(f"WITH {_index()} SELECT term, df, max_tf, cf FROM lex")
def segmented_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, segments=5).lexicon


@query(f"WITH {_index()} SELECT n, round(adl, 6) AS adl FROM st")
def segmented_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, segments=5).stats.withColumn("adl", F.round("adl", 6))


@query(f"WITH {_index()} SELECT post.term, doc_id, tf, size FROM post JOIN d USING (doc_id)")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two segments, merged to one index."""

    def make(at: str) -> str:
        _stored(spark, sf_dir, segments=2)
        incremental.merge_segments(spark, _BUILT[spark.sparkContext.applicationId, "index", sf_dir, PLAIN, 2], f"{at}/merged")
        return f"{at}/merged"

    return index.Index.load(spark, _once(spark, make, "merged", sf_dir)).postings.select("term", "doc_id", "tf", "size")


@query(f"WITH {_index()} SELECT doc_id, CAST(doc_id AS VARCHAR) AS doc_no, size FROM d")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, segments=2).docs.select("doc_id", "doc_no", "size")


@query(_search(_BM25) + " SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS doc_no FROM res")
def run_with_doc_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _stored(spark, sf_dir)
    return search.with_numbers(search.search(built, _queries(spark, sf_dir)), built.docs).select("query_id", "rank", "doc_no")


@query(f"WITH {_index()} SELECT row_number() OVER (ORDER BY term) - 1 AS place, term, df, max_tf, cf FROM lex")
def ordered_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.ordered(_stored(spark, sf_dir).lexicon)


@query("WITH " + _FILED + _search(_BM25, table="f").removeprefix("WITH ") + _RES)
def passage_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and queries from files."""
    docs = readers.numbered(readers.passages(spark, _passage_files(spark, sf_dir)))
    return search.search_collection(docs, readers.query_file(spark, _query_files(spark, sf_dir)), SearchSettings(), PLAIN)


@query("WITH " + _FILED + f"{_index(table='f')} SELECT CAST(doc_id AS VARCHAR) AS doc_no, size, CAST((SELECT coalesce(sum(tf), 0) FROM post WHERE post.doc_id = d.doc_id) AS BIGINT) AS tokens FROM d")
def passage_file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.numbered(readers.passages(spark, _passage_files(spark, sf_dir), strict=False))
    return docs.select("doc_no", byte_length(F.col("content")).alias("size"), F.size(analyze(F.col("content"))).cast("bigint").alias("tokens"))


@query("SELECT item_id AS query_id, " + _LINE.format("text") + " AS text FROM benchmark")
def query_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.query_file(spark, _query_files(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    def make(at: str) -> str:
        files = [f for f in storage.names(spark, _passage_files(spark, sf_dir)) if f.startswith("part-")]
        stream = readers.passage_stream(spark, _passage_files(spark, sf_dir), -(-len(files) // 3))
        incremental.index_stream(stream, f"{at}/index", f"{at}/checkpoint", PLAIN).awaitTermination()
        return f"{at}/index"

    return _once(spark, make, "streamed", sf_dir)


@query("WITH " + _FILED + _search(_BM25, table="f").removeprefix("WITH ") + _RES)
def streamed_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that grew by a segment a micro-batch."""
    return search.search(index.Index.load(spark, _streamed(spark, sf_dir)), _queries(spark, sf_dir))


@query("WITH " + _FILED + _search(_BM25, table="f").removeprefix("WITH ") + " SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS doc_no, score FROM res")
def streamed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that come as a stream."""

    def make(at: str) -> str:
        asked = spark.readStream.schema("value string").text(_query_files(spark, sf_dir)).select(F.split("value", "\t").alias("p")).selectExpr("cast(p[0] AS bigint) AS query_id", "p[1] AS text")
        incremental.search_stream(asked, index.Index.load(spark, _streamed(spark, sf_dir)), f"{at}/out", f"{at}/checkpoint").awaitTermination()
        return f"{at}/out"

    return spark.read.parquet(_once(spark, make, "answers", sf_dir)).select("query_id", "rank", "doc_no", "score")


@query(f"WITH {_index()} SELECT term, doc_id FROM post")
def gaps_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = (F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1).cast("bigint").alias("nth")
    listed = codecs.gaps(index.build_postings(_docs(spark, sf_dir), PLAIN)).select("term", nth, "gap")
    return codecs.from_gaps(listed).select("term", "doc_id")


@query(f"WITH {_index()} SELECT term, doc_id, tf FROM post")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as varint gaps and unary frequencies, and read again."""
    return codecs.decompress(codecs.compress(index.postings_lists(index.build_postings(_docs(spark, sf_dir), PLAIN))))


@query(_search(_BM25, k=0) + _RES)
def bm25_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, k=0)


@query("SELECT round(avg(length(text) * 37 / 1000), 3) AS mean_ms, round(stddev_pop(length(text) * 37 / 1000), 3) AS stddev_ms FROM benchmark")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of a session, as if a query took 37 microseconds for each of its characters."""
    took = F.length("text") * 37
    lines = _queries(spark, sf_dir).select(F.explode(F.array(F.format_string("%d\tQ0\tD1\t0\t1.0000\tRANDOMID", "query_id"), F.format_string("#\t%d\t%sms\t%d", F.col("query_id"), took / 1000, took))).alias("value"))
    return evaluation.latency(lines)


@query(ORACLE_SQL["eval_summary"])
def eval_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run and judgments, written as files and measured from there."""

    def make(at: str) -> str:
        built = _stored(spark, sf_dir)
        search.write_run(search.search(built, _queries(spark, sf_dir), SearchSettings(1000), exact=True), built.docs, f"{at}/run")
        _judgments(spark, sf_dir).select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", "grade").alias("value")).coalesce(1).write.text(f"{at}/qrels")
        return at

    at = _once(spark, make, "run", sf_dir)
    return evaluation.evaluate(readers.run_file(spark, f"{at}/run"), readers.qrels_file(spark, f"{at}/qrels"))


@query(ORACLE_SQL["stemmed_vocabulary"])
def porter_stem_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    words = _table(spark, sf_dir, "documents").select(F.explode(analyze(F.col("text"))).alias("term")).distinct()
    return words.selectExpr("term", "porter_stem(term) AS stem")


@query(ORACLE_SQL["token_counts"])
def tokenize_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM {docs}, LATERAL tokenize(text, false) GROUP BY doc_id", docs=_table(spark, sf_dir, "documents"))
