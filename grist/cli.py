"""The command line: index, search, eval."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import storage
from .operators import evaluation
from .operators.index import Index, table_sizes
from .operators.scoring import SCORERS, parse_metric
from .operators.search import answer, search, took_line, write_run
from .settings import IndexSettings, SearchSettings
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grist", description="Builds and searches an inverted index.")
    p.add_argument("-p", "--profile", metavar="DIR", help="write Spark's event log to this folder")
    sub = p.add_subparsers(dest="command", required=True)

    i = sub.add_parser("index", help="index a file or folder of passages, or standard input")
    i.add_argument("path", nargs="?", help="lines of number, tab, text; standard input if it is left out")
    i.add_argument("-o", "--out", default="data/index", help="folder of the index; what it holds is replaced")
    i.add_argument("-w", "--workers", type=int, default=16, help="partitions that a small input is spread over")
    i.add_argument("--chunk", type=int, help="taken for the sake of scripts; Spark cuts its input by itself")
    i.add_argument("--max-memory", type=int, help="taken for the sake of scripts; Spark spills by itself")
    i.add_argument("--lenient", action="store_true", help="leave out malformed lines instead of failing")
    i.add_argument("--no-compression", action="store_true", help="write the tables without compression")
    i.add_argument("--no-stopwords", action="store_true", help="keep stop words")
    i.add_argument("--no-stemming", action="store_true", help="keep words as they are")

    s = sub.add_parser("search", help="rank documents for queries")
    s.add_argument("-x", "--index", default="data/index", help="folder of the index")
    how = s.add_mutually_exclusive_group(required=True)
    how.add_argument("-i", "--interactive", action="store_true", help="read queries from standard input")
    how.add_argument("-f", "--file", help="lines of query number, tab, text")
    how.add_argument("-q", "--query", help="one query")
    s.add_argument("--each", action="store_true", help="with -f: one query after the other, each with a line of how long it took, as -i does")
    s.add_argument("-o", "--out", help="folder for the run (with -f); standard output if it is left out")
    s.add_argument("-k", "--doc2ret", type=int, default=10, help="results for each query, 0 for all")
    s.add_argument("-c", "--conjunctive", action="store_true", help="only documents with all known words of the query")
    s.add_argument("-m", "--metric", type=parse_metric, default="BM25", help="|".join(sorted(SCORERS)))

    e = sub.add_parser("eval", help="measure a run against judgments")
    e.add_argument("run")
    e.add_argument("qrels")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if spark is None:
        builder = SparkSession.builder.appName("grist")
        if a.profile:
            builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.profile)
        spark = builder.getOrCreate()
    if a.command == "index":
        path = readers.check_path(a.path) if a.path else readers.spool(spark, sys.stdin.buffer)
        settings = IndexSettings(not a.no_stopwords, not a.no_stemming, not a.no_compression)
        passages = readers.passages(spark, path, not a.lenient)
        if passages.rdd.getNumPartitions() < a.workers:
            passages = passages.repartition(a.workers)
        Index.of(readers.numbered(passages), settings).write(a.out)
        if not a.path:
            storage.remove(spark, path)
        for table, size in table_sizes(spark, a.out).items():
            print(f"{table}\t{size}")
    elif a.command == "search":
        index = Index.load(spark, a.index)
        settings = SearchSettings(a.doc2ret, a.metric, a.conjunctive)
        asked = readers.query_file(spark, readers.check_file(a.file)) if a.file else None
        if asked is not None and not a.each:
            start = time.perf_counter()
            found = search(index, asked, settings, exact=True)
            if a.out:
                write_run(found, index.docs, a.out)
                print(took_line("all", time.perf_counter() - start))
                return
            from .operators.search import run_line, with_numbers

            for row in with_numbers(found, index.docs).orderBy("query_id", "rank").select(run_line()).toLocalIterator():
                print(row[0])
            print(took_line("all", time.perf_counter() - start))
            return
        if asked is not None:
            one_by_one = ((r["query_id"], r["text"]) for r in asked.toLocalIterator())
        else:
            one_by_one = readers.interactive(sys.stdin, sys.stderr) if a.interactive else [(0, a.query)]
        for lines, took in answer(index.cache(), one_by_one, settings):
            print(*lines, took, sep="\n", flush=True)
    else:
        run, qrels = readers.run_file(spark, a.run), readers.qrels_file(spark, a.qrels)
        row = evaluation.evaluate(run, qrels).first()
        for name, value in row.asDict().items():
            print(f"{name}\tall\t{value:.4f}" if value is not None else f"{name}\tall\t")
