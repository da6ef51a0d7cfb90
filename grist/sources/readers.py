"""Collections and query files as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.analysis import trim_space


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split("value", "\t").alias("p"))


def passages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(doc_no, content) of a passage file, a line "number TAB text" each; quotes are text, and the last line needs no line end.

    strict: a line that hasn't exactly two fields fails the job; otherwise it is left out.
    """
    df = _parts(spark, path)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80)))
        df = df.select(F.when(F.size("p") == 2, F.col("p")).otherwise(wrong.cast("array<string>")).alias("p"))
    else:
        df = df.filter(F.size("p") == 2)
    return df.select(F.col("p")[0].alias("doc_no"), trim_space(F.col("p")[1]).alias("content"))


def passage_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """passages() as a stream over the files of a folder; malformed lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 2)
    return lines.select(F.col("p")[0].alias("doc_no"), trim_space(F.col("p")[1]).alias("content"))


def collection(df: DataFrame, doc_id: str = "doc_id", content: str = "text", doc_no: str | None = None) -> DataFrame:
    """(doc_id, doc_no, content) of any table; doc_no is the identifier as text unless there is a column for it."""
    number = F.col(doc_no or doc_id).cast("string").alias("doc_no")
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), number, F.col(content).cast("string").alias("content"))


def numbered(df: DataFrame) -> DataFrame:
    """passages() with doc_id: the number itself where doc_no is one as it is usually written, else a hash of doc_no, which is negative.

    So "7" and "007" are two documents. That all identifiers differ is checked when the index is written.
    """
    number = F.expr("try_cast(doc_no AS bigint)")
    own = (number >= 0) & (number.cast("string") == F.col("doc_no"))
    hashed = F.xxhash64("doc_no").bitwiseOR(F.lit(-(2**63)))
    return df.select(F.when(own, number).otherwise(hashed).alias("doc_id"), "doc_no", "content")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a query file, "id TAB text" a line; lines with fewer fields are left out, further fields are ignored, an id that isn't a number fails the job."""
    good = _parts(spark, path).filter(F.size("p") >= 2)
    ident = F.expr("try_cast(p[0] AS bigint)")
    ident = F.when(ident.between(0, 2**32 - 1), ident).otherwise(F.raise_error(F.concat(F.lit("not a query id: "), F.col("p")[0])).cast("bigint"))
    return good.select(ident.alias("query_id"), F.col("p")[1].alias("text"))


def literal_query(spark: SparkSession, text: str, query_id: int = 0) -> DataFrame:
    """One query."""
    return spark.createDataFrame([(query_id, text)], "query_id bigint, text string")


def interactive(lines: Iterable[str], prompt: IO[str] | None = None) -> Iterator[tuple[int, str]]:
    """(query_id, text) of the lines of a terminal, ids counting up from 0; the prompt is written before each."""
    source = iter(lines)
    i = 0
    while True:
        if prompt is not None:
            prompt.write("> ")
            prompt.flush()
        line = next(source, None)
        if line is None:
            return
        yield i, line.strip()
        i += 1


def spool(spark: SparkSession, stream: IO[bytes]) -> str:
    """Standard input as a file in the shared folder, for readers that need one; the caller removes it."""
    return storage.put(spark, f"{storage.new_folder(spark)}/stdin.tsv", iter(lambda: stream.read(1 << 20), b""))


def check_file(path: str) -> str:
    """path, if it can be a local file to read; paths with a scheme are left to Spark."""
    if not re.match(r"[a-z][a-z0-9+.-]*://", path):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if os.path.isdir(path):
            raise IsADirectoryError(f"provided path {path} is a folder")
    return path


def check_path(path: str) -> str:
    """path, if something is there to read, a file or a folder; paths with a scheme are left to Spark."""
    if not re.match(r"[a-z][a-z0-9+.-]*://", path) and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank, score) of a run file; doc_id is its document's number as text."""
    p = F.split(F.trim("value"), r"\s+")
    fields = spark.read.text(path).select(p.alias("p")).filter(F.size("p") >= 5)
    return fields.selectExpr("try_cast(p[0] AS bigint) AS query_id", "p[2] AS doc_id", "try_cast(p[3] AS bigint) AS rank", "try_cast(p[4] AS double) AS score")


def qrels_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of a file of judgments."""
    p = F.split(F.trim("value"), r"\s+")
    fields = spark.read.text(path).select(p.alias("p")).filter(F.size("p") >= 4)
    return fields.selectExpr("try_cast(p[0] AS bigint) AS query_id", "p[2] AS doc_id", "try_cast(p[3] AS int) AS grade")
