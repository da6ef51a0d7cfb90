"""Folders that all executors share, for tables that cut lineage or are read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session (tests) gets a temporary one, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="grist-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def file_system(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it is deleted when the driver ends, if not before."""
    at = f"{shared_dir(spark)}/grist-{uuid.uuid4().hex}"
    fs, path = file_system(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Deletes what is at a path, if anything is."""
    fs, path = file_system(spark, at)
    if fs.exists(path):
        fs.delete(path, True)


def names(spark: SparkSession, at: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, path = file_system(spark, at)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def put(spark: SparkSession, at: str, blocks: Iterable[bytes]) -> str:
    """Writes a file, block by block, and gives its path."""
    fs, path = file_system(spark, at)
    out = fs.create(path, True)
    try:
        for block in blocks:
            out.write(bytearray(block))
    finally:
        out.close()
    return at
