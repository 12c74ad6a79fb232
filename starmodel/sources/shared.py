"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where
    it is unset and all run on this machine, as in tests, a new temporary one that
    the session keeps. A cluster has to name one, as its machines don't see each
    other's temporary folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("starmodel.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("starmodel.shared.dir", found)
    return found.rstrip("/")


#: Folders that `materialize` has written within each open `scratch`.
_written: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read from there:
    later steps start from the files, whichever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within are deleted at the end, so whatever is
    still needed has to be written before that by other means."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            _delete(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """As `materialize`, but no `scratch` deletes it."""
    _written.append([])
    try:
        return materialize(df, name)
    finally:
        _written.pop()
