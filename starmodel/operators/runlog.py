"""The log of runs: rows are only added; a run's state is its latest row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmodel.sources.schema import RUN_LOG, struct

ERROR_CHARS = 4000


def _row(spark: SparkSession, **values) -> DataFrame:
    schema = struct(RUN_LOG)
    row = spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)
    return row.withColumn("ExecutedBy", F.coalesce("ExecutedBy", F.current_user()))


def run_started(spark: SparkSession, execution_id: int, process: str, start: dt.datetime, source: str = "", target: str = "") -> DataFrame:
    """The row that a run begins with."""
    return _row(spark, ExecutionID=execution_id, ProcessName=process, SourceObject=source, TargetObject=target, StartTime=start, Status="Running")


def run_finished(started: DataFrame, end: dt.datetime, read: int = 0, inserted: int = 0, updated: int = 0, rejected: int = 0, error: str | None = None) -> DataFrame:
    """The row that a run ends with: Succeeded, or Failed with an error of at most 4000 characters."""
    values = {
        "EndTime": F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"), "Status": F.lit("Failed" if error is not None else "Succeeded"), "RowsRead": F.lit(read).cast("long"), "RowsInserted": F.lit(inserted).cast("long"),
        "RowsUpdated": F.lit(updated).cast("long"), "RowsRejected": F.lit(rejected).cast("long"), "ErrorMessage": F.lit(error).cast("string") if error is None else F.substring(F.lit(error), 1, ERROR_CHARS),
    }
    return started.withColumns(values)


def run_state(log: DataFrame) -> DataFrame:
    """The latest row of each run."""
    order = Window.partitionBy("ExecutionID").orderBy(F.col("EndTime").desc_nulls_last(), F.col("StartTime").desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
