"""Source tables: Parquet paths or databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmodel.sources.schema import SOURCES, conform


def read_parquet(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, split_column: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 16, **options: str) -> DataFrame:
    """A database table; with `split_column`, read in ranges of it side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_column:
        reader = reader.option("partitionColumn", split_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def read_database(spark: SparkSession, url: str, table: str, split_column: str, since: tuple[str, str] | None = None, rows: int = 1_000_000, most: int = 200, **options: str) -> DataFrame:
    """A database table in ranges of `split_column` (a number), whose bounds and
    number come from the table itself: about `rows` in each, read side by side
    over at most `most` connections. `since` (column, literal of the database)
    leaves out what is not later than a watermark, in the database: it is in the
    query for the bounds and in each range's."""
    later = f" WHERE {since[0]} > {since[1]}" if since else ""
    reader = lambda query: spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS t").options(**options)
    low, high, n = reader(f"SELECT MIN({split_column}) AS low, MAX({split_column}) AS high, COUNT(*) AS n FROM {table}{later}").load().first()
    parts = max(1, min(most, -(-int(n or 0) // rows)))
    whole = reader(f"SELECT * FROM {table}{later}")
    if low is None or parts == 1:
        return whole.load()
    return whole.option("partitionColumn", split_column).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def source(df: DataFrame, name: str) -> DataFrame:
    """A table brought to the contract of a source of that name."""
    return conform(df, SOURCES[name])
