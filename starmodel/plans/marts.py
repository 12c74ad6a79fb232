"""Reports over the fact and its dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmodel.functions.clean import margin_pct
from starmodel.operators import ordered
from starmodel.sources.shared import materialize


def _money(c: str):
    return F.sum(c).cast("double").alias(c)


def with_dates(fact: DataFrame, calendar: DataFrame, role: str = "OrderDateKey", columns: Sequence[str] = ("CalendarYear",)) -> DataFrame:
    """The fact with attributes of one of its dates (a calendar is small: a row a
    day). All rows stay; without a date they get the calendar's unknown member, if
    it has one."""
    dates = calendar.select(F.col("DateKey").alias(role), *columns)
    return fact.join(F.broadcast(dates), role, "left")


def sales_summary(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orders, lines, quantity and amounts for each group."""
    return fact.groupBy(*by).agg(F.countDistinct("SalesOrderID").alias("Orders"), F.count("*").alias("Lines"), F.sum("OrderQty").alias("Quantity"), _money("GrossAmount"), _money("DiscountAmount"), _money("NetAmount"), F.avg(F.col("NetAmount").cast("double")).alias("AverageNet"))


def product_performance(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """Revenue, cost, profit and margin for each product or category."""
    sums = fact.groupBy(*by).agg(F.sum("OrderQty").alias("Quantity"), _money("NetAmount"), _money("TotalCost"), _money("GrossProfit"))
    return sums.withColumn("MarginPct", margin_pct(F.col("NetAmount"), F.col("TotalCost")))


def sales_by_date_range(fact: DataFrame, first_key: int, end_key: int) -> DataFrame:
    """Net sales by order date from first_key up to, not including, end_key."""
    part = fact.where((F.col("OrderDateKey") >= first_key) & (F.col("OrderDateKey") < end_key))
    return part.groupBy("OrderDateKey").agg(F.count("*").alias("Lines"), _money("NetAmount"))


def ranked_customers(fact: DataFrame, key: str = "CustomerKey", top: int | None = None) -> DataFrame:
    """Customers by net sales: `Rank` and `DenseRank`. The ranking is over one
    row for each customer, in range parts; with `top` only that many rows are
    ranked, by one task."""
    sums = fact.where(F.col(key) >= 0).groupBy(key).agg(F.sum("NetAmount").alias("_net"))
    if top:
        least = sums.orderBy(F.desc("_net")).limit(top).agg(F.min("_net").alias("_least"))
        sums = sums.join(F.broadcast(least), F.col("_net") >= F.col("_least")).drop("_least")
    if not top:
        sums = materialize(sums, "ranked")
        return ordered.ranked(sums, "_net").select(key, F.col("_net").cast("double").alias("NetAmount"), "Rank", "DenseRank")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_net"))
    out = sums.select(key, F.col("_net").cast("double").alias("NetAmount"), F.rank().over(order).alias("Rank"), F.dense_rank().over(order).alias("DenseRank"))
    return out.where(F.col("Rank") <= top)


def hierarchy(fact: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Net sales at each level of a hierarchy and in total; `Level` counts the
    columns that are summed over."""
    return fact.rollup(*levels).agg(F.grouping_id().alias("_g"), F.count("*").alias("Lines"), _money("NetAmount")).withColumn("Level", F.bit_count("_g")).drop("_g")


def profile(df: DataFrame, config: dict[str, object]) -> DataFrame:
    """How many rows have each combination of conditions."""
    return df.select(*[c.alias(n) for n, c in config.items()]).groupBy(*config).agg(F.count("*").alias("n"))


def column_sketches(df: DataFrame, columns: Sequence[str], load: str = "") -> DataFrame:
    """What is kept of a load for profiles: `load`, `column`, `rows`, `nulls`, and a
    mergeable sketch of the distinct values (about 4 KB each); one scan, and a row a
    column from each task is all that is shuffled."""
    kind = dict(df.dtypes)
    value = lambda c: F.col(c) if kind[c] in ("int", "bigint", "string", "binary") else F.col(c).cast("string")
    aggs = [x for c in columns for x in (F.hll_sketch_agg(value(c)).alias(f"d_{c}"), F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(load).alias("load"), F.lit(c).alias("column"), F.col("rows"), F.coalesce(f"n_{c}", F.lit(0)).alias("nulls"), F.col(f"d_{c}").alias("sketch")) for c in columns])).alias("x")
    return one.select(pairs).select("x.*")


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all loads together from their sketches: `column`, `rows`,
    `distinct_values` (within about 2 %), `nulls`. No load is read again."""
    merged = sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"), F.sum("nulls").alias("nulls"))
    return merged


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct values and nulls of each column, from one scan."""
    aggs = [x for c in columns for x in (F.countDistinct(c).alias(f"d_{c}"), F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"d_{c}").alias("distinct_values"), F.coalesce(f"n_{c}", F.lit(0)).alias("nulls")) for c in columns])).alias("x")
    return one.select(pairs).select("x.*")
