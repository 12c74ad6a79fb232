"""Surrogate keys for facts, by the version that was valid at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmodel.functions.clean import date_key
from starmodel.operators import ordered
from starmodel.operators.scd import CURRENT, END, START, UNKNOWN_KEY, DimensionSpec
from starmodel.sources.shared import materialize

#: Bytes of a dimension's files that are broadcast at most.
SMALL = 64 << 20

#: Versions of a key that each of its facts is compared with at most, if they don't overlap.
MANY = 64


def size_in_bytes(df: DataFrame) -> int:
    """What Spark knows of a table's size before it is run: for one that is read
    from its files, their bytes in proportion to the columns that are read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_key(
    facts: DataFrame, dim: DataFrame, spec: DimensionSpec, key: str, event_ts: str, column: str | None = None, before_first: str = "unknown", attributes: tuple[str, ...] = (), small: int = SMALL
) -> DataFrame:
    """`facts` with the surrogate key of the version whose [start, end) holds
    `event_ts`; -1 where the key is null, unknown, or has no version then. With
    `before_first` "first_version" events before the first version take it.
    `attributes` of that version are added too.

    A dimension of at most `small` bytes is broadcast, a larger one is joined by a
    shuffle: both on the business key, with the interval as a condition on top. Keys
    with over MANY versions, in which a fact would meet them all, are put in one
    order with their facts and the last version is carried forward, unless their
    versions overlap. All ways give the same rows: a fact becomes as many as there
    are versions that hold its time."""
    if before_first not in ("unknown", "first_version"):
        raise ValueError(f"before_first: {before_first}")
    column = column or spec.surrogate_key
    versions = dim.where(F.col(spec.surrogate_key) != UNKNOWN_KEY)
    begin = F.col(START)
    if before_first == "first_version":
        first = F.row_number().over(Window.partitionBy(spec.business_key).orderBy(START)) == 1
        begin = F.when(first, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col(START))
    versions = versions.select(F.col(spec.business_key).alias("_bk"), F.col(spec.surrogate_key).alias("_key"), begin.alias("_start"), F.col(END).alias("_end"), *[F.col(a).alias(f"_a_{a}") for a in attributes])
    t = F.col(event_ts).cast("timestamp_ntz")
    if size_in_bytes(versions) <= small:
        out = facts.join(F.broadcast(versions), (F.col(key) == F.col("_bk")) & (t >= F.col("_start")) & (t < F.col("_end")), "left")
    else:
        out = _far(facts, versions, key, t)
    out = out.withColumn(column, F.coalesce("_key", F.lit(UNKNOWN_KEY)).cast("long"))
    for a in attributes:
        out = out.withColumn(a, F.col(f"_a_{a}"))
    return out.drop("_bk", "_key", "_start", "_end", *[f"_a_{a}" for a in attributes])


def _far(facts: DataFrame, versions: DataFrame, key: str, t: Column) -> DataFrame:
    """The join of facts and versions of `lookup_key` without a broadcast of all
    versions. Only the columns that are used later go through its shuffle."""
    holds = (t >= F.col("_start")) & (t < F.col("_end"))
    busy = versions.groupBy("_bk").agg(F.count("*").alias("_n")).where((F.col("_n") > MANY) & F.col("_bk").isNotNull()).select("_bk")
    if busy.isEmpty():
        return facts.join(versions, (F.col(key) == F.col("_bk")) & holds, "left")
    after = F.lead("_start").over(Window.partitionBy("_bk").orderBy("_start"))
    fine = (F.col("_start") < F.col("_end")) & (F.coalesce(after, F.col("_end")) >= F.col("_end"))
    some = versions.join(busy, "_bk", "left_semi").withColumn("_fine", F.coalesce(fine, F.lit(False)))
    apart = materialize(some.groupBy("_bk").agg(F.min("_fine").alias("_fine")).where("_fine").select(F.col("_bk").alias("_busy")), "busy")
    rest = facts.join(apart, F.col(key) == F.col("_busy"), "left_anti").join(versions.join(apart, F.col("_bk") == F.col("_busy"), "left_anti"), (F.col(key) == F.col("_bk")) & holds, "left")
    many, known = facts.join(apart, F.col(key) == F.col("_busy"), "left_semi").withColumn("_t", t), versions.join(apart, F.col("_bk") == F.col("_busy"), "left_semi")
    found = ordered.as_of(many, key, "_t", known.select("_bk", "_start", F.struct(*known.columns).alias("_v")), "_bk", "_start", "_v")
    valid = F.col("_t") < F.col("_v._end")
    return rest.unionByName(found.select(*facts.columns, *[F.when(valid, F.col("_v").getField(c)).alias(c) for c in versions.columns]))


def role_date_key(c: str) -> Column:
    """The calendar's key of a date, -1 for none."""
    return F.coalesce(date_key(F.col(c)), F.lit(UNKNOWN_KEY))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key (not null) is not among the parents."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def as_is(facts: DataFrame, dim: DataFrame, spec: DimensionSpec, attributes: tuple[str, ...]) -> DataFrame:
    """Facts (with their version's key) with attributes as they are now: version
    key to business key to current member."""
    keys = dim.select(spec.surrogate_key, spec.business_key)
    now = dim.where(F.col(CURRENT)).select(spec.business_key, *attributes)
    return facts.join(keys.join(now, spec.business_key).drop(spec.business_key), spec.surrogate_key, "left")


def as_was(facts: DataFrame, dim: DataFrame, spec: DimensionSpec, attributes: tuple[str, ...]) -> DataFrame:
    """Facts with attributes of the version that they refer to."""
    return facts.join(dim.select(spec.surrogate_key, *attributes), spec.surrogate_key, "left")
