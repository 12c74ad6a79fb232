"""Windows over all rows, or over keys of any size, in range parts.

A window over one order, or over a key with a third of all rows, is one task in
Spark. Here rows are dealt by range of (key, order), each part works on its own,
and what crosses its edges is one row a part, which is all that a single task sees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmodel.functions.clean import any_of, differs
from starmodel.sources.shared import materialize

PART = "_part"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, descending: bool = False) -> DataFrame:
    """The rows with the number of their range part, written, so that parts stay as
    they are. With an order that is unique within a key no part grows with a key."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *[(F.col(o).desc_nulls_last() if descending else F.col(o).asc_nulls_first()) for o in order]]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), "dealt")


def _sides(keys: Sequence[str], order: Sequence[str], descending: bool = False) -> tuple:
    """The window over one part, and that over the parts' edges (one row a part)."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *[(F.col(o).desc_nulls_last() if descending else F.col(o).asc_nulls_first()) for o in order]]
    return Window.partitionBy(PART).orderBy(*by), Window.partitionBy(F.lit(0)).orderBy(PART)


def with_neighbour(parts: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, after: bool = False) -> DataFrame:
    """Adds `name`: `columns` of the row before this one within its key (null for
    the first), or of the one `after`. `parts` come from `dealt`, some rows may
    have been left out since."""
    inside, edges = _sides(keys, order)
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("v"))
    step, place = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    ends = parts.groupBy(PART).agg(place(row, F.struct(*keys, *order)).alias("_edge"))
    ends = ends.select(F.col(PART), step("_edge").over(edges).alias("_edge"))
    out = parts.withColumn("_near", step(row).over(inside)).join(F.broadcast(ends), PART, "left").withColumn("_near", F.coalesce("_near", "_edge"))
    same = F.col("_near").isNotNull()
    for i, k in enumerate(keys):
        same &= F.col(f"_near.k{i}").eqNullSafe(F.col(k))
    return out.withColumn(name, F.when(same, F.col("_near.v"))).drop("_near", "_edge")


def filled_forward(parts: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """`column` where it is null: the last that is not, up to this row within its
    key; null before the first."""
    inside, edges = _sides(keys, order)
    row = F.when(F.col(column).isNotNull(), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(column).alias("v")))
    ends = parts.groupBy(PART).agg(F.max_by(row, F.when(row.isNotNull(), F.struct(*keys, *order))).alias("_edge"))
    ends = ends.select(F.col(PART), F.last("_edge", ignorenulls=True).over(edges.rowsBetween(Window.unboundedPreceding, -1)).alias("_edge"))
    last = F.last(row, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_last", last).join(F.broadcast(ends), PART, "left").withColumn("_last", F.coalesce("_last", "_edge"))
    same = F.col("_last").isNotNull()
    for i, k in enumerate(keys):
        same &= F.col(f"_last.k{i}").eqNullSafe(F.col(k))
    return out.withColumn(column, F.when(same, F.col("_last.v"))).drop("_last", "_edge")


def totals_before(parts: DataFrame, order: Sequence[str], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Adds each of `sums` over all rows before this one in the order (unique)."""
    inside, edges = _sides([], order, descending)
    own = {n: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, c in sums.items()}
    whole = parts.groupBy(PART).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = whole.select(F.col(PART), *[F.coalesce(F.sum(f"_{n}").over(edges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}") for n in sums])
    out = parts.withColumns(own).join(F.broadcast(before), PART)
    return out.withColumns({n: (F.col(n) + F.col(f"_{n}")).cast("long") for n in sums}).drop(*[f"_{n}" for n in sums])


def ranked(df: DataFrame, column: str, rank: str = "Rank", dense: str = "DenseRank", parts: int | None = None) -> DataFrame:
    """Adds rank and dense rank by `column`, largest first; ties share theirs, null
    comes last. Values are counted before they are dealt, so rows that share a
    value are one row; ranks are sums over the values before, and go back to the
    rows by a join, in which a frequent value is split."""
    values = df.groupBy(column).agg(F.count("*").alias("_rows"))
    values = totals_before(dealt(values, [], [column], parts, descending=True), [column], {"_above": F.col("_rows"), "_values": F.lit(1)}, descending=True)
    found = materialize(values.select(F.col(column).alias("_value"), (F.col("_above") + 1).alias(rank), (F.col("_values") + 1).alias(dense)), "ranks")
    return df.join(found, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def history(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Rows at which one of `columns` changes within a key, with `_until`: the `ts`
    of the next such row, null for the last. `ts` and `tie` are unique within a key."""
    order = [ts, *tie]
    rows = with_neighbour(dealt(df.select(*keys, *order, *columns), keys, order, parts), keys, order, columns, "_before")
    moved = F.col("_before").isNull() | any_of([differs(F.col(c), F.col(f"_before.{c}")) for c in columns])
    kept = materialize(rows.where(moved).drop("_before"), "moved")
    return with_neighbour(kept, keys, order, [ts], "_after", after=True).withColumn("_until", F.col(f"_after.{ts}")).drop("_after", PART)


def as_of(facts: DataFrame, key: str, ts: str, versions: DataFrame, version_key: str, start: str, payload: str, parts: int | None = None) -> DataFrame:
    """`facts` with `payload` (a column of `versions` that is not null) of the last
    version of their key that starts at or before `ts`; null without one. Facts and
    versions are put in one order by key and time, and each version is carried
    forward, so a fact meets one version however many its key has, and a key with a
    third of the facts is in many parts."""
    all_facts = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    own = F.monotonically_increasing_id()
    given = facts.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_kind"), own.alias("_id"), all_facts.alias("_fact"), F.lit(None).cast(versions.schema[payload].dataType).alias("_v"))
    kind = given.schema["_fact"].dataType
    known = versions.select(F.col(version_key).alias("_k"), F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_id"), F.lit(None).cast(kind).alias("_fact"), F.col(payload).alias("_v"))
    ordered = dealt(given.where(F.col("_k").isNotNull() & F.col("_t").isNotNull()).unionByName(known), ["_k"], ["_t", "_kind", "_id"], parts)
    found = filled_forward(ordered, ["_k"], ["_t", "_kind", "_id"], "_v").where("_kind = 1")
    none = given.where(F.col("_k").isNull() | F.col("_t").isNull())
    both = found.select("_fact", "_v").unionByName(none.select("_fact", "_v"))
    return both.select(*[F.col("_fact").getField(c).alias(c) for c in facts.columns], F.col("_v").alias(payload))
