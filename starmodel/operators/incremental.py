"""Incremental loads: watermarks, changes and histories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmodel.functions.clean import any_of, differs
from starmodel.operators import ordered
from starmodel.operators.scd import CURRENT, END, OPEN_END, START, DimensionSpec, apply_scd, stamp
from starmodel.sources.shared import materialize
from starmodel.sources.store import SnapshotStore


def extract_since(df: DataFrame, column: str, watermark: dt.datetime | str | None) -> DataFrame:
    """Rows that are later than the watermark; all without one. The comparison
    is on the bare column, so it reaches the scan."""
    return df if watermark is None else df.where(F.col(column) > stamp(watermark))


def load_since(store: SnapshotStore, name: str, df: DataFrame, column: str, load: Callable[[DataFrame], None]) -> str | None:
    """Loads what is later than the stored watermark of `name`; the watermark
    moves on after `load` has succeeded. Returns the new one."""
    mark = store.note(f"watermark_{name}") or None
    rows = materialize(extract_since(df, column, mark), f"since-{name}")  # rows that come later are for the next load
    top = rows.agg(F.max(column).cast("string")).first()[0]
    if top is None:
        return mark
    load(rows)
    store.write(f"watermark_{name}", df.sparkSession.createDataFrame([(name, top)], "name string, mark string"), note=top)
    return top


def latest_change(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given (unique within a key). The
    largest is kept while rows are summed up, so a key with many changes is one
    row a task before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_b")) if not _unordered(df, rest) else None
    if best is None:
        w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.select(*[F.col(c) if c in key else F.col(f"_b.{c}") for c in df.columns])


def _unordered(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether a column has a type that can't be compared (a map)."""
    return any(dict(df.dtypes)[c].startswith("map") for c in columns)


def apply_changes(dim: DataFrame, changes: DataFrame, spec: DimensionSpec, load_ts: dt.datetime, order: Sequence[str], operation: str = "op") -> tuple[DataFrame, DataFrame]:
    """Applies change rows (`operation` insert, update or delete, and the staged
    attributes): the last of each key counts. Inserts and updates go through
    `apply_scd`; a delete ends the current version and removes no row."""
    last = latest_change(changes.select(*spec.attributes, operation, *[o for o in order if o not in spec.attributes]), [spec.business_key], order)
    staged = last.where(F.col(operation) != "delete").select(*spec.attributes)
    nxt, counts = apply_scd(dim, staged, spec, load_ts)
    gone = last.where(F.col(operation) == "delete").select(F.col(spec.business_key).alias("_gone"))
    marked = nxt.join(gone, (F.col(spec.business_key) == F.col("_gone")) & F.col(CURRENT), "left")
    ended = F.col("_gone").isNotNull()
    out = marked.withColumn(END, F.when(ended, stamp(load_ts)).otherwise(F.col(END))).withColumn(CURRENT, F.col(CURRENT) & ~ended)
    return out.select(*spec.columns), counts


#: Changes of one key that one task orders; keys with more are cut by time.
HOT = 1_000_000


def history_from_changes(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Versions from ordered change rows: changes that change nothing are left
    out, each version ends where the next begins. `ts` and `tie` are unique within a
    key. Keys are sorted by time in one shuffle; those with more than `hot` changes
    are cut into range parts, between which one row is carried."""
    often = df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*[F.col(k).alias(f"_hot_{k}") for k in key])
    often = materialize(often, "hot-keys")
    if often.isEmpty():
        return _history(df, key, ts, columns, tie)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in key])
    parts = ordered.history(df.join(often, same, "left_semi"), key, ts, columns, tie)
    parts = parts.select(*key, F.col(ts).alias(START), *columns, F.coalesce("_until", stamp(OPEN_END)).alias(END), F.col("_until").isNull().alias(CURRENT))
    return _history(df.join(often, same, "left_anti"), key, ts, columns, tie).unionByName(parts)


def _history(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(ts, *tie)
    before = {c: F.lag(c).over(order) for c in columns}
    first = F.row_number().over(order) == 1
    moved = df.select(*key, F.col(ts).alias(START), *tie, *columns, (first | any_of([differs(F.col(c), before[c]) for c in columns])).alias("_moved")).where("_moved").drop("_moved")
    following = F.lead(START).over(Window.partitionBy(*key).orderBy(START, *tie))
    out = moved.withColumn(END, F.coalesce(following, stamp(OPEN_END))).withColumn(CURRENT, following.isNull())
    return out.drop(*tie)
