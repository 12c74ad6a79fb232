"""Slowly changing dimensions: one engine, a specification for each dimension.

A staged snapshot is compared with the current members in one join, which says
for each key what is to be done; the next snapshot of the dimension follows from
that. Keys that are absent from staging are kept as they are."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.functions.clean import any_of, differs
from starmodel.operators import staging
from starmodel.sources.shared import keep, materialize
from starmodel.sources.store import SnapshotStore

#: The end of a version that is still current.
OPEN_END = "9999-12-31 23:59:59.999999"
START, END, CURRENT = "EffectiveStartDateTime", "EffectiveEndDateTime", "IsCurrent"
ACTIONS = ("new", "t1", "t2", "same", "keep")
UNKNOWN_KEY = -1


@dataclass(frozen=True)
class DimensionSpec:
    """What differs between dimensions.

    `type0` is never updated in place (a new version takes the staged value),
    `type1` is overwritten in the current version, `type2` opens a new one.
    `type1_by` says what an overwrite needs: a changed attribute ("attributes"),
    that or a changed modified date ("modified"), or a changed hash ("hash", for
    dimensions without type2). In `null_is_empty` null and empty are the same."""

    name: str
    business_key: str
    surrogate_key: str
    type1: tuple[str, ...] = ()
    type2: tuple[str, ...] = ()
    type0: tuple[str, ...] = ()
    type1_by: str = "attributes"
    null_is_empty: tuple[str, ...] = ()
    modified: str = "SourceModifiedDate"
    hash: str = "RowHash"

    @property
    def attributes(self) -> list[str]:
        return [self.business_key, *self.type0, *self.type1, *self.type2, self.modified, self.hash]

    @property
    def columns(self) -> list[str]:
        return [self.surrogate_key, *self.attributes, START, END, CURRENT, "CreatedAt"]


PRODUCT = DimensionSpec("product", "ProductID", "ProductKey", ("ProductName", "ProductNumber"), staging.PRODUCT_HASH, type1_by="modified")
CUSTOMER = DimensionSpec("customer", "CustomerID", "CustomerKey", staging.CUSTOMER_HASH, type1_by="hash")
TERRITORY = DimensionSpec("territory", "TerritoryID", "TerritoryKey", ("TerritoryName", "CountryRegionName"), staging.TERRITORY_HASH)
SALESPERSON = DimensionSpec(
    "salesperson", "BusinessEntityID", "SalesPersonKey", ("SalesPersonName", "FirstName", "MiddleName", "LastName"), staging.SALESPERSON_HASH, ("HireDate",), null_is_empty=("MiddleName",)
)


def stamp(t: dt.datetime | str) -> Column:
    return F.lit(t if isinstance(t, str) else t.isoformat(sep=" ")).cast(T.TimestampNTZType())


def empty_dimension(staged: DataFrame, spec: DimensionSpec) -> DataFrame:
    """A dimension without members, its types taken from staging."""
    kinds = {f.name: f.dataType for f in staged.schema.fields}
    extra = {spec.surrogate_key: T.LongType(), START: T.TimestampNTZType(), END: T.TimestampNTZType(), CURRENT: T.BooleanType(), "CreatedAt": T.TimestampNTZType()}
    return staged.sparkSession.createDataFrame([], T.StructType([T.StructField(c, extra.get(c) or kinds[c]) for c in spec.columns]))


def classify(dim: DataFrame, staged: DataFrame, spec: DimensionSpec) -> DataFrame:
    """One row for each key: `action`, `d` (the current member), `s` (the staged
    row, any of them if there are several), `staged` (how many there are).

    new - no current member; t2 - the hash differs; t1 - an overwrite; same - as
    it was; keep - not staged. Without type2 a changed hash is an overwrite. The
    unknown member takes no part."""
    key = spec.business_key
    d = dim.where(F.col(CURRENT) & (F.col(spec.surrogate_key) != UNKNOWN_KEY)).select(F.col(key).alias("_dk"), F.struct(*spec.columns).alias("d"))
    # staged rows are counted by key, so what a repeated key's rows would do plays no part
    s = staged.groupBy(F.col(key).alias("_sk")).agg(F.first(F.struct(*spec.attributes)).alias("s"), F.count("*").alias("staged"))
    joined = d.join(s, F.col("_dk") == F.col("_sk"), "full_outer")
    other_hash = differs(F.col(f"d.{spec.hash}"), F.col(f"s.{spec.hash}"))
    if spec.type1_by == "hash":
        changed1, changed2 = other_hash, F.lit(False)
    else:
        pairs = [differs(F.col(f"d.{c}"), F.col(f"s.{c}"), c in spec.null_is_empty) for c in spec.type1]
        if spec.type1_by == "modified":
            pairs.append(differs(F.col(f"d.{spec.modified}"), F.col(f"s.{spec.modified}")))
        changed1, changed2 = any_of(pairs), other_hash
    action = F.when(F.col("s").isNull(), "keep").when(F.col("d").isNull(), "new").when(changed2, "t2").when(changed1, "t1").otherwise("same")
    return joined.select(action.alias("action"), "d", "s", F.coalesce("staged", F.lit(0)).alias("staged"))


def compared(dim: DataFrame, staged: DataFrame, spec: DimensionSpec, load_ts: dt.datetime) -> tuple[DataFrame, dict[str, int]]:
    """`classify`, written, and the number of keys for each action, observed while
    writing. It is an error if a staged key is null or repeated, whatever its rows
    would do, or if `load_ts` is not later than every current start."""
    watch = Observation()
    given = F.col("staged") > 0
    bad = given & ((F.col("staged") > 1) | F.col(f"s.{spec.business_key}").isNull())
    counted = [F.sum((F.col("action") == a).cast("long")).alias(a) for a in ACTIONS]
    seen = classify(dim, staged, spec).observe(watch, *counted, F.sum(bad.cast("long")).alias("bad"), F.max(f"d.{START}").cast("string").alias("latest"))
    seen = materialize(seen, f"scd-{spec.name}")
    sums = watch.get
    if sums["bad"]:
        raise ValueError(f"{sums['bad']} staged keys of {spec.name} are null or repeated")
    if sums["latest"] is not None and load_ts <= dt.datetime.fromisoformat(sums["latest"]):
        raise ValueError(f"the load time {load_ts} is not later than the latest version, {sums['latest']}")
    return seen, {a: sums[a] or 0 for a in ACTIONS}


#: Rows that are numbered by one sorted task at most, where their number is known.
FEW = 100_000


def assign_keys(df: DataFrame, order_by: Sequence[str], column: str, start: int, rows: int | None = None) -> DataFrame:
    """Adds dense keys from `start` on in the order of `order_by` (unique).
    If there are few rows (`rows`, if known), one task sorts and numbers them.

    Otherwise rows are dealt by range and numbered in their parts; the parts' sizes (one
    row a task) give each its offset. So no task holds all rows, and as the
    numbered rows are written out, no key changes when a task runs again."""
    if rows is not None and rows <= FEW:
        return df.repartition(1).sortWithinPartitions(*order_by).withColumn(column, F.lit(start).cast("long") + F.monotonically_increasing_id())
    dealt = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", local), "keys")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    out = dealt.join(F.broadcast(offsets), "_part")
    return out.withColumn(column, (F.lit(start) + F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def apply_scd(dim: DataFrame, staged: DataFrame, spec: DimensionSpec, load_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of the dimension, and `action`, `n` for each of ACTIONS.

    Staged keys must be unique and not null, which is checked. `load_ts` ends the
    versions that are replaced and begins the new ones; it must be later than
    every current start. A second run with the same staging changes nothing.

    The comparison is written once; its counts, the latest start and repeated
    keys are observed while it is. The snapshot is written once and returned as
    a table that is read from its files."""
    seen, found = compared(dim, staged, spec, load_ts)
    key = F.col(spec.surrogate_key)
    top = dim.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(0))).first()[0]
    members, fresh = next_rows(seen, found, spec, load_ts, top)
    history = dim.where(~F.col(CURRENT) | (F.col(spec.surrogate_key) == UNKNOWN_KEY)).select(*spec.columns)
    counts = dim.sparkSession.createDataFrame([(a, found.get(a, 0)) for a in ACTIONS], "action string, n long")
    return keep(history.unionByName(members).unionByName(fresh), f"dim-{spec.name}"), counts


def next_rows(seen: DataFrame, found: dict[str, int], spec: DimensionSpec, load_ts: dt.datetime, top: int) -> tuple[DataFrame, DataFrame]:
    """What becomes of the members in `seen` (as they stay, overwritten, or ended),
    and the new members and versions, whose keys come after `top`."""
    at = stamp(load_ts)
    overwrite = list(spec.type1) + [spec.modified] + ([spec.hash] if spec.type1_by == "hash" else [])
    old = seen.where(F.col("action") != "new")
    is_t1, is_t2 = F.col("action") == "t1", F.col("action").isin("t2", "gone")

    def kept(c: str) -> Column:
        value = F.col(f"d.{c}")
        if c in overwrite:
            return F.when(is_t1, F.col(f"s.{c}")).otherwise(value)
        if c == END:
            return F.when(is_t2, at).otherwise(value)
        return (value & ~is_t2) if c == CURRENT else value

    members = old.select(*[kept(c).alias(c) for c in spec.columns])
    fresh = seen.where(F.col("action").isin("new", "t2")).select("s.*", at.alias(START), stamp(OPEN_END).alias(END), F.lit(True).alias(CURRENT), at.alias("CreatedAt"))
    fresh = assign_keys(fresh, [spec.business_key], spec.surrogate_key, top + 1, found.get("new", 0) + found.get("t2", 0)).select(*spec.columns)
    return members, fresh


def load_parts(store: SnapshotStore, spec: DimensionSpec, staged: DataFrame, load_ts: dt.datetime, gone: DataFrame | None = None, buckets: int | None = None, note: Callable[[dict[str, int]], str] = lambda found: "") -> dict[str, int]:
    """`apply_scd` on a dimension that `store` has in parts: two for each bucket of
    keys, one of current members and one of ended versions. Only the buckets that
    staged keys fall into are read, and of those only the ones in which something
    changes are written; ended versions are added as files and never written again.
    `gone` (a column of keys) ends current versions without a new one. Returns the
    number of keys for each action (and `gone`); `note` makes the marker's note of them.

    The number of `buckets` is set by the first load, by default one for 200,000
    members. The largest surrogate key is in the marker."""
    marker = store.marker(spec.name) or {}
    key = F.col(spec.business_key)
    n = marker.get("buckets") or buckets or min(20_000, max(16, -(-staged.count() // 200_000)))
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(n)).cast("string")
    dim = empty_dimension(staged, spec)
    if marker:
        keys = staged.select(bucket(key).alias("b")) if gone is None else staged.select(bucket(key).alias("b")).union(gone.select(bucket(F.col(gone.columns[0]).cast(dim.schema[spec.business_key].dataType)).alias("b")))
        there = [r["b"] for r in keys.distinct().collect()]  # at most one for each bucket
        dim = store.read(spec.name, parts=[f"c{b}" for b in there]).select(*spec.columns)
    seen, found = compared(dim, staged, spec, load_ts)
    if gone is not None:
        ends = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
        seen = seen.join(ends, F.coalesce(F.col(f"d.{spec.business_key}"), F.col(f"s.{spec.business_key}")) == F.col("_gone"), "left")
        seen = materialize(seen.withColumn("action", F.when(F.col("_gone").isNotNull() & (F.col("action") == "keep"), "gone").otherwise(F.col("action"))).drop("_gone"), f"scd-{spec.name}")
    seen = seen.withColumn("bucket", bucket(F.coalesce(F.col(f"d.{spec.business_key}"), F.col(f"s.{spec.business_key}"))))
    moved = seen.where(~F.col("action").isin("same", "keep"))
    sums = moved.groupBy("bucket").agg(F.sum((F.col("action") == "gone").cast("long")).alias("gone")).collect()
    changed, found["gone"] = [r["bucket"] for r in sums], sum(r["gone"] for r in sums)
    if changed or not marker:
        members, fresh = next_rows(seen.where(F.col("bucket").isin(changed)), found, spec, load_ts, marker.get("top", 0))
        rows = members.unionByName(fresh).withColumn("_part", F.concat(F.when(F.col(CURRENT), "c").otherwise("h"), bucket(key)))
        more = {"buckets": n, "top": marker.get("top", 0) + found["new"] + found["t2"]}
        store.write_parts(spec.name, rows, "_part", [f"c{b}" for b in changed] if marker else None, note(found), **more)
    else:
        store.write_parts(spec.name, dim.limit(0).withColumn("_part", F.lit("")), "_part", [], note(found), buckets=n, top=marker["top"])
    return found


def totals(counts: DataFrame) -> DataFrame:
    """Rows read, inserted (new members and versions) and updated (overwrites and ended versions)."""
    n = lambda *a: F.sum(F.when(F.col("action").isin(*a), F.col("n")).otherwise(0)).cast("long")
    return counts.agg(n("new", "t1", "t2", "same").alias("rows_read"), n("new", "t2").alias("rows_inserted"), n("t1", "t2").alias("rows_updated"))


def with_unknown_member(dim: DataFrame, spec: DimensionSpec, label: str = "Unknown") -> DataFrame:
    """The dimension with a member of key -1, for facts whose key is not found."""
    kinds = {f.name: f.dataType for f in dim.schema.fields}

    def value(c: str) -> Column:
        if c in (spec.surrogate_key, spec.business_key):
            return F.lit(UNKNOWN_KEY)
        if c in (START, "CreatedAt", spec.modified):
            return stamp("1900-01-01 00:00:00")
        if c == END:
            return stamp(OPEN_END)
        if c == CURRENT:
            return F.lit(True)
        if c == spec.hash:
            return F.sha2(F.lit(label), 256)
        return F.lit(label) if isinstance(kinds[c], T.StringType) else F.lit(None)

    row = dim.sparkSession.range(1).select(*[value(c).cast(kinds[c]).alias(c) for c in spec.columns])
    return dim.where(F.col(spec.surrogate_key) != UNKNOWN_KEY).select(*spec.columns).unionByName(row)


def current_members(dim: DataFrame, spec: DimensionSpec) -> DataFrame:
    """One row for each key: its current version."""
    return dim.where(F.col(CURRENT) & (F.col(spec.surrogate_key) != UNKNOWN_KEY))
