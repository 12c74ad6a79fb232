"""Checks whose result is the rows that fail: `check`, `key`, `detail`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmodel.operators.scd import CURRENT, END, OPEN_END, START, UNKNOWN_KEY, DimensionSpec, stamp
from starmodel.sources.shared import materialize


def failing(df: DataFrame, check: str, key: Sequence[str], bad: Column, detail: Column | str = "") -> DataFrame:
    """The rows of `df` for which `bad` holds."""
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.where(bad).select(F.lit(check).alias("check"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<NULL>")) for k in key]).alias("key"), text.cast("string").alias("detail"))


def all_of(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_required(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A failing row for each null in a column that needs a value; one scan."""
    found = df.withColumn("_null", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))))
    return failing(found, "required", key, F.lit(True), F.col("_null"))


def check_unique(df: DataFrame, key: Sequence[str], name: str = "unique") -> DataFrame:
    """Keys that more than one row has."""
    return failing(df.groupBy(*key).agg(F.count("*").alias("_n")), name, key, F.col("_n") > 1, F.col("_n"))


def check_non_negative(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    found = df.withColumn("_bad", F.explode(F.array_compact(F.array(*[F.when(F.col(c) < 0, F.lit(c)) for c in columns]))))
    return failing(found, "non_negative", key, F.lit(True), F.col("_bad"))


def check_accepted(df: DataFrame, key: Sequence[str], column: str, values: Sequence) -> DataFrame:
    return failing(df, "accepted", key, ~F.col(column).isin(*values), F.col(column))


def check_range(df: DataFrame, key: Sequence[str], column: str, low, high) -> DataFrame:
    return failing(df, "range", key, ~F.col(column).between(low, high), F.col(column))


def check_order(df: DataFrame, key: Sequence[str], start: str, end: str, strict: bool = True) -> DataFrame:
    bad = (F.col(start) >= F.col(end)) if strict else (F.col(start) > F.col(end))
    return failing(df, "order", key, bad, F.concat_ws(" / ", F.col(start).cast("string"), F.col(end).cast("string")))


def check_calendar(calendar: DataFrame) -> DataFrame:
    """Attributes within their ranges, a key that matches its date, and a day
    that is either a weekend or a weekday."""
    limits = {"DayNumberOfWeek": 7, "DayNumberOfMonth": 31, "DayNumberOfYear": 366, "WeekNumberOfYear": 53, "MonthNumber": 12, "QuarterNumber": 4, "SemesterNumber": 2}
    bad = [F.when(~F.col(c).between(1, top), F.lit(c)) for c, top in limits.items()]
    bad.append(F.when(F.col("IsWeekend") == F.col("IsWeekday"), F.lit("IsWeekend")))
    bad.append(F.when(F.date_format("FullDate", "yyyyMMdd").cast("int") != F.col("DateKey"), F.lit("DateKey")))
    found = calendar.withColumn("_bad", F.explode(F.array_compact(F.array(*bad))))
    return failing(found, "calendar", ["DateKey"], F.lit(True), F.col("_bad"))


def check_calendar_complete(calendar: DataFrame) -> DataFrame:
    """Days that are missing or there twice: one row for each break."""
    following = F.lead("FullDate").over(Window.partitionBy(F.lit(0)).orderBy("FullDate"))  # a calendar is small
    steps = calendar.select("DateKey", F.datediff(following, F.col("FullDate")).alias("_step"))
    return failing(steps, "calendar_complete", ["DateKey"], F.col("_step") != 1, F.col("_step"))


def check_current_open(dim: DataFrame, spec: DimensionSpec) -> DataFrame:
    """A version is current if and only if its end is open."""
    return failing(dim, "current_open", [spec.surrogate_key], F.col(CURRENT) != (F.col(END) == stamp(OPEN_END)), F.col(END))


def check_one_current(dim: DataFrame, spec: DimensionSpec, exactly: bool = True) -> DataFrame:
    """Keys with more than one current version (with `exactly`, also with none)."""
    n = dim.groupBy(spec.business_key).agg(F.sum(F.col(CURRENT).cast("int")).alias("_n"))
    return failing(n, "one_current", [spec.business_key], (F.col("_n") != 1) if exactly else (F.col("_n") > 1), F.col("_n"))


def check_intervals(dim: DataFrame, spec: DimensionSpec) -> DataFrame:
    """Versions that overlap the next one of their key, or leave a gap before it."""
    following = F.lead(START).over(Window.partitionBy(spec.business_key).orderBy(START, spec.surrogate_key))
    found = dim.withColumn("_next", following)
    kind = F.when(F.col(END) > F.col("_next"), "overlap").when(F.col(END) < F.col("_next"), "gap")
    return failing(found, "intervals", [spec.surrogate_key], kind.isNotNull(), kind)


def check_references(child: DataFrame, key: Sequence[str], column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    parents = parent.select(F.col(parent_column).alias("_pk")).distinct()
    lost = child.where(F.col(column).isNotNull()).join(parents, F.col(column) == F.col("_pk"), "left_anti")
    return failing(lost, "references", key, F.lit(True), F.col(column))


def unknown_rate(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The share of facts whose key is the unknown member, for each column."""
    n = F.count("*")
    rates = fact.agg(n.alias("rows"), *[F.sum((F.col(c) == UNKNOWN_KEY).cast("long")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("unknown"), F.col("rows")) for c in columns])).alias("x")
    return rates.select(pairs).select("x.column", "x.unknown", "x.rows", F.try_divide(F.col("x.unknown").cast("double"), F.col("x.rows").cast("double")).alias("rate"))


def check_counters(log: DataFrame) -> DataFrame:
    """Runs with a negative counter or an end before their start."""
    negative = F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in ("RowsRead", "RowsInserted", "RowsUpdated", "RowsRejected")]) < 0
    late = F.col("EndTime") < F.col("StartTime")
    detail = F.when(negative, "negative counter").otherwise("ends before it starts")
    return failing(log, "run", ["ExecutionID"], negative | F.coalesce(late, F.lit(False)), detail)


def check_counts_match(before: DataFrame, after: DataFrame, spec: DimensionSpec, inserted: int, updated: int) -> DataFrame:
    """Compares a run's counters with the snapshots before and after it: one row
    for each counter that does not match."""
    old = before.select(F.col(spec.surrogate_key).alias("_k"), F.struct(*spec.columns).alias("_o"))
    new = after.select(F.col(spec.surrogate_key).alias("_k"), F.struct(*spec.columns).alias("_n"))
    seen = new.join(old, "_k", "left").agg(F.sum(F.col("_o").isNull().cast("long")).alias("i"), F.sum((F.col("_o").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n"))).cast("long")).alias("u"))
    pairs = F.explode(F.array(F.struct(F.lit("inserted").alias("c"), F.coalesce("i", F.lit(0)).alias("is"), F.lit(inserted).cast("long").alias("said")), F.struct(F.lit("updated").alias("c"), F.coalesce("u", F.lit(0)).alias("is"), F.lit(updated).cast("long").alias("said")))).alias("x")
    return failing(seen.select(pairs).select("x.*"), "counts_match", ["c"], F.col("is") != F.col("said"), F.concat_ws(" / ", F.col("is").cast("string"), F.col("said").cast("string")))


def reconcile(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (of `columns`, with how often) that only one side has."""
    s = source.groupBy(*columns).agg(F.count("*").alias("_s"))
    t = target.groupBy(*columns).agg(F.count("*").alias("_t")).withColumnsRenamed({c: f"_t_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in columns])
    both = s.join(t, same, "full_outer").select(*[F.coalesce(c, f"_t_{c}").alias(c) for c in columns], F.coalesce("_s", F.lit(0)).alias("in_source"), F.coalesce("_t", F.lit(0)).alias("in_target"))
    return both.where(F.col("in_source") != F.col("in_target"))


def reconcile_by_hash(source: DataFrame, target: DataFrame, columns: Sequence[str], levels: Sequence[int] = (1 << 12, 1 << 20)) -> DataFrame:
    """`reconcile`, for sides that are nearly alike: a tree of buckets of rows (by
    their hash), of which each level has as many as `levels` says. Each side sums
    the hashes and numbers of rows of a bucket, and only buckets whose sums differ
    are looked into further, so of two large sides only the rows of differing
    buckets are shuffled. Two of a bucket's sums would have to agree by chance for a
    difference to be missed (one in 2^64 or so for each bucket)."""
    place, other = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    sides = [side.withColumns({"_h": place, "_g": other}) for side in (source, target)]
    for n in levels:
        bucket = F.pmod(F.col("_h"), F.lit(n)).alias("_b")
        sums = [side.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(F.col("_g").cast("decimal(38,0)")).alias("s")) for side in sides]
        both = sums[0].toDF("_b", "_n", "_s").join(sums[1].toDF("_b", "n", "s"), "_b", "full_outer")
        # at most `n` numbers of eight bytes
        differ = materialize(both.where(~(F.col("_n").eqNullSafe(F.col("n")) & F.col("_s").eqNullSafe(F.col("s")))).select("_b"), "differ")
        sides = [side.join(F.broadcast(differ), F.pmod(F.col("_h"), F.lit(n)) == F.col("_b"), "left_semi") for side in sides]
    return reconcile(*[side.select(*columns) for side in sides], columns)


def version_changes(before: DataFrame, after: DataFrame, spec: DimensionSpec) -> DataFrame:
    """For each key how many versions a load has added, and whether an overwrite
    has touched its current one."""
    key = spec.business_key
    old = before.groupBy(key).agg(F.count("*").alias("_a"), F.max(F.when(F.col(CURRENT), F.struct(spec.surrogate_key, *spec.type1))).alias("_x"))
    new = after.groupBy(key).agg(F.count("*").alias("_b"), F.max(F.when(F.col(CURRENT), F.struct(spec.surrogate_key, *spec.type1))).alias("_y"))
    joined = new.join(old, key, "left")
    same_version = F.col(f"_x.{spec.surrogate_key}").eqNullSafe(F.col(f"_y.{spec.surrogate_key}"))
    return joined.select(key, (F.col("_b") - F.coalesce("_a", F.lit(0))).alias("added"), (same_version & ~F.col("_x").eqNullSafe(F.col("_y"))).alias("overwritten"))


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with the names of those they
    break; `rules` says what is wrong: name -> condition."""
    marked = df.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))
    return marked.where(F.size("reject_reasons") == 0).drop("reject_reasons"), marked.where(F.size("reject_reasons") > 0)


def check_customer_kind(staged: DataFrame) -> DataFrame:
    """A store id makes a store; a person alone an individual."""
    want = F.when(F.col("StoreID").isNotNull(), "Store").when(F.col("PersonID").isNotNull(), "Individual").otherwise("Unknown")
    return failing(staged, "customer_kind", ["CustomerID"], F.col("CustomerType") != want, F.col("CustomerType"))


def check_one_group(staged: DataFrame, column: str = "CountryRegionCode", group: str = "TerritoryGroup") -> DataFrame:
    """Countries with more than one group."""
    n = staged.groupBy(column).agg(F.countDistinct(group).alias("_n"))
    return failing(n, "one_group", [column], F.col("_n") > 1, F.col("_n"))
