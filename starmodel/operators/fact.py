"""The sales fact: one row for each order line."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.operators.lookup import lookup_key, role_date_key
from starmodel.operators.quality import failing
from starmodel.operators.scd import DimensionSpec
from starmodel.sources.schema import MONEY
from starmodel.sources.store import SnapshotStore

GRAIN = ("SalesOrderID", "SalesOrderDetailID")


def with_measures(lines: DataFrame) -> DataFrame:
    """Amounts of each line. Total cost is quantity times the standard cost of
    the product's version; gross profit is the net amount less that."""
    gross = (F.col("OrderQty") * F.col("UnitPrice")).cast(MONEY)
    discount = (F.col("OrderQty") * F.col("UnitPrice") * F.col("UnitPriceDiscount")).cast(MONEY)
    out = lines.withColumn("GrossAmount", gross).withColumn("DiscountAmount", discount).withColumn("NetAmount", (F.col("GrossAmount") - F.col("DiscountAmount")).cast(MONEY))
    out = out.withColumn("TotalCost", (F.col("OrderQty") * F.col("StandardCost")).cast(MONEY))
    return out.withColumn("GrossProfit", (F.col("NetAmount") - F.col("TotalCost")).cast(MONEY))


def load_fact(detail: DataFrame, header: DataFrame, product_dim: DataFrame, product: DimensionSpec, dims: dict[str, tuple[DataFrame, DimensionSpec, str]] | None = None, before_first: str = "unknown", guard: bool = False, attributes: Sequence[str] = (), measures: bool = True) -> DataFrame:
    """Order lines with the keys of the versions that were valid at the order
    date, the keys of the order, due and ship dates, and measures. `dims` names
    further dimensions: column of the key in the fact -> (dimension,
    specification, column of the business key); where the header has that column,
    keys are looked up for it, before its lines are joined. `attributes` of the
    product's version come along at the end. Order and line ids stay. Lines
    without a header are left out here; `line_rejects` returns them. With `guard`
    it is an error if a line of the source has become several, which versions
    that overlap would do; the check is a pass over the keys. Without `measures`
    `finished` has to add them yet."""
    keys, late = [product.surrogate_key, *(dims or {})], {}
    for column, (dim, spec, key) in (dims or {}).items():
        if key in header.columns and "OrderDate" in header.columns:
            header = lookup_key(header, dim, spec, key, "OrderDate", column, before_first)
        else:
            late[column] = dim, spec, key
    lines = detail.join(header, "SalesOrderID")
    for column, (dim, spec, key) in late.items():
        lines = lookup_key(lines, dim, spec, key, "OrderDate", column, before_first)
    lines = lookup_key(lines, product_dim, product, "ProductID", "OrderDate", before_first=before_first, attributes=("StandardCost", *attributes))
    for role in ("OrderDate", "DueDate", "ShipDate"):
        if role in lines.columns:
            lines = lines.withColumn(f"{role}Key", role_date_key(role))
            keys.append(f"{role}Key")
    if guard:
        more = grain_breaks(lines.select(*GRAIN), detail).count()
        if more:
            raise ValueError(f"{more} order lines have become several rows")
    out = lines.select(*GRAIN, *keys, "OrderDate", "OrderQty", "UnitPrice", "UnitPriceDiscount", "StandardCost", *attributes)
    return finished(out) if measures else out


def finished(lines: DataFrame) -> DataFrame:
    """What `load_fact` returns without measures, with them."""
    at = lines.columns.index("UnitPriceDiscount") + 1
    rest = [c for c in lines.columns[at:] if c != "StandardCost"]
    return with_measures(lines).select(*lines.columns[:at], "GrossAmount", "DiscountAmount", "NetAmount", "StandardCost", "TotalCost", "GrossProfit", *rest)


def grain_breaks(fact: DataFrame, detail: DataFrame) -> DataFrame:
    """Failing rows for the lines of which the fact has more rows than the source."""
    there = fact.groupBy(*GRAIN).agg(F.count("*").alias("_n"))
    given = detail.groupBy(*GRAIN).agg(F.count("*").alias("_m"))
    return failing(there.join(given, list(GRAIN)), "grain", GRAIN, F.col("_n") > F.col("_m"), F.col("_n"))


def line_rejects(detail: DataFrame, header: DataFrame) -> DataFrame:
    """The order lines that `load_fact` leaves out: those without a header, with
    `reject_reasons` as in staging."""
    reason = F.when(F.col("SalesOrderID").isNull(), F.lit("SalesOrderID is missing")).otherwise(F.lit("no such order"))
    return detail.join(header.select("SalesOrderID"), "SalesOrderID", "left_anti").select(*detail.columns, F.array(reason).alias("reject_reasons"))


def header_totals(lines: DataFrame, measures: tuple[str, ...], key: str = "SalesOrderID") -> DataFrame:
    """Sums of measures of the order that are repeated on its lines, each order once."""
    return lines.groupBy(key).agg(*[F.max(m).alias(m) for m in measures]).agg(*[F.sum(m).alias(m) for m in measures])


#: The published fact's part for lines without an order date.
NO_MONTH = "none"


def publish(store: SnapshotStore, table: str, fact: DataFrame, months: Sequence[str] | None = None, note: str | Callable[[DataFrame], str] = "", finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
    """Publishes the fact in parts by order month, for pruned reads, and switches
    readers to it when it is complete: who reads meanwhile sees what was there
    before. With `months` (yyyy-MM) `fact` has all lines of those months only, as
    after late changes; the files of all other months stay as they are. A
    `note` that is a function sees the rows when they are written; where it raises an
    error, readers are not switched. `finish` adds what is made of a row alone when
    rows have been brought together by month."""
    rows = fact.withColumn("OrderMonth", F.coalesce(F.date_format("OrderDate", "yyyy-MM"), F.lit(NO_MONTH)))
    if months is not None:
        rows = rows.where(F.col("OrderMonth").isin(*months))
    return store.write_parts(table, rows, "OrderMonth", months, note, finish)
