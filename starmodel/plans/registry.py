"""Queries over the warehouse operators, by name, and their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmodel.functions import clean
from starmodel.functions.rowhash import row_hash
from starmodel.operators import backdated, calendar, fact, incremental, load, lookup, ordered, quality, runlog, scd
from starmodel.plans import marts, shapes, warehouse
from starmodel.plans.warehouse import FACT, PRODUCT_DIMS, SALESPERSON_DIMS, apply_sql
from starmodel.sources.schema import STAGING, required
from starmodel.sources.shared import materialize, scratch, shared_dir
from starmodel.sources.store import SnapshotStore
from starmodel.sources.tables import read_parquet
from starmodel.streaming import late_stream, scd_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, directory) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet(spark, d, name)


def _span(spark: SparkSession, d: str) -> tuple[dt.date, dt.date]:
    first, last = _table(spark, d, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    return first, last


# Sources, calendar, functions


@query("SELECT id AS ProductID, name AS Name, number AS ProductNumber, color AS Color, CAST(price AS DOUBLE) AS ListPrice, sub AS ProductSubcategoryID FROM (" + shapes._PRODUCT_V1 + ")")
def s1_source_scan(spark, d):
    return shapes.product_source(spark, d).select("ProductID", "Name", "ProductNumber", "Color", F.col("ListPrice").cast("double").alias("ListPrice"), "ProductSubcategoryID")


_CALENDAR = """
    SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS DateKey, d AS FullDate, isodow(d) AS DayNumberOfWeek, dayname(d) AS DayName, dayname(d)[:3] AS DayShortName, day(d) AS DayNumberOfMonth, dayofyear(d) AS DayNumberOfYear,
        weekofyear(d) AS WeekNumberOfYear, month(d) AS MonthNumber, monthname(d) AS MonthName, monthname(d)[:3] AS MonthShortName, strftime(d, '%Y-%m') AS YearMonth, year(d) * 100 + month(d) AS YearMonthNumber,
        quarter(d) AS QuarterNumber, 'Q' || quarter(d) AS QuarterName, year(d) || '-Q' || quarter(d) AS YearQuarter, year(d) * 10 + quarter(d) AS YearQuarterNumber,
        CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS SemesterNumber, CASE WHEN month(d) <= 6 THEN 'S1' ELSE 'S2' END AS SemesterName, year(d) AS CalendarYear, isodow(d) IN (6, 7) AS IsWeekend, isodow(d) < 6 AS IsWeekday
    FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)"""


@query(_CALENDAR)
def c9_calendar(spark, d):
    return calendar.date_dim(spark, *_span(spark, d))


@query(_CALENDAR)
def j7_append_missing_dates(spark, d):
    """Every other day is there already; the others are added."""
    whole = calendar.date_dim(spark, *_span(spark, d))
    return calendar.append_missing_dates(whole.where(F.col("DateKey") % 2 == 0), whole)


@query("""
    SELECT o_orderkey, nullif(trim(' ' || o_orderpriority || ' '), '') AS trimmed, concat_ws(' ', nullif(o_orderstatus, 'O'), o_orderpriority) AS joined, concat(nullif(o_orderstatus, 'O'), '-', o_orderpriority) AS concatenated,
        CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS VARCHAR) AS money_text, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS flag_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_text, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key,
        year(TIMESTAMP '2001-12-31') - year(o_orderdate) AS years, left(o_orderpriority, 4) AS prefix, o_orderstatus IS DISTINCT FROM 'F' AS differs, CASE WHEN o_totalprice <> 0 THEN (o_totalprice - 1000) / o_totalprice * 100 END AS margin
    FROM orders""")
def f_scalar_functions(spark, d):
    o = _table(spark, d, "orders")
    c = F.col
    not_o = F.nullif(c("o_orderstatus"), F.lit("O"))
    money = o.select(c("o_totalprice").cast("decimal(19,4)").alias("m")).schema["m"].dataType
    flag = (c("o_orderstatus") == "F").alias("x")
    return o.select(
        "o_orderkey", clean.blank_to_null(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("trimmed"), F.concat_ws(" ", not_o, c("o_orderpriority")).alias("joined"), clean.join_text(not_o, F.lit("-"), c("o_orderpriority")).alias("concatenated"),
        clean.as_text(c("o_totalprice").cast("decimal(19,4)"), money).alias("money_text"), clean.as_text(flag, o.select(flag).schema["x"].dataType).alias("flag_text"), clean.as_text(c("o_orderdate"), o.schema["o_orderdate"].dataType).alias("iso_text"),
        clean.date_key(c("o_orderdate")).alias("date_key"), clean.years_apart(c("o_orderdate"), F.lit("2001-12-31").cast("timestamp_ntz")).alias("years"), clean.first_chars(c("o_orderpriority"), 4).alias("prefix"),
        clean.differs(c("o_orderstatus"), F.lit("F")).alias("differs"), clean.margin_pct(c("o_totalprice"), F.lit(1000.0)).alias("margin"),
    )


@query("SELECT p_partkey, sha256(concat('p_name=', p_name, '|p_size=', CAST(p_size AS VARCHAR), '|p_brand=', coalesce(nullif(p_brand, 'Brand#2'), '<NULL>'))) AS named, sha256(concat('|p_name=', p_name)) AS lead FROM part")
def c4_row_hash(spark, d):
    p = _table(spark, d, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#2")))
    return p.select("p_partkey", row_hash(p, ["p_name", "p_size", "p_brand"]).alias("named"), row_hash(p, ["p_name"], lead=True).alias("lead"))


# Staging


@query(shapes.product_sql(1))
def c5_stage_product(spark, d):
    return shapes.staged_product(spark, d).drop("ExtractedAt")


@query(shapes.CUSTOMER_SQL)
def c6_stage_customer(spark, d):
    return shapes.staged_customer(spark, d).drop("ExtractedAt")


@query(shapes.TERRITORY_SQL)
def c7_stage_territory(spark, d):
    return shapes.staged_territory(spark, d)[0].drop("ExtractedAt")


@query(shapes.TERRITORY_REJECTS_SQL)
def j12_territory_rejects(spark, d):
    return shapes.staged_territory(spark, d)[1].select("TerritoryID", F.array_join("reject_reasons", "; ").alias("reasons"))


@query(shapes.salesperson_sql(1))
def c8_stage_salesperson(spark, d):
    return shapes.staged_salesperson(spark, d)[0].drop("ExtractedAt")


@query("SELECT s_suppkey AS BusinessEntityID, CASE WHEN s_suppkey % 13 = 12 THEN 'no such person' ELSE 'no such employee' END AS reason FROM supplier WHERE s_suppkey % 13 = 12 OR s_suppkey % 17 = 16")
def j12_salesperson_rejects(spark, d):
    return shapes.staged_salesperson(spark, d)[1].select("BusinessEntityID", F.col("reject_reasons")[0].alias("reason"))


# Dimensions

_VERSION = "CAST(StandardCost AS DOUBLE) AS StandardCost, CAST(ListPrice AS DOUBLE) AS ListPrice, SubcategoryName, CategoryName, SourceModifiedDate, RowHash, Start, Finish, Cur"


def _versions(dim: DataFrame) -> DataFrame:
    return dim.select(
        F.col("ProductKey").alias("k"), "ProductID", "ProductName", "ProductNumber", "Color", "Size", F.col("StandardCost").cast("double").alias("StandardCost"), F.col("ListPrice").cast("double").alias("ListPrice"),
        "SubcategoryName", "CategoryName", "SourceModifiedDate", "RowHash", F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"),
    )


@query(f"{PRODUCT_DIMS} SELECT k, ProductID, ProductName, ProductNumber, Color, Size, {_VERSION} FROM dim3")
def c1_product_dim(spark, d):
    return _versions(warehouse.product_dim(spark, d)[1])


@query(f"{PRODUCT_DIMS} SELECT 'v2' AS load, a AS action, count(*) AS n FROM act2 GROUP BY a UNION ALL SELECT 'v3', a, count(*) FROM act3 GROUP BY a")
def a2_load_actions(spark, d):
    _, dim2, two = warehouse.product_dim(spark, d, 2)
    _, three = scd.apply_scd(dim2, shapes.staged_product(spark, d, 3), scd.PRODUCT, shapes.LOADS[2])
    both = two.withColumn("load", F.lit("v2")).unionByName(three.withColumn("load", F.lit("v3")))
    return both.where("n > 0").select("load", "action", "n")


@query(f"{PRODUCT_DIMS} SELECT count(*) FILTER (a <> 'keep') AS rows_read, count(*) FILTER (a IN ('new', 't2')) AS rows_inserted, count(*) FILTER (a IN ('t1', 't2')) AS rows_updated FROM act3")
def a2_load_totals(spark, d):
    return scd.totals(warehouse.product_dim(spark, d)[2])


@query(f"{PRODUCT_DIMS} SELECT k, ProductID, ProductName, ProductNumber, Color, Size, {_VERSION} FROM dim2")
def c13_rerun_changes_nothing(spark, d):
    """The second snapshot is loaded twice."""
    dim = warehouse.product_dim(spark, d, 2)[1]
    return _versions(scd.apply_scd(dim, shapes.staged_product(spark, d, 2), scd.PRODUCT, dt.datetime(1998, 1, 1))[0])


@query(f"SELECT row_number() OVER (ORDER BY CustomerID) AS CustomerKey, CustomerID, CustomerType, CustomerName, SourceModifiedDate, RowHash FROM ({shapes.CUSTOMER_SQL})")
def c2_customer_dim(spark, d):
    return warehouse.customer_dim(spark, d).select("CustomerKey", "CustomerID", "CustomerType", "CustomerName", "SourceModifiedDate", "RowHash")


@query(f"SELECT row_number() OVER (ORDER BY TerritoryID) AS TerritoryKey, TerritoryID, TerritoryName, CountryRegionCode, CountryRegionName, TerritoryGroup FROM ({shapes.TERRITORY_SQL})")
def c1_territory_dim(spark, d):
    return warehouse.territory_dim(spark, d).select("TerritoryKey", "TerritoryID", "TerritoryName", "CountryRegionCode", "CountryRegionName", "TerritoryGroup")


@query(f"{SALESPERSON_DIMS} SELECT k, BusinessEntityID, SalesPersonName, FirstName, MiddleName, JobTitle, HireDate, CAST(SalesQuota AS DOUBLE) AS SalesQuota, RowHash, Start, Finish, Cur FROM dim2")
def c3_salesperson_dim(spark, d):
    dim = warehouse.salesperson_dim(spark, d)
    return dim.select(
        F.col("SalesPersonKey").alias("k"), "BusinessEntityID", "SalesPersonName", "FirstName", "MiddleName", "JobTitle", "HireDate", F.col("SalesQuota").cast("double").alias("SalesQuota"), "RowHash",
        F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"),
    )


@query(f"{PRODUCT_DIMS} SELECT ProductID, k AS ProductKey, ProductName, CAST(ListPrice AS DOUBLE) AS ListPrice FROM dim3 WHERE Cur")
def c17_current_members(spark, d):
    return scd.current_members(warehouse.product_dim(spark, d)[1], scd.PRODUCT).select("ProductID", "ProductKey", "ProductName", F.col("ListPrice").cast("double").alias("ListPrice"))


@query(f"{PRODUCT_DIMS} SELECT count(*) AS members, count(*) FILTER (k = -1) AS unknown, min(k) AS least FROM (SELECT k FROM dim3 UNION ALL SELECT -1)")
def c21_unknown_member(spark, d):
    dim = scd.with_unknown_member(warehouse.product_dim(spark, d)[1], scd.PRODUCT)
    return dim.agg(F.count("*").alias("members"), F.sum((F.col("ProductKey") == -1).cast("long")).alias("unknown"), F.min("ProductKey").alias("least"))


@query("SELECT p_partkey, p_name, 100 + row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS key FROM part")
def w2_surrogate_keys(spark, d):
    return scd.assign_keys(_table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "key", 100)


@query("SELECT c_mktsegment AS name, row_number() OVER (ORDER BY c_mktsegment) AS key FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def c22_small_dimension(spark, d):
    """A dimension with no more than a name, as for ways of shipping."""
    spec = scd.DimensionSpec("segment", "name", "key")
    staged = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("1995-01-01").cast("timestamp_ntz").alias("SourceModifiedDate")).distinct()
    staged = staged.withColumn("RowHash", F.sha2("name", 256))
    return scd.apply_scd(scd.empty_dimension(staged, spec), staged, spec, shapes.LOADS[0])[0].select("name", "key")


def _again(df: DataFrame, rest: int, **changed) -> DataFrame:
    """Some rows once more, with other values."""
    return df.where(F.col("ProductID") % 10 == rest).withColumns(changed)


@query("""WITH n AS (SELECT p_partkey % 10 AS m, count(*) AS n FROM part GROUP BY 1) SELECT m + 1 AS ExecutionID, 'Failed' AS Status, 'ValueError: ' || n || ' staged keys of product are null or repeated' AS ErrorMessage FROM n WHERE m BETWEEN 1 AND 5
    UNION ALL SELECT 7, 'Failed', 'ValueError: 1 staged keys of product are null or repeated' UNION ALL SELECT 1, 'Succeeded', NULL UNION ALL SELECT 8, 'Succeeded', NULL""")
def c1_repeated_keys(spark, d):
    """Staging in which keys are repeated by rows that would do the same, or
    different things, or are null: each load fails, and is logged; the dimension
    stays, so a good load after them finds nothing to do. The parts are staged once
    and written; all loads start from these files."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    with scratch(spark):
        _repeated_loads(store, materialize(shapes.staged_product(spark, d, 1), "good"))
    return runlog.run_state(load.run_log(store)).select("ExecutionID", "Status", "ErrorMessage")


def _repeated_loads(store: SnapshotStore, good: DataFrame) -> None:
    name, hash_ = F.concat("ProductName", F.lit(" x")), F.sha2(F.concat("RowHash", F.lit("x")), 256)
    three = F.col("ProductID") % 10 == 3
    loads = [
        good,
        good.union(_again(good, 1)),  # same, same
        good.union(_again(good, 2, RowHash=hash_)),  # same, t2
        good.where(~three).union(_again(good, 3, ProductName=name)).union(_again(good, 3, RowHash=hash_)),  # t1, t2
        good.union(_again(good, 4, ProductName=name)),  # same, t1
        good.union(_again(good, 5, ProductID=F.col("ProductID") + 5_000_000)).union(_again(good, 5, ProductID=F.col("ProductID") + 5_000_000, ProductName=name)),  # new, new
        good.withColumn("ProductID", F.when(F.col("ProductID") % 10 != 6, F.col("ProductID"))),
        good,
    ]
    for i, rows in enumerate(loads, 1):
        try:
            load.run_load(store, scd.PRODUCT, i, "part", lambda rows=rows: (rows, None), shapes.LOADS[0] + dt.timedelta(days=i))
        except ValueError:
            pass  # it is in the log


# Lookups and the fact


@query(f"{FACT} SELECT SalesOrderID, SalesOrderDetailID, ProductID, ProductKey, count(*) AS n FROM fact GROUP BY ALL")
def j10_point_in_time(spark, d):
    detail, header = shapes.order_sources(spark, d)
    lines = detail.join(header.select("SalesOrderID", "OrderDate"), "SalesOrderID")
    found = lookup.lookup_key(lines, warehouse.product_dim(spark, d)[1], scd.PRODUCT, "ProductID", "OrderDate")
    return found.groupBy("SalesOrderID", "SalesOrderDetailID", "ProductID", "ProductKey").agg(F.count("*").alias("n"))


@query(f"""{PRODUCT_DIMS} SELECT k AS ProductKey, count(*) AS n FROM ({shapes.LINES_SQL}) l
    JOIN (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ProductID ORDER BY Start) = 1 THEN TIMESTAMP '0001-01-01' ELSE Start END AS b FROM dim3) v ON v.ProductID = l.ProductID AND OrderDate >= b AND OrderDate < Finish GROUP BY k""")
def j10_before_first_version(spark, d):
    detail, header = shapes.order_sources(spark, d)
    lines = detail.join(header.select("SalesOrderID", "OrderDate"), "SalesOrderID")
    found = lookup.lookup_key(lines, warehouse.product_dim(spark, d)[1], scd.PRODUCT, "ProductID", "OrderDate", before_first="first_version")
    return found.groupBy("ProductKey").agg(F.count("*").alias("n"))


@query(f"{FACT} SELECT SalesOrderID, SalesOrderDetailID, ProductID, ProductKey, SalesPersonKey, count(*) AS n FROM fact GROUP BY ALL")
def j10_as_of(spark, d):
    """The keys of the versions of products and sales persons with no dimension
    taken as small: lines and versions are joined by a shuffle, and versions of keys that
    have many would be carried forward."""
    detail, header = shapes.order_sources(spark, d)
    lines = detail.join(header.select("SalesOrderID", "OrderDate", "SalesPersonID"), "SalesOrderID")
    found = lookup.lookup_key(lines, warehouse.product_dim(spark, d)[1], scd.PRODUCT, "ProductID", "OrderDate", small=0)
    found = lookup.lookup_key(found, warehouse.salesperson_dim(spark, d), scd.SALESPERSON, "SalesPersonID", "OrderDate", small=0)
    return found.groupBy("SalesOrderID", "SalesOrderDetailID", "ProductID", "ProductKey", "SalesPersonKey").agg(F.count("*").alias("n"))


_FACT_COLUMNS = "SalesOrderID, SalesOrderDetailID, ProductKey, CustomerKey, SalesPersonKey, TerritoryKey, OrderDateKey, DueDateKey, ShipDateKey, OrderQty, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("UnitPrice", "GrossAmount", "DiscountAmount", "NetAmount", "TotalCost", "GrossProfit"))


@query(f"{FACT} SELECT {_FACT_COLUMNS} FROM fact")
def c14_fact(spark, d):
    out = warehouse.sales_fact(spark, d)
    money = ("UnitPrice", "GrossAmount", "DiscountAmount", "NetAmount", "TotalCost", "GrossProfit")
    return out.select("SalesOrderID", "SalesOrderDetailID", "ProductKey", "CustomerKey", "SalesPersonKey", "TerritoryKey", "OrderDateKey", "DueDateKey", "ShipDateKey", "OrderQty", *[F.col(c).cast("double").alias(c) for c in money])


@query("""SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS OrderDateKey, CAST(strftime(o_orderdate + INTERVAL 12 DAY, '%Y%m%d') AS INT) AS DueDateKey,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(strftime(o_orderdate + INTERVAL 7 DAY, '%Y%m%d') AS INT) ELSE -1 END AS ShipDateKey FROM orders""")
def j13_role_dates(spark, d):
    header = shapes.order_sources(spark, d)[1]
    return header.select(F.col("SalesOrderID").alias("o_orderkey"), *[lookup.role_date_key(c).alias(f"{c}Key") for c in ("OrderDate", "DueDate", "ShipDate")])


@query(f"""{FACT} SELECT strftime(OrderDate, '%Y-%m') AS OrderMonth, count(*) AS Lines, CAST(sum(CASE WHEN OrderDate >= TIMESTAMP '1997-04-01' AND OrderDate < TIMESTAMP '1997-05-01' THEN 2 * NetAmount ELSE NetAmount END) AS DOUBLE) AS NetAmount
    FROM fact WHERE SalesOrderDetailID <> 1 OR OrderDate < TIMESTAMP '1997-05-01' OR OrderDate >= TIMESTAMP '1997-06-01' GROUP BY 1""")
def s11_late_months(spark, d):
    """After the fact is published two months change: the lines of one count
    double, of the other some are gone. Only these months are published again."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    lines = warehouse.sales_fact(spark, d)
    fact.publish(store, "sales", lines)
    month = F.date_format("OrderDate", "yyyy-MM")
    late = lines.withColumn("NetAmount", F.when(month == "1997-04", F.col("NetAmount") * 2).otherwise(F.col("NetAmount"))).where((month != "1997-05") | (F.col("SalesOrderDetailID") != 1))
    fact.publish(store, "sales", late, ["1997-04", "1997-05"])
    return store.read("sales").groupBy("OrderMonth").agg(F.count("*").alias("Lines"), F.sum("NetAmount").cast("double").alias("NetAmount"))


@query(f"{FACT} SELECT strftime(OrderDate, '%Y-%m') AS OrderMonth, count(*) AS Lines, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount FROM fact WHERE OrderDate >= TIMESTAMP '1997-03-01' AND OrderDate < TIMESTAMP '1997-05-01' GROUP BY 1")
def s11_publish(spark, d):
    """The fact is published in folders by order month; two of them are read."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    fact.publish(store, "sales", warehouse.sales_fact(spark, d))
    part = store.read("sales").where(F.col("OrderMonth").between("1997-03", "1997-04"))
    return part.groupBy("OrderMonth").agg(F.count("*").alias("Lines"), F.sum("NetAmount").cast("double").alias("NetAmount"))


@query(f"{PRODUCT_DIMS} SELECT v, n, current FROM (SELECT 1 AS v, count(*) AS n, count(*) FILTER (Cur) AS current FROM dim1 UNION ALL SELECT 2, count(*), count(*) FILTER (Cur) FROM dim2)")
def s4_snapshots(spark, d):
    """Two loads are written as versions of a table, laid out by what is current."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    first = warehouse.product_dim(spark, d, 1)[1]
    store.write("product", first, [scd.CURRENT])
    store.write("product", scd.apply_scd(store.read("product").select(*scd.PRODUCT.columns), shapes.staged_product(spark, d, 2), scd.PRODUCT, shapes.LOADS[1])[0], [scd.CURRENT])
    both = [store.read("product", v).agg(F.lit(v).alias("v"), F.count("*").alias("n"), F.sum(F.col(scd.CURRENT).cast("long")).alias("current")) for v in store.versions("product")]
    return quality.all_of(both)


_FEW = apply_sql([shapes.product_sql(1), f"SELECT * FROM ({shapes.product_sql(2)}) WHERE ProductID % 100 IN (0, 1)", f"SELECT * FROM ({shapes.product_sql(1)}) WHERE ProductID % 100 IN (0, 2)"], "ProductID", ["ProductName", "ProductNumber"], list(scd.PRODUCT.type2), modified_counts=True)


@query(f"{_FEW} SELECT 3 AS v, k, ProductID, ProductName, ListPrice::DOUBLE AS ListPrice, Start, Finish, Cur FROM dim3 UNION ALL SELECT 2, k, ProductID, ProductName, ListPrice::DOUBLE, Start, Finish, Cur FROM dim2")
def s6_touched_buckets(spark, d):
    """A whole load and two of a few products, which write their buckets only; the
    last two versions of the dimension are read."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    m = F.col("ProductID") % 100
    staged = [shapes.staged_product(spark, d, 1), shapes.staged_product(spark, d, 2).where(m.isin(0, 1)), shapes.staged_product(spark, d, 3).where(m.isin(0, 2))]
    for v, rows in enumerate(staged, 1):
        load.run_load(store, scd.PRODUCT, v, "part", lambda rows=rows: (rows, None), shapes.LOADS[v - 1])
    return quality.all_of([_versions(store.read("product", v)).select(F.lit(v).alias("v"), "k", "ProductID", "ProductName", "ListPrice", "Start", "Finish", "Cur") for v in (3, 2)])


# Marts

_SUMS = "CAST(sum(GrossAmount) AS DOUBLE) AS GrossAmount, CAST(sum(DiscountAmount) AS DOUBLE) AS DiscountAmount, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount"


@query(f"""{FACT} SELECT year(OrderDate) AS CalendarYear, coalesce(v.CategoryName, 'Unknown') AS CategoryName, count(DISTINCT SalesOrderID) AS Orders, count(*) AS Lines, sum(OrderQty) AS Quantity, {_SUMS}, avg(CAST(NetAmount AS DOUBLE)) AS AverageNet
    FROM fact LEFT JOIN dim3 v ON v.k = ProductKey GROUP BY ALL""")
def c18_sales_summary(spark, d):
    """Net sales by year and category; lines of the unknown product as Unknown."""
    lines = marts.with_dates(warehouse.sales_fact(spark, d, attributes=("CategoryName",)), calendar.date_dim(spark, *_span(spark, d)))
    return marts.sales_summary(lines.withColumn("CategoryName", F.coalesce("CategoryName", F.lit("Unknown"))), ["CalendarYear", "CategoryName"])


@query(f"""{FACT} SELECT *, CASE WHEN NetAmount <> 0 THEN (NetAmount - TotalCost) / NetAmount * 100 END AS MarginPct FROM (SELECT ProductID, sum(OrderQty) AS Quantity, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount, CAST(sum(TotalCost) AS DOUBLE) AS TotalCost,
    CAST(sum(GrossProfit) AS DOUBLE) AS GrossProfit FROM (SELECT v.ProductID, OrderQty, NetAmount, TotalCost, GrossProfit FROM fact JOIN dim3 v ON v.k = ProductKey) GROUP BY ProductID)""")
def c19_product_performance(spark, d):
    dim = warehouse.product_dim(spark, d)[1]
    lines = warehouse.sales_fact(spark, d, dim).where("ProductKey >= 0").join(dim.select("ProductKey", "ProductID"), "ProductKey")
    return marts.product_performance(lines, ["ProductID"])


@query(f"{FACT} SELECT OrderDateKey, count(*) AS Lines, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount FROM fact WHERE OrderDateKey >= 19970101 AND OrderDateKey < 19980101 GROUP BY OrderDateKey")
def c20_sales_by_date_range(spark, d):
    return marts.sales_by_date_range(warehouse.sales_fact(spark, d), 19970101, 19980101)


@query(f"""{FACT} SELECT year(OrderDate) AS CalendarYear, quarter(OrderDate) AS QuarterNumber, count(*) AS Lines, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount, grouping(year(OrderDate)) + grouping(quarter(OrderDate)) AS Level
    FROM fact GROUP BY ROLLUP (year(OrderDate), quarter(OrderDate))""")
def a9_date_hierarchy(spark, d):
    lines = marts.with_dates(warehouse.sales_fact(spark, d), calendar.date_dim(spark, *_span(spark, d)), columns=("CalendarYear", "QuarterNumber"))
    return marts.hierarchy(lines, ["CalendarYear", "QuarterNumber"])


@query(f"""{FACT} SELECT coalesce(year(ShipDate), -1) AS CalendarYear, coalesce('Q' || quarter(ShipDate), 'Unknown') AS QuarterName, count(*) AS Lines, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount FROM fact GROUP BY ALL""")
def c18_sales_by_ship_quarter(spark, d):
    """By the date of shipping; lines that aren't shipped yet are under the unknown date."""
    first, last = _span(spark, d)
    days = calendar.with_unknown_date(calendar.date_dim(spark, first, last + dt.timedelta(days=31)))
    lines = marts.with_dates(warehouse.sales_fact(spark, d), days, "ShipDateKey", ("CalendarYear", "QuarterName"))
    return lines.groupBy("CalendarYear", "QuarterName").agg(F.count("*").alias("Lines"), F.sum("NetAmount").cast("double").alias("NetAmount"))


def _rollup_sql(levels: list[str], join: str) -> str:
    names = ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in levels)
    return f"""{FACT}, named AS (SELECT NetAmount, {names} FROM fact {join})
        SELECT {", ".join(levels)}, count(*) AS Lines, CAST(sum(NetAmount) AS DOUBLE) AS NetAmount, {" + ".join(f"grouping({c})" for c in levels)} AS Level FROM named GROUP BY ROLLUP ({", ".join(levels)})"""


@query(_rollup_sql(["TerritoryGroup", "CountryRegionName", "TerritoryName"], "LEFT JOIN (SELECT tk, TerritoryGroup, CountryRegionName, TerritoryName FROM tdim) ON tk = TerritoryKey"))
def a9_territory_hierarchy(spark, d):
    dim = scd.with_unknown_member(warehouse.territory_dim(spark, d), scd.TERRITORY)
    levels = ["TerritoryGroup", "CountryRegionName", "TerritoryName"]
    return marts.hierarchy(lookup.as_was(warehouse.sales_fact(spark, d), dim, scd.TERRITORY, tuple(levels)), levels)


@query(_rollup_sql(["CategoryName", "SubcategoryName"], "LEFT JOIN (SELECT k, CategoryName, SubcategoryName FROM dim3) v ON v.k = ProductKey"))
def a9_product_hierarchy(spark, d):
    dim = scd.with_unknown_member(warehouse.product_dim(spark, d)[1], scd.PRODUCT)
    levels = ["CategoryName", "SubcategoryName"]
    return marts.hierarchy(lookup.as_was(warehouse.sales_fact(spark, d), dim, scd.PRODUCT, tuple(levels)), levels)


@query(f"{FACT} SELECT CustomerKey, CAST(net AS DOUBLE) AS NetAmount, rank() OVER (ORDER BY net DESC) AS Rank, dense_rank() OVER (ORDER BY net DESC) AS DenseRank FROM (SELECT CustomerKey, sum(NetAmount) AS net FROM fact WHERE CustomerKey >= 0 GROUP BY 1) QUALIFY Rank <= 100")
def w5_ranked_customers(spark, d):
    return marts.ranked_customers(warehouse.sales_fact(spark, d), top=100)


@query(f"{FACT} SELECT CustomerKey, CAST(net AS DOUBLE) AS NetAmount, rank() OVER (ORDER BY net DESC) AS Rank, dense_rank() OVER (ORDER BY net DESC) AS DenseRank FROM (SELECT CustomerKey, sum(NetAmount) AS net FROM fact WHERE CustomerKey >= 0 GROUP BY 1)")
def w5_all_customers(spark, d):
    return marts.ranked_customers(warehouse.sales_fact(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity DESC) AS Rank, dense_rank() OVER (ORDER BY l_quantity DESC) AS DenseRank FROM lineitem")
def w5_ranked_lines(spark, d):
    """All order lines by quantity, of which there are few: each is shared by many lines."""
    return ordered.ranked(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_returnflag HAVING sum(CAST(l_quantity AS BIGINT)) > 10")
def a4_filtered_sums(spark, d):
    """A filter on bare columns, a grouped sum, and a filter on the sum."""
    li = _table(spark, d, "lineitem")
    part = li.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return part.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity")).where("quantity > 10")


@query("""SELECT o_custkey, orders FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) WHERE orders > (SELECT count(*) * 1.0 / count(DISTINCT o_custkey) FROM orders)""")
def a6_two_levels(spark, d):
    """Customers with more orders than the average."""
    n = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("orders").alias("mean")))).where("orders > mean").drop("mean")  # one row is crossed in


@query("""SELECT CAST(sum(t) AS DOUBLE) AS SubTotal, CAST(sum(CAST(t * CAST('0.08' AS DECIMAL(3,2)) AS DECIMAL(19,4))) AS DOUBLE) AS TaxAmt, CAST(sum(CAST(t * CAST('0.025' AS DECIMAL(4,3)) AS DECIMAL(19,4))) AS DOUBLE) AS Freight
    FROM (SELECT CAST(o_totalprice AS DECIMAL(19,4)) AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def a8_header_measures(spark, d):
    detail, header = shapes.order_sources(spark, d)
    out = fact.header_totals(detail.join(header, "SalesOrderID"), ("SubTotal", "TaxAmt", "Freight"))
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns])


@query("""SELECT has_person, has_store, count(*) AS n FROM (SELECT c_custkey % 11 <> 0 AS has_person, c_custkey % 3 = 0 AS has_store FROM customer) GROUP BY ALL""")
def a10_customer_configurations(spark, d):
    c = shapes.customer_sources(spark, d)[0]
    return marts.profile(c, {"has_person": F.col("PersonID").isNotNull(), "has_store": F.col("StoreID").isNotNull()})


@query(f"""WITH p AS ({shapes._PRODUCT_V1}) SELECT 'ProductID' AS column, count(*) AS rows, count(DISTINCT id) AS distinct_values, count(*) - count(id) AS nulls FROM p UNION ALL SELECT 'Color', count(*), count(DISTINCT color), count(*) - count(color) FROM p
    UNION ALL SELECT 'SellEndDate', count(*), count(DISTINCT sell_end), count(*) - count(sell_end) FROM p""")
def a10_product_profile(spark, d):
    return marts.profile_columns(shapes.product_source(spark, d), ["ProductID", "Color", "SellEndDate"])


@query("""WITH p AS (SELECT unnest([{'c': 'l_orderkey', 'd': count(DISTINCT l_orderkey)}, {'c': 'l_partkey', 'd': count(DISTINCT l_partkey)}, {'c': 'l_extendedprice', 'd': count(DISTINCT l_extendedprice)}, {'c': 'l_shipdate', 'd': count(DISTINCT l_shipdate)}]) AS x FROM lineitem)
    SELECT x.c AS column, (SELECT count(*) FROM lineitem) AS rows, 0 AS nulls, true AS within FROM p""")
def a10_sketched_profile(spark, d):
    """Sketches of three loads of order lines, merged; distinct values are within
    4 % of the exact numbers."""
    li, columns = _table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"]
    loads = [marts.column_sketches(li.where(F.col("l_linenumber") % 3 == n), columns, f"load {n}") for n in range(3)]
    found = marts.sketched_profile(quality.all_of(loads))
    exact = marts.profile_columns(li, columns).select("column", F.col("distinct_values").alias("exact"))
    return found.join(F.broadcast(exact), "column").select("column", "rows", "nulls", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.04 * F.col("exact")).alias("within"))


_AS = "CAST(sum(NetAmount) AS DOUBLE) AS NetAmount FROM fact JOIN dim3 v ON v.k = ProductKey"


@query(f"{FACT} SELECT CAST(v.ListPrice AS DOUBLE) AS ListPrice, {_AS} GROUP BY v.ListPrice")
def c23_as_was(spark, d):
    dim = warehouse.product_dim(spark, d)[1]
    lines = lookup.as_was(warehouse.sales_fact(spark, d, dim).where("ProductKey >= 0"), dim, scd.PRODUCT, ("ListPrice",))
    return lines.groupBy("ListPrice").agg(F.sum("NetAmount").cast("double").alias("NetAmount")).withColumn("ListPrice", F.col("ListPrice").cast("double"))


@query(f"{FACT} SELECT CAST(c.ListPrice AS DOUBLE) AS ListPrice, {_AS} JOIN dim3 c ON c.ProductID = v.ProductID AND c.Cur GROUP BY c.ListPrice")
def c23_as_is(spark, d):
    dim = warehouse.product_dim(spark, d)[1]
    lines = lookup.as_is(warehouse.sales_fact(spark, d, dim).where("ProductKey >= 0"), dim, scd.PRODUCT, ("ListPrice",))
    return lines.groupBy("ListPrice").agg(F.sum("NetAmount").cast("double").alias("NetAmount")).withColumn("ListPrice", F.col("ListPrice").cast("double"))


# Quality


@query("SELECT 'required' AS check, CAST(id AS VARCHAR) AS key, 'SellEndDate' AS detail FROM (" + shapes._PRODUCT_V1 + ") WHERE sell_end IS NULL UNION ALL SELECT 'required', CAST(id AS VARCHAR), 'Color' FROM (" + shapes._PRODUCT_V1 + ") WHERE color IS NULL")
def q1_required(spark, d):
    return quality.check_required(shapes.staged_product(spark, d), ["ProductID"], ["SellEndDate", "Color", *required(STAGING["product"])])


@query("SELECT 'unique' AS check, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def q2_unique_grain(spark, d):
    return quality.check_unique(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'non_negative' AS check, CAST(s_suppkey AS VARCHAR) AS key, 's_acctbal' AS detail FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'non_negative', CAST(c_custkey AS VARCHAR), 'c_acctbal' FROM customer WHERE c_acctbal < 0")
def q3_non_negative(spark, d):
    return quality.all_of([quality.check_non_negative(_table(spark, d, "supplier"), ["s_suppkey"], ["s_acctbal"]), quality.check_non_negative(_table(spark, d, "customer"), ["c_custkey"], ["c_acctbal"])])


@query("SELECT 'accepted' AS check, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def q4_accepted_values(spark, d):
    return quality.check_accepted(_table(spark, d, "orders"), ["o_orderkey"], "o_orderstatus", ["F", "O"])


@query(f"""WITH cal AS ({_CALENDAR}), kept AS (SELECT * FROM cal WHERE DateKey % 50 <> 7) SELECT 'calendar' AS check, CAST(DateKey AS VARCHAR) AS key, 'MonthNumber' AS detail FROM kept WHERE DayNumberOfYear = 60
    UNION ALL SELECT 'calendar', CAST(DateKey AS VARCHAR), 'IsWeekend' FROM kept WHERE DayNumberOfYear = 61 AND NOT IsWeekend
    UNION ALL SELECT 'calendar_complete', strftime(FullDate, '%Y%m%d'), CAST(step AS VARCHAR) FROM (SELECT FullDate, lead(FullDate) OVER (ORDER BY FullDate) - FullDate AS step FROM kept) WHERE step <> 1""")
def q5_calendar(spark, d):
    """A calendar with days left out, months out of range, and weekdays that are weekends."""
    whole = calendar.date_dim(spark, *_span(spark, d)).where(F.col("DateKey") % 50 != 7)
    day = F.col("DayNumberOfYear")
    broken = whole.withColumns({"MonthNumber": F.when(day == 60, 13).otherwise(F.col("MonthNumber")), "IsWeekend": (day == 61) | F.col("IsWeekend")})
    return quality.all_of([quality.check_calendar(broken), quality.check_calendar_complete(broken)])


@query("SELECT 'calendar_complete' AS check, strftime(d, '%Y%m%d') AS key, CAST(step AS VARCHAR) AS detail FROM (SELECT d, lead(d) OVER (ORDER BY d) - d AS step FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE step <> 1")
def q18_days_without_orders(spark, d):
    days = _table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("FullDate")).distinct()
    return quality.check_calendar_complete(days.withColumn("DateKey", clean.date_key(F.col("FullDate"))))


@query("SELECT 'order' AS check, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate GROUP BY o_orderkey")
def q6_order_of_dates(spark, d):
    both = _table(spark, d, "orders").join(_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return quality.check_order(both, ["o_orderkey"], "o_orderdate", "l_shipdate", strict=False).groupBy("check", "key").agg(F.count("*").alias("n"))


@query(f"""{PRODUCT_DIMS}, broken AS (SELECT k, ProductID, CASE WHEN ProductID % 20 = 4 THEN Finish ELSE Start END AS Start, Finish, Cur AND ProductID % 20 <> 6 OR ProductID % 20 = 8 AS Cur FROM dim3),
    n AS (SELECT *, lead(Start) OVER (PARTITION BY ProductID ORDER BY Start, k) AS nxt FROM broken)
    SELECT 'current_open' AS check, CAST(k AS VARCHAR) AS key, strftime(Finish, '%Y-%m-%d %H:%M:%S') || CASE WHEN year(Finish) = 9999 THEN '.999999' ELSE '' END AS detail FROM broken WHERE Cur <> (year(Finish) = 9999)
    UNION ALL SELECT 'one_current', CAST(ProductID AS VARCHAR), CAST(count(*) FILTER (Cur) AS VARCHAR) FROM broken GROUP BY ProductID HAVING count(*) FILTER (Cur) <> 1
    UNION ALL SELECT 'intervals', CAST(k AS VARCHAR), CASE WHEN Finish > nxt THEN 'overlap' ELSE 'gap' END FROM n WHERE Finish <> nxt
    UNION ALL SELECT 'order', CAST(k AS VARCHAR), 'same' FROM broken WHERE Start >= Finish""")
def q7_q10_dimension(spark, d):
    """A dimension in which some products have no current version, or all are
    current, or versions begin when they end."""
    dim, m = warehouse.product_dim(spark, d)[1], F.col("ProductID") % 20
    dim = dim.withColumns({scd.START: F.when(m == 4, F.col(scd.END)).otherwise(F.col(scd.START)), scd.CURRENT: (F.col(scd.CURRENT) & (m != 6)) | (m == 8)})
    order = quality.check_order(dim, ["ProductKey"], scd.START, scd.END).withColumn("detail", F.lit("same"))
    return quality.all_of([quality.check_current_open(dim, scd.PRODUCT), quality.check_one_current(dim, scd.PRODUCT), quality.check_intervals(dim, scd.PRODUCT), order])


@query(f"""{PRODUCT_DIMS}, broken AS (SELECT k, ProductID, CASE WHEN ProductID % 20 = 0 THEN Start + INTERVAL 1 DAY WHEN ProductID % 20 = 2 THEN Start - INTERVAL 1 DAY ELSE Start END AS Start, Finish FROM dim3),
    n AS (SELECT *, lead(Start) OVER (PARTITION BY ProductID ORDER BY Start, k) AS nxt FROM broken)
    SELECT 'intervals' AS check, CAST(k AS VARCHAR) AS key, CASE WHEN Finish > nxt THEN 'overlap' ELSE 'gap' END AS detail FROM n WHERE Finish <> nxt""")
def q10_broken_history(spark, d):
    """Versions of some products are moved by a day, which makes gaps and overlaps."""
    dim = warehouse.product_dim(spark, d)[1]
    start, m = F.col(scd.START), F.col("ProductID") % 20
    day = F.expr("INTERVAL 1 DAY")
    moved = dim.withColumn(scd.START, F.when(m == 0, start + day).when(m == 2, start - day).otherwise(start))
    return quality.check_intervals(moved, scd.PRODUCT)


@query("SELECT 'references' AS check, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')")
def q11_references(spark, d):
    parents = _table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    return quality.check_references(_table(spark, d, "orders"), ["o_orderkey"], "o_custkey", parents, "c_custkey")


@query("SELECT 'range' AS check, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS VARCHAR) AS detail FROM part WHERE p_size NOT BETWEEN 5 AND 40")
def q12_ranges(spark, d):
    return quality.check_range(_table(spark, d, "part"), ["p_partkey"], "p_size", 5, 40)


@query(f"{FACT} SELECT 'ProductKey' AS column, count(*) FILTER (ProductKey = -1) AS unknown, count(*) AS rows, count(*) FILTER (ProductKey = -1) / count(*) AS rate FROM fact UNION ALL SELECT 'ShipDateKey', count(*) FILTER (ShipDateKey = -1), count(*), count(*) FILTER (ShipDateKey = -1) / count(*) FROM fact")
def q13_unknown_rate(spark, d):
    return quality.unknown_rate(warehouse.sales_fact(spark, d), ["ProductKey", "ShipDateKey"])


@query(f"""{PRODUCT_DIMS}, t AS (SELECT count(*) FILTER (a IN ('new', 't2')) AS i, count(*) FILTER (a IN ('t1', 't2')) AS u FROM act3) SELECT 'counts_match' AS check, 'inserted' AS key, i || ' / ' || (i + 5) AS detail FROM t
    UNION ALL SELECT 'counts_match', 'updated', u || ' / ' || (u + 1) FROM t""")
def q17_counts_match(spark, d):
    """Counters against the snapshots before and after the last load: the right
    ones, which no row is for, and wrong ones."""
    before, after, counts = warehouse.product_dim(spark, d)
    t = scd.totals(counts).first()
    right = quality.check_counts_match(before, after, scd.PRODUCT, t["rows_inserted"], t["rows_updated"])
    return quality.all_of([right, quality.check_counts_match(before, after, scd.PRODUCT, t["rows_inserted"] + 5, t["rows_updated"] + 1)])


@query(f"SELECT 'customer_kind' AS check, CAST(CustomerID AS VARCHAR) AS key, 'Store' AS detail FROM ({shapes.CUSTOMER_SQL}) WHERE CustomerID % 25 = 0 AND CustomerType <> 'Store'")
def q19_customer_kind(spark, d):
    """Some customers are said to be stores."""
    staged = shapes.staged_customer(spark, d)
    return quality.check_customer_kind(staged.withColumn("CustomerType", F.when(F.col("CustomerID") % 25 == 0, "Store").otherwise(F.col("CustomerType"))))


@query("""SELECT 'run' AS check, CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_acctbal < 0 AND CAST(s_acctbal AS BIGINT) < 0 THEN 'negative counter' ELSE 'ends before it starts' END AS detail
    FROM supplier WHERE CAST(s_acctbal AS BIGINT) < 0 OR s_suppkey % 9 = 0""")
def q16_run_counters(spark, d):
    """A log in which some counters are negative and some runs end too early."""
    start = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    end = F.when(F.col("s_suppkey") % 9 == 0, start - F.expr("INTERVAL 1 HOUR")).otherwise(start + F.expr("INTERVAL 1 HOUR"))
    log = _table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("ExecutionID"), start.alias("StartTime"), end.alias("EndTime"), F.round("s_acctbal").cast("long").alias("RowsRead"), *[F.lit(0).cast("long").alias(c) for c in ("RowsInserted", "RowsUpdated", "RowsRejected")]
    )
    return quality.check_counters(log)


@query(f"SELECT 'one_group' AS check, CountryRegionCode AS key, CAST(n AS VARCHAR) AS detail FROM (SELECT CASE WHEN TerritoryID % 2 = 0 THEN 'even' ELSE 'odd' END AS CountryRegionCode, count(DISTINCT TerritoryGroup) AS n FROM ({shapes.TERRITORY_SQL}) GROUP BY 1) WHERE n > 1")
def q20_one_group(spark, d):
    staged = shapes.staged_territory(spark, d)[0].withColumn("CountryRegionCode", F.when(F.col("TerritoryID") % 2 == 0, "even").otherwise("odd"))
    return quality.check_one_group(staged)


@query(f"""{PRODUCT_DIMS} SELECT ProductID, count(*) - coalesce((SELECT count(*) FROM dim1 o WHERE o.ProductID = n.ProductID), 0) AS added, coalesce(bool_or(ProductID % 10 = 1), false) AS overwritten FROM dim2 n GROUP BY ProductID""")
def q21_version_changes(spark, d):
    """What the second load has done to each key."""
    before, after, _ = warehouse.product_dim(spark, d, 2)
    return quality.version_changes(before, after, scd.PRODUCT)


@query("""SELECT o_custkey, a AS in_source, b AS in_target FROM (SELECT o_custkey, count(*) AS a, count(*) FILTER (o_orderstatus <> 'P') AS b FROM orders GROUP BY o_custkey) WHERE a <> b""")
def u2_reconcile(spark, d):
    o = _table(spark, d, "orders")
    return quality.reconcile(o, o.where("o_orderstatus <> 'P'"), ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS in_source, count(*) * CASE WHEN l_orderkey % 500 = 3 THEN 0 ELSE 2 END AS in_target FROM lineitem WHERE l_orderkey % 500 IN (3, 7) GROUP BY l_orderkey, l_linenumber""")
def u2_reconcile_by_hash(spark, d):
    """A target without the lines of some orders and with those of others twice."""
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    m = F.col("l_orderkey") % 500
    return quality.reconcile_by_hash(li, li.where(m != 3).union(li.where(m == 7)), ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, concat_ws(';', CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_nationkey % 2 = 1 THEN 'odd nation' END) AS reasons FROM supplier WHERE s_acctbal < 0 OR s_nationkey % 2 = 1")
def s10_rejects(spark, d):
    _, bad = quality.split_rejects(_table(spark, d, "supplier"), {"negative": F.col("s_acctbal") < 0, "odd nation": F.col("s_nationkey") % 2 == 1})
    return bad.select("s_suppkey", F.array_join("reject_reasons", ";").alias("reasons"))


# Runs, increments, streams


@query(f"""{PRODUCT_DIMS} SELECT 2 AS ExecutionID, 'Succeeded' AS Status, count(*) FILTER (a <> 'keep') AS RowsRead, count(*) FILTER (a IN ('new', 't2')) AS RowsInserted, count(*) FILTER (a IN ('t1', 't2')) AS RowsUpdated FROM act2
    UNION ALL SELECT 3, 'Succeeded', count(*) FILTER (a <> 'keep'), count(*) FILTER (a IN ('new', 't2')), count(*) FILTER (a IN ('t1', 't2')) FROM act3""")
def s9_run_log(spark, d):
    """Each load adds a row when it starts and when it has ended; the log's state
    is the last of each."""
    log = None
    dim = scd.empty_dimension(shapes.staged_product(spark, d), scd.PRODUCT)
    for v, t in enumerate(shapes.LOADS, 1):
        started = runlog.run_started(spark, v, "product", t)
        dim, counts = scd.apply_scd(dim, shapes.staged_product(spark, d, v), scd.PRODUCT, t)
        sums = scd.totals(counts).first()
        ended = runlog.run_finished(started, t + dt.timedelta(minutes=1), sums["rows_read"], sums["rows_inserted"], sums["rows_updated"])
        both = started.unionByName(ended)
        log = both if log is None else log.unionByName(both)
    bad = quality.check_counters(log).count()
    return runlog.run_state(log).where((F.col("ExecutionID") > 1) & F.lit(bad == 0)).select("ExecutionID", "Status", "RowsRead", "RowsInserted", "RowsUpdated")


_DOUBLED = "SELECT count(*) AS n FROM dim1 WHERE ProductID % 10 = 5"


@query(f"""{PRODUCT_DIMS} SELECT 1 AS ExecutionID, 'Succeeded' AS Status, count(*) AS RowsInserted, CAST(NULL AS VARCHAR) AS ErrorMessage, count(*) AS members FROM dim1
    UNION ALL SELECT 2, 'Failed', 0, 'ValueError: ' || ({_DOUBLED.replace("count(*) AS n", "count(*)")}) || ' staged keys of product are null or repeated', count(*) FROM dim1""")
def s9_failed_run(spark, d):
    """Two loads, the second with repeated keys: it is logged as failed, and the
    dimension stays as it was."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    load.run_load(store, scd.PRODUCT, 1, "part", lambda: (shapes.staged_product(spark, d, 1), None), shapes.LOADS[0])
    second = shapes.staged_product(spark, d, 1)
    try:
        load.run_load(store, scd.PRODUCT, 2, "part", lambda: (second.union(second.where("ProductID % 10 = 5")), None), shapes.LOADS[1])
    except ValueError:
        pass  # it is in the log
    n = store.read("product").count()
    return runlog.run_state(load.run_log(store)).select("ExecutionID", "Status", "RowsInserted", "ErrorMessage", F.lit(n).cast("long").alias("members"))


_LOST = "l_orderkey % 50 = 7"
_MOVED = f"""SELECT count(*) FROM (SELECT l.SalesOrderID, l.SalesOrderDetailID, count(*) AS n FROM ({shapes.LINES_SQL}) l LEFT JOIN (SELECT ProductID, CASE WHEN ProductID % 20 = 2 THEN Start - INTERVAL 30 DAY ELSE Start END AS Start, Finish FROM dim3) d
    ON d.ProductID = l.ProductID AND OrderDate >= d.Start AND OrderDate < d.Finish WHERE l.SalesOrderID % 50 <> 7 GROUP BY ALL)
    JOIN (SELECT l_orderkey, l_linenumber, count(*) AS m FROM lineitem GROUP BY ALL) ON l_orderkey = SalesOrderID AND l_linenumber = SalesOrderDetailID WHERE n > m"""


@query(f"""{PRODUCT_DIMS}, n AS (SELECT count(*) FILTER ({_LOST}) AS lost, count(*) FILTER (NOT ({_LOST})) AS good FROM lineitem)
    SELECT 1 AS ExecutionID, 'Succeeded' AS Status, lost + good AS RowsRead, good AS RowsInserted, lost AS RowsRejected, NULL AS ErrorMessage, lost AS stored, good AS published FROM n
    UNION ALL SELECT 2, 'Failed', 0, 0, 0, 'ValueError: ' || ({_MOVED}) || ' order lines have become several rows', lost, good FROM n""")
def c14_run_fact_load(spark, d):
    """A load of the fact, the same run again, and a run with versions that overlap:
    some orders have no header, so their lines are rejects."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    detail, header = shapes.order_sources(spark, d)
    extract = lambda: (detail, header.where("SalesOrderID % 50 <> 7"))
    dim = warehouse.product_dim(spark, d)[1]
    for _ in range(2):
        load.run_fact_load(store, 1, "lineitem", extract, dim, scd.PRODUCT)
    start = F.when(F.col("ProductID") % 20 == 2, F.col(scd.START) - F.expr("INTERVAL 30 DAYS")).otherwise(F.col(scd.START))
    try:
        load.run_fact_load(store, 2, "lineitem", extract, dim.withColumn(scd.START, start), scd.PRODUCT)
    except ValueError:
        pass  # it is in the log
    log = runlog.run_state(load.run_log(store)).select("ExecutionID", "Status", "RowsRead", "RowsInserted", "RowsRejected", "ErrorMessage")
    rejects = load.stored_rejects(store).groupBy(F.col("ExecutionID").alias("_run")).agg(F.count("*").alias("stored"))
    return log.join(rejects, F.col("ExecutionID") == F.col("_run"), "left").select(*log.columns, "stored", F.lit(store.read("sales").count()).cast("long").alias("published"))


@query(f"SELECT ProductID, TIMESTAMP '{shapes.LOADS[0]}' AS ExtractedAt FROM ({shapes.product_sql(1)})")
def s7_staging_defaults(spark, d):
    return shapes.staged_product(spark, d).select("ProductID", "ExtractedAt")


@query(f"{PRODUCT_DIMS} SELECT k AS ProductKey, Start AS CreatedAt, CASE WHEN Cur THEN TIMESTAMP '9999-12-31 23:59:59.999999' ELSE Finish END AS EffectiveEndDateTime, year(Finish) = 9999 AS IsCurrent FROM dim3")
def s7_dimension_defaults(spark, d):
    """When each version was made, and the end and the flag that it begins with."""
    return warehouse.product_dim(spark, d)[1].select("ProductKey", "CreatedAt", scd.END, scd.CURRENT)


@query("SELECT 1 AS ExecutionID, true AS by_me, count(*) AS RowsRead FROM supplier UNION ALL SELECT 2, true, 0")
def f18_executed_by(spark, d):
    """Who is logged to have run a load that succeeds, and one that fails."""
    started = [runlog.run_started(spark, i, "supplier", shapes.LOADS[0]) for i in (1, 2)]
    rows = _table(spark, d, "supplier").count()
    log = quality.all_of([*started, runlog.run_finished(started[0], shapes.LOADS[1], rows), runlog.run_finished(started[1], shapes.LOADS[1], error="lost")])
    return runlog.run_state(log).select("ExecutionID", (F.col("ExecutedBy") == F.current_user()).alias("by_me"), "RowsRead")


@query("""WITH s AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders) SELECT 'days' AS range, CAST(date_diff('day', a, b) + 1 AS VARCHAR) AS result FROM s
    UNION ALL SELECT 'backwards', 'the end date is before the start date' UNION ALL SELECT 'over 100 years', 'the range is over 100 years' UNION ALL SELECT '100 years', CAST(date_diff('day', a, a + INTERVAL 100 YEAR) + 1 AS VARCHAR) FROM s""")
def p10_calendar_ranges(spark, d):
    """Ranges of days from the orders' dates on that a calendar is or isn't made for."""
    first, last = _span(spark, d)
    out = []
    for name, start, end in (("days", first, last), ("backwards", last, first), ("over 100 years", first, first.replace(year=first.year + 101)), ("100 years", first, first.replace(year=first.year + 100))):
        try:
            out.append((name, str(calendar.dates(spark, start, end).count())))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "range string, result string")


@query(f"SELECT 7 AS ExecutionID, 'territory' AS TargetObject, TerritoryID, reasons AS Reasons, (SELECT count(*) FROM ({shapes.TERRITORY_REJECTS_SQL})) AS RowsRejected FROM ({shapes.TERRITORY_REJECTS_SQL})")
def s10_stored_rejects(spark, d):
    """Territories that can't be loaded are kept under the run's id and counted in the log."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    load.run_load(store, scd.TERRITORY, 7, "nation", lambda: shapes.staged_territory(spark, d), shapes.LOADS[0])
    state = runlog.run_state(load.run_log(store)).select("ExecutionID", "RowsRejected")
    kept = load.stored_rejects(store).withColumn("TerritoryID", F.get_json_object("RejectedRow", "$.TerritoryID").cast("long"))
    return kept.join(F.broadcast(state), "ExecutionID").select("ExecutionID", "TargetObject", "TerritoryID", "Reasons", "RowsRejected")


@query(f"SELECT * FROM ({shapes.product_sql(2)})")
def s2_staging_scan(spark, d):
    """Staging is written by each load as a version, and read from there."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}")
    for v in (1, 2):
        load.run_load(store, scd.PRODUCT, v, "part", lambda v=v: (shapes.staged_product(spark, d, v), None), shapes.LOADS[v - 1])
    return store.read("staging_product").drop("ExtractedAt")


@query(f"""{PRODUCT_DIMS}, moved AS (SELECT k, ProductID, CASE WHEN ProductID % 20 = 2 THEN Start - INTERVAL 30 DAY ELSE Start END AS Start, Finish FROM dim3),
    l AS ({shapes.LINES_SQL}), f AS (SELECT SalesOrderID, SalesOrderDetailID, count(*) AS n FROM l LEFT JOIN moved d ON d.ProductID = l.ProductID AND OrderDate >= d.Start AND OrderDate < d.Finish GROUP BY ALL),
    g AS (SELECT l_orderkey AS o, l_linenumber AS i, count(*) AS m FROM lineitem GROUP BY ALL)
    SELECT 'grain' AS check, SalesOrderID || '|' || SalesOrderDetailID AS key, CAST(n AS VARCHAR) AS detail FROM f JOIN g ON o = SalesOrderID AND i = SalesOrderDetailID WHERE n > m""")
def j15_grain_guard(spark, d):
    """Versions that overlap make several rows of a line, which the guard of the fact's load reports."""
    dim = warehouse.product_dim(spark, d)[1]
    start = F.when(F.col("ProductID") % 20 == 2, F.col(scd.START) - F.expr("INTERVAL 30 DAYS")).otherwise(F.col(scd.START))
    detail, header = shapes.order_sources(spark, d)
    lines = detail.join(header.select("SalesOrderID", "OrderDate"), "SalesOrderID")
    return fact.grain_breaks(lookup.lookup_key(lines, dim.withColumn(scd.START, start), scd.PRODUCT, "ProductID", "OrderDate"), detail)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01'")
def i1_extract_since(spark, d):
    return incremental.extract_since(_table(spark, d, "orders"), "o_orderdate", dt.datetime(1999, 6, 1)).select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT min(o_orderdate) FROM orders) ORDER BY 2")
def i2_watermark(spark, d):
    """Two loads: the first takes the first day and sets the watermark, the
    second takes what is later."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/watermark-{uuid.uuid4().hex}")
    o = _table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = o.agg(F.min("o_orderdate").alias("m")).first()["m"]
    incremental.load_since(store, "orders", o.where(F.col("o_orderdate") <= first), "o_orderdate", lambda rows: store.write("orders", rows))
    incremental.load_since(store, "orders", o, "o_orderdate", lambda rows: store.write("orders", rows))
    return store.read("orders")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def i4_latest_change(spark, d):
    return incremental.latest_change(_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of a user's last event type; an error deletes the user."""
    e = _table(spark, d, "events")
    return e.select(
        "user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("SourceModifiedDate"), F.sha2("event_type", 256).alias("RowHash"), "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op")
    )


_USER = scd.DimensionSpec("user", "user_id", "user_key", type2=("kind",))
_SPLIT = "(SELECT median(event_id) FROM events)"


@query(f"""WITH last1 AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events WHERE event_id <= {_SPLIT} GROUP BY user_id),
    dim1 AS (SELECT user_id, kind, row_number() OVER (ORDER BY user_id) AS k FROM last1 WHERE kind <> 'error'),
    last2 AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events WHERE event_id > {_SPLIT} GROUP BY user_id),
    fresh AS (SELECT s.user_id, s.kind, (SELECT max(k) FROM dim1) + row_number() OVER (ORDER BY s.user_id) AS k FROM last2 s LEFT JOIN dim1 d USING (user_id) WHERE s.kind <> 'error' AND (d.kind IS NULL OR d.kind <> s.kind))
    SELECT d.k AS user_key, d.user_id, d.kind, s.kind IS NULL OR s.kind = d.kind AS current FROM dim1 d LEFT JOIN last2 s USING (user_id)
    UNION ALL SELECT k, user_id, kind, true FROM fresh""")
def i4_apply_changes(spark, d):
    """Changes in two batches: the last of each key counts, a delete ends a version."""
    changes = _changes(spark, d)
    middle = changes.agg(F.median("event_id").alias("m")).first()["m"]
    dim = scd.empty_dimension(changes, _USER)
    for t, part in ((dt.datetime(2024, 1, 1), F.col("event_id") <= middle), (dt.datetime(2024, 2, 1), F.col("event_id") > middle)):
        dim, _ = incremental.apply_changes(dim, changes.where(part), _USER, t, ["SourceModifiedDate", "event_id"])
    return dim.select("user_key", "user_id", "kind", F.col(scd.CURRENT).alias("current"))


_HISTORY = """WITH m AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), k AS (SELECT * FROM m WHERE event_type IS DISTINCT FROM p)
    SELECT user_id, event_type, ts AS Start, coalesce(lead(ts) OVER w, TIMESTAMP '9999-12-31 23:59:59.999999') AS Finish, lead(ts) OVER w IS NULL AS Cur FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(_HISTORY.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"))
def w6_hot_key(spark, d):
    """One user has a third of all events; users with over 500 are cut by time."""
    e = _table(spark, d, "events").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "user_id": F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))})
    out = incremental.history_from_changes(e, ["user_id"], "ts", ["event_type"], ["event_id"], hot=500)
    return out.select("user_id", "event_type", F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"))


@query(_HISTORY)
def w6_history_from_changes(spark, d):
    e = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = incremental.history_from_changes(e, ["user_id"], "ts", ["event_type"], ["event_id"])
    return out.select("user_id", "event_type", F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"))


def _cut(i: int, where: str) -> str:
    """The points at which something changes after the i-th load: those before it and its changes."""
    before = f"SELECT user_id, ts, 0 AS new, event_type FROM k{i - 1} UNION ALL" if i > 1 else ""
    return f"""p{i} AS ({before} SELECT user_id, ts, 1, event_type FROM events WHERE {where}), u{i} AS (SELECT user_id, ts, event_type FROM p{i} AS t(user_id, ts, new, event_type) QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY new DESC) = 1),
    k{i} AS (SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type, 1, 'error') OVER (PARTITION BY user_id ORDER BY ts) AS p FROM u{i}) WHERE event_type <> p)"""


_BACKDATED = f"""WITH {_cut(1, "event_id % 3 = 0")}, {_cut(2, "event_id % 3 = 1")}, {_cut(3, "event_id % 3 = 2 OR event_id % 9 = 0")},
    v AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM k3)
    SELECT user_id, event_type AS kind, ts AS Start, coalesce(nxt, TIMESTAMP '9999-12-31 23:59:59.999999') AS Finish, nxt IS NULL AS Cur FROM v WHERE event_type <> 'error'"""


def _user_versions(dim: DataFrame) -> DataFrame:
    return dim.select("user_id", "kind", F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"))


@query(_BACKDATED)
def i4_backdated_changes(spark, d):
    """Changes in three loads, each with times all over the history, the last with
    some of the first again; an error deletes. Each load cuts what those before it
    have made."""
    changes = _changes(spark, d)
    dim = scd.empty_dimension(changes, _USER)
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1, (F.col("event_id") % 3 == 2) | (F.col("event_id") % 9 == 0)):
        dim = backdated.apply_backdated(dim, changes.where(part), _USER, "SourceModifiedDate", ["event_id"], "op")
    return _user_versions(dim)


def _scrambled(spark: SparkSession, d: str, days: int, of, batches: int = 5) -> Iterator[DataFrame]:
    """Events in batches that come one after the other, with their number as `file`;
    the events `of` some users may be late by up to `days`, and some come twice."""
    e = _table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    first, last = e.agg(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).first()
    at = (F.unix_seconds(F.col("ts").cast("timestamp")) - first + F.when(of, F.pmod(F.xxhash64("event_id"), F.lit(days * 86400))).otherwise(0)) / (last - first + days * 86400 + 1)
    for i in range(batches):
        number = F.floor(at * batches)
        again = of & (F.col("event_id") % 20 == 3) & (number == i - 1)
        yield e.where((number == i) | again).withColumn("file", F.lit(i))


def _late_stream(spark: SparkSession, d: str, days: int, late: str, of) -> tuple[DataFrame, DataFrame]:
    """The history that a stream of scrambled events makes, and all of its events.
    All tasks write a batch's files, which the stream takes before the next batch comes."""
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    source = f"{base}/in"
    for rows in _scrambled(spark, d, days, of):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        history = late_stream.late_history(stream, "user_id", "ts", "event_id", ["event_type"], late)
        late_stream.write_late_history(history, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return late_stream.read_late_history(spark, f"{base}/out", "user_id", "event_type string"), spark.read.parquet(source)


@query(_HISTORY)
def i5_late_changes(spark, d):
    """Events come in five batches, up to three days late and some of them twice;
    the history is that of all events in order."""
    versions, _ = _late_stream(spark, d, 3, "4 days", F.lit(True))
    return _streamed(versions)


def _streamed(versions: DataFrame) -> DataFrame:
    return versions.select("user_id", "event_type", F.col("start").alias("Start"), F.coalesce("until", scd.stamp(scd.OPEN_END)).alias("Finish"), F.col("until").isNull().alias("Cur"))


@query(_HISTORY)
def i5_repaired_history(spark, d):
    """The stream settles after an hour, and a tenth of the users have events that
    are up to three days late: too late for it. Their histories are made anew from
    the log of all events."""
    versions, log = _late_stream(spark, d, 3, "1 hour", F.col("user_id") % 10 == 0)
    late = late_stream.late_keys(log, "user_id", "ts", "file", "1 hour")
    anew = incremental.history_from_changes(log.join(late, "user_id", "left_semi").drop("file").distinct(), ["user_id"], "ts", ["event_type"], ["event_id"])
    anew = anew.select("user_id", "event_type", F.col(scd.START).alias("Start"), F.col(scd.END).alias("Finish"), F.col(scd.CURRENT).alias("Cur"))
    return _streamed(versions.join(late, "user_id", "left_anti")).unionByName(anew)


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = _table(spark, d, table).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/[{table[0]}]{table[1:]}.parquet")


@query("SELECT row_number() OVER (ORDER BY user_id) AS user_key, user_id, arg_max(event_type, (ts, event_id)) AS kind, true AS current FROM events GROUP BY user_id")
def i5_stream_scd(spark, d):
    """The users' last event types as a dimension, fed by a stream."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = SnapshotStore(spark, f"{base}/tables")

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("SourceModifiedDate"), F.sha2("event_type", 256).alias("RowHash"), "event_id")

    run = scd_stream.stream_scd(_stream(spark, d, "events"), store, _USER, ["SourceModifiedDate", "event_id"], lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n), f"{base}/checkpoint", prepare)
    run.awaitTermination()
    return store.read("user").select("user_key", "user_id", "kind", F.col(scd.CURRENT).alias("current"))


@query("""SELECT row_number() OVER (ORDER BY user_id) AS user_key, user_id, kind, true AS current FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id) WHERE kind <> 'error'""")
def i5_stream_changes(spark, d):
    """The same from changes, of which errors delete."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = SnapshotStore(spark, f"{base}/tables")

    def prepare(batch: DataFrame) -> DataFrame:
        stamped = batch.select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("SourceModifiedDate"), F.sha2("event_type", 256).alias("RowHash"), "event_id")
        return stamped.withColumn("op", F.when(F.col("kind") == "error", "delete").otherwise("update"))

    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    scd_stream.stream_scd(_stream(spark, d, "events"), store, _USER, ["SourceModifiedDate", "event_id"], at, f"{base}/checkpoint", prepare, operation="op").awaitTermination()
    return store.read("user").select("user_key", "user_id", "kind", F.col(scd.CURRENT).alias("current"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def i5_windowed_stream(spark, d):
    """Events by type and hour, counted in a stream that is read to its end."""
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    counts = scd_stream.windowed_counts(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{base}/counts")
    return last.groupBy("window_start", "event_type").agg(F.max("n").alias("n")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
