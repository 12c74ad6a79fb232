"""The given tables in the shape of the sources that staging reads, and the SQL of the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmodel.operators import staging
from starmodel.sources.schema import MONEY, RATE
from starmodel.sources.tables import read_parquet, source

#: When the three product snapshots are loaded.
LOADS = (dt.datetime(1995, 7, 1), dt.datetime(1997, 1, 1), dt.datetime(1999, 1, 1))


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _days(base: str, n):
    return (_ntz(base) + F.make_dt_interval(n.cast("int"))).cast("timestamp_ntz")


def product_source(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    """Parts as products. In snapshot 2 a tenth of the keys each has another
    price, another name, both, is absent, or has another modified date only, and
    a tenth comes again under keys that no part has (`new_key_step` higher);
    snapshot 3 is as 1."""
    p = read_parquet(spark, d, "part")
    k = F.col("p_partkey")
    out = p.select(
        k.alias("ProductID"), F.col("p_name").alias("Name"), F.col("p_brand").alias("ProductNumber"), F.when(k % 7 != 0, F.split("p_name", " ")[0]).alias("Color"), F.col("p_size").cast("string").alias("Size"),
        (F.col("p_retailprice").cast(MONEY) * F.lit("0.6").cast("decimal(2,1)")).cast(MONEY).alias("StandardCost"), F.col("p_retailprice").cast(MONEY).alias("ListPrice"),
        F.when(k % 17 != 0, F.ascii("p_type") * 100 + F.length("p_type")).alias("ProductSubcategoryID"), _days("1995-01-01", k % 365).alias("SellStartDate"),
        F.when(k % 5 == 0, _days("1998-01-01", k % 365)).alias("SellEndDate"), F.lit(None).cast("timestamp_ntz").alias("DiscontinuedDate"), _ntz("1995-06-01").alias("ModifiedDate"),
    )
    if version == 2:
        m = F.col("ProductID") % 10
        more = out.where(m == 9).withColumn("ProductID", F.col("ProductID") + new_key_step(p))
        out = out.where(m != 3).withColumns({
            "ListPrice": F.when(m.isin(0, 2), (F.col("ListPrice") * F.lit("1.1").cast("decimal(2,1)")).cast(MONEY)).otherwise(F.col("ListPrice")),
            "Name": F.when(m.isin(1, 2), F.concat("Name", F.lit(" v2"))).otherwise(F.col("Name")),
            "ModifiedDate": F.when(m == 4, _ntz("1996-12-01")).otherwise(F.col("ModifiedDate")),
        }).unionByName(more)
    return source(out, "product")


def new_key_step(part: DataFrame) -> int:
    """What is added to a part's key to make a new one: a million, or, where that
    gives keys that are there (in tables of over a million parts), as many millions
    as lead past all of them."""
    keys = part.select("p_partkey")
    made = keys.where(F.col("p_partkey") % 10 == 9).select(F.col("p_partkey") + 1_000_000)
    if keys.intersect(made).isEmpty():
        return 1_000_000
    low, high = keys.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return ((high - low) // 1_000_000 + 1) * 1_000_000


def subcategories(spark: SparkSession, d: str) -> DataFrame:
    t = read_parquet(spark, d, "part").select("p_type").distinct()
    return source(t.select((F.ascii("p_type") * 100 + F.length("p_type")).alias("ProductSubcategoryID"), (F.length("p_type") % 3 + 1).alias("ProductCategoryID"), F.col("p_type").alias("Name")), "product_subcategory")


def categories(spark: SparkSession) -> DataFrame:
    return source(spark.range(1, 3).select(F.col("id").alias("ProductCategoryID"), F.concat(F.lit("Category "), F.col("id")).alias("Name")), "product_category")


def staged_product(spark: SparkSession, d: str, version: int = 1) -> DataFrame:
    return staging.stage_product(product_source(spark, d, version), subcategories(spark, d), categories(spark), LOADS[version - 1])


def customer_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read_parquet(spark, d, "customer")
    k = F.col("c_custkey")
    customer = c.select(
        k.alias("CustomerID"), F.when(k % 11 != 0, k + 1000).alias("PersonID"), F.when(k % 3 == 0, k + 5000).alias("StoreID"), F.col("c_nationkey").alias("TerritoryID"), F.concat(F.lit("AC"), F.lpad(k.cast("string"), 8, "0")).alias("AccountNumber"),
        _days("1995-06-01", k % 10).alias("ModifiedDate"),
    )
    person = c.select(
        (k + 1000).alias("BusinessEntityID"), F.lit("IN").alias("PersonType"), F.concat(F.lit("  "), "c_mktsegment").alias("FirstName"), F.when(k % 4 != 0, F.lit(" M ")).alias("MiddleName"),
        F.when(k % 10 == 1, F.lit(" ")).otherwise(F.col("c_name")).alias("LastName"), _days("1995-06-01", k % 20).alias("ModifiedDate"),
    )
    store = c.where(k % 3 == 0).select((k + 5000).alias("BusinessEntityID"), F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat("c_name", F.lit(" Store"))).alias("Name"), _days("1995-06-01", k % 30).alias("ModifiedDate"))
    return source(customer, "customer"), source(person, "person"), source(store, "store")


def staged_customer(spark: SparkSession, d: str) -> DataFrame:
    return staging.stage_customer(*customer_sources(spark, d), LOADS[0])


def territory_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r = read_parquet(spark, d, "nation"), read_parquet(spark, d, "region")
    k = F.col("n_nationkey")
    territory = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        k.alias("TerritoryID"), F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("Name"), F.when(k % 8 == 7, F.lit("XX")).otherwise(F.concat(F.lit("R"), "n_regionkey")).alias("CountryRegionCode"),
        F.when(k == 5, F.lit("  ")).otherwise(F.col("r_name")).alias("Group"), _days("1995-06-01", k % 7).alias("ModifiedDate"),
    )
    country = r.select(F.concat(F.lit("R"), "r_regionkey").alias("CountryRegionCode"), F.lower("r_name").alias("Name"), _days("1995-06-01", F.col("r_regionkey")).alias("ModifiedDate"))
    return source(territory, "sales_territory"), source(country, "country_region")


def staged_territory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return staging.stage_territory(*territory_sources(spark, d), LOADS[0])


def salesperson_sources(spark: SparkSession, d: str, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as sales persons; in snapshot 2 some have another name, another
    title, or a middle name that is empty instead of null."""
    s = read_parquet(spark, d, "supplier")
    k = F.col("s_suppkey")
    second = F.lit(version == 2)
    person_ = s.select(
        k.alias("BusinessEntityID"), F.col("s_nationkey").alias("TerritoryID"), F.when(k % 4 != 0, F.col("s_acctbal").cast(MONEY)).alias("SalesQuota"), F.abs(F.col("s_acctbal").cast(MONEY)).alias("Bonus"),
        (k % 5).cast(RATE).alias("CommissionPct"), _ntz("1995-06-01 10:00:00.4").alias("ModifiedDate"),
    )
    person = s.where(k % 13 != 12).select(
        k.alias("BusinessEntityID"), F.lit("SP").alias("PersonType"), F.concat(F.lit("S"), k.cast("string"), F.when(second & (k % 6 == 1), F.lit("b")).otherwise(F.lit(""))).alias("FirstName"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("Q")).cast("string").alias("MiddleName"), F.col("s_name").alias("LastName"), _ntz("1995-06-01 10:00:00.6").alias("ModifiedDate"),
    )
    employee = s.where(k % 17 != 16).select(
        k.alias("BusinessEntityID"), F.when(second & (k % 6 == 2), F.lit("Manager")).otherwise(F.lit(" Representative ")).alias("JobTitle"), F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int")).alias("HireDate"), (k % 2 == 0).alias("CurrentFlag"),
        _ntz("1995-05-01").alias("ModifiedDate"),
    )
    return source(person_, "sales_person"), source(person, "person"), source(employee, "employee")


def staged_salesperson(spark: SparkSession, d: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    return staging.stage_salesperson(*salesperson_sources(spark, d, version), LOADS[version - 1])


def order_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines and headers."""
    li, o = read_parquet(spark, d, "lineitem"), read_parquet(spark, d, "orders")
    detail = li.select(
        F.col("l_orderkey").alias("SalesOrderID"), F.col("l_linenumber").alias("SalesOrderDetailID"), F.col("l_quantity").cast("int").alias("OrderQty"), F.col("l_partkey").alias("ProductID"),
        F.col("l_extendedprice").cast(MONEY).alias("UnitPrice"), F.col("l_discount").cast(MONEY).alias("UnitPriceDiscount"), F.lit(None).alias("LineTotal"),
    )
    total = F.col("o_totalprice").cast(MONEY)
    header = o.select(
        F.col("o_orderkey").alias("SalesOrderID"), F.col("o_orderdate").alias("OrderDate"), (F.col("o_orderdate") + F.expr("INTERVAL 12 DAYS")).alias("DueDate"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("ShipDate"), F.col("o_custkey").alias("CustomerID"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 90 + 1).alias("SalesPersonID"), F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey") % 30).alias("TerritoryID"),
        total.alias("SubTotal"), (total * F.lit("0.08").cast("decimal(3,2)")).alias("TaxAmt"), (total * F.lit("0.025").cast("decimal(4,3)")).alias("Freight"),
    )
    return source(detail, "sales_order_detail"), source(header, "sales_order_header")


# The same in SQL.

_ASCII_LENGTH = "(ascii(p_type) * 100 + length(p_type))"

_PRODUCT_V1 = f"""
    SELECT p_partkey AS id, p_name AS name, p_brand AS number, CASE WHEN p_partkey % 7 <> 0 THEN string_split(p_name, ' ')[1] END AS color, CAST(p_size AS VARCHAR) AS size,
        CAST(CAST(p_retailprice AS DECIMAL(19,4)) * CAST('0.6' AS DECIMAL(2,1)) AS DECIMAL(19,4)) AS cost, CAST(p_retailprice AS DECIMAL(19,4)) AS price,
        CASE WHEN p_partkey % 17 <> 0 THEN {_ASCII_LENGTH} END AS sub, p_type AS type,
        TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 365 AS INT)) AS sell_start, CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '1998-01-01' + to_days(CAST(p_partkey % 365 AS INT)) END AS sell_end,
        TIMESTAMP '1995-06-01' AS modified
    FROM part"""

_PRODUCT_V2 = f"""
    SELECT id, CASE WHEN id % 10 IN (1, 2) THEN name || ' v2' ELSE name END AS name, number, color, size, cost,
        CASE WHEN id % 10 IN (0, 2) THEN CAST(price * CAST('1.1' AS DECIMAL(2,1)) AS DECIMAL(19,4)) ELSE price END AS price, sub, type, sell_start, sell_end,
        CASE WHEN id % 10 = 4 THEN TIMESTAMP '1996-12-01' ELSE modified END AS modified
    FROM ({_PRODUCT_V1}) WHERE id % 10 <> 3
    UNION ALL SELECT id + 1000000, name, number, color, size, cost, price, sub, type, sell_start, sell_end, modified FROM ({_PRODUCT_V1}) WHERE id % 10 = 9"""


def product_sql(version: int = 1) -> str:
    """Staged products."""
    iso = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
    return f"""
    SELECT id AS ProductID, name AS ProductName, number AS ProductNumber, color AS Color, size AS Size, cost AS StandardCost, price AS ListPrice, SubcategoryName, CategoryName, sell_start AS SellStartDate, sell_end AS SellEndDate,
        CAST(NULL AS TIMESTAMP) AS DiscontinuedDate, modified AS SourceModifiedDate,
        sha256(concat('|Color=', coalesce(color, '<NULL>'), '|Size=', coalesce(size, '<NULL>'), '|StandardCost=', CAST(cost AS VARCHAR), '|ListPrice=', CAST(price AS VARCHAR), '|SubcategoryName=', SubcategoryName, '|CategoryName=', CategoryName,
            '|SellStartDate=', {iso("sell_start")}, '|SellEndDate=', coalesce({iso("sell_end")}, '<NULL>'), '|DiscontinuedDate=<NULL>')) AS RowHash
    FROM (SELECT *, CASE WHEN sub IS NULL THEN 'Uncategorized' ELSE type END AS SubcategoryName,
        CASE WHEN sub IS NULL OR length(type) % 3 + 1 > 2 THEN 'Uncategorized' ELSE 'Category ' || CAST(length(type) % 3 + 1 AS VARCHAR) END AS CategoryName
        FROM ({_PRODUCT_V2 if version == 2 else _PRODUCT_V1}))"""


CUSTOMER_SQL = """
    SELECT CustomerID, PersonID, StoreID, PersonType, CustomerType, CustomerName, FirstName, MiddleName, LastName, StoreName, AccountNumber, SourceModifiedDate,
        sha256(concat('CustomerType=', CustomerType, '|CustomerName=', CustomerName, '|FirstName=', coalesce(FirstName, '<NULL>'), '|MiddleName=', coalesce(MiddleName, '<NULL>'), '|LastName=', coalesce(LastName, '<NULL>'),
            '|StoreName=', coalesce(StoreName, '<NULL>'), '|AccountNumber=', AccountNumber)) AS RowHash
    FROM (SELECT k AS CustomerID, PersonID, StoreID, CASE WHEN PersonID IS NOT NULL THEN 'IN' END AS PersonType,
        CASE WHEN StoreID IS NOT NULL THEN 'Store' WHEN PersonID IS NOT NULL THEN 'Individual' ELSE 'Unknown' END AS CustomerType,
        CASE WHEN StoreID IS NOT NULL THEN coalesce(nullif(trim(store), ''), 'Unknown Customer')
             WHEN PersonID IS NOT NULL THEN coalesce(nullif(concat_ws(' ', nullif(trim(f), ''), nullif(trim(m), ''), nullif(trim(l), '')), ''), 'Unknown Customer') ELSE 'Unknown Customer' END AS CustomerName,
        CASE WHEN StoreID IS NULL AND PersonID IS NOT NULL THEN f END AS FirstName, CASE WHEN StoreID IS NULL AND PersonID IS NOT NULL THEN m END AS MiddleName, CASE WHEN StoreID IS NULL AND PersonID IS NOT NULL THEN l END AS LastName,
        store AS StoreName, 'AC' || lpad(CAST(k AS VARCHAR), 8, '0') AS AccountNumber,
        TIMESTAMP '1995-06-01' + to_days(CAST(CASE WHEN StoreID IS NOT NULL THEN greatest(k % 10, k % 30) WHEN PersonID IS NOT NULL THEN greatest(k % 10, k % 20) ELSE k % 10 END AS INT)) AS SourceModifiedDate
        FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey + 1000 END AS PersonID, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5000 END AS StoreID,
            '  ' || c_mktsegment AS f, CASE WHEN c_custkey % 4 <> 0 THEN ' M ' END AS m, CASE WHEN c_custkey % 10 = 1 THEN ' ' ELSE c_name END AS l,
            CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_name || ' Store' END END AS store FROM customer))"""

_TERRITORY_ALL = """
    SELECT n_nationkey AS TerritoryID, trim(n_name) AS TerritoryName, CASE WHEN n_nationkey % 8 = 7 THEN 'XX' ELSE 'R' || CAST(n_regionkey AS VARCHAR) END AS CountryRegionCode,
        CASE WHEN n_nationkey % 8 <> 7 THEN lower(r_name) END AS CountryRegionName, CASE WHEN n_nationkey <> 5 THEN r_name END AS TerritoryGroup,
        TIMESTAMP '1995-06-01' + to_days(CAST(CASE WHEN n_nationkey % 8 = 7 THEN n_nationkey % 7 ELSE greatest(n_nationkey % 7, r_regionkey) END AS INT)) AS SourceModifiedDate
    FROM nation JOIN region ON n_regionkey = r_regionkey"""

TERRITORY_SQL = f"""
    SELECT *, sha256(concat('CountryRegionCode=', CountryRegionCode, '|TerritoryGroup=', TerritoryGroup)) AS RowHash FROM ({_TERRITORY_ALL}) WHERE CountryRegionName IS NOT NULL AND TerritoryGroup IS NOT NULL"""

TERRITORY_REJECTS_SQL = f"""
    SELECT TerritoryID, concat_ws('; ', CASE WHEN CountryRegionCode = 'XX' THEN 'no such country' END, CASE WHEN CountryRegionName IS NULL THEN 'CountryRegionName is missing' END,
        CASE WHEN TerritoryGroup IS NULL THEN 'TerritoryGroup is missing' END) AS reasons FROM ({_TERRITORY_ALL}) WHERE CountryRegionName IS NULL OR TerritoryGroup IS NULL"""


def salesperson_sql(version: int = 1) -> str:
    first = "CASE WHEN k % 6 = 1 THEN 'b' ELSE '' END" if version == 2 else "''"
    title = "CASE WHEN k % 6 = 2 THEN 'Manager' ELSE 'Representative' END" if version == 2 else "'Representative'"
    return f"""
    SELECT k AS BusinessEntityID, concat_ws(' ', FirstName, MiddleName, LastName) AS SalesPersonName, FirstName, MiddleName, LastName, JobTitle, HireDate, CurrentFlag, SalesQuota, Bonus, CommissionPct, TerritoryID,
        TIMESTAMP '1995-06-01 10:00:01' AS SourceModifiedDate,
        sha256(concat('JobTitle=', JobTitle, '|CurrentFlag=', CASE WHEN CurrentFlag THEN '1' ELSE '0' END, '|SalesQuota=', coalesce(CAST(SalesQuota AS VARCHAR), '<NULL>'), '|Bonus=', CAST(Bonus AS VARCHAR), '|CommissionPct=', CAST(CommissionPct AS VARCHAR))) AS RowHash
    FROM (SELECT *, 'S' || CAST(k AS VARCHAR) || {first} AS FirstName, CASE WHEN k % 3 <> 0 THEN 'Q' END AS MiddleName, {title} AS JobTitle FROM (
        SELECT s_suppkey AS k, s_name AS LastName, DATE '2000-01-01' + CAST(s_suppkey AS INT) AS HireDate, s_suppkey % 2 = 0 AS CurrentFlag, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_acctbal AS DECIMAL(19,4)) END AS SalesQuota,
        abs(CAST(s_acctbal AS DECIMAL(19,4))) AS Bonus, CAST(s_suppkey % 5 AS DECIMAL(10,4)) AS CommissionPct, CAST(s_nationkey AS BIGINT) AS TerritoryID FROM supplier WHERE s_suppkey % 13 <> 12 AND s_suppkey % 17 <> 16))"""


LINES_SQL = """
    SELECT l_orderkey AS SalesOrderID, CAST(l_linenumber AS BIGINT) AS SalesOrderDetailID, CAST(l_quantity AS INT) AS OrderQty, l_partkey AS ProductID, CAST(l_extendedprice AS DECIMAL(19,4)) AS UnitPrice,
        CAST(l_discount AS DECIMAL(19,4)) AS UnitPriceDiscount, o_orderdate AS OrderDate, o_orderdate + INTERVAL 12 DAY AS DueDate, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 7 DAY END AS ShipDate, o_custkey AS CustomerID,
        CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 90 + 1 END AS SalesPersonID, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 30 END AS TerritoryID
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
