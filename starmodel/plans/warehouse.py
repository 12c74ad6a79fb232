"""The dimensions and the fact over the given tables, built step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starmodel.operators import fact, scd
from starmodel.plans import shapes
from starmodel.sources.shared import scratch

#: What has been loaded in this session: (application, folder, its files, name, loads)
#: -> the dimension, which is read from its files, and the counts of its last load.
_loaded: dict[tuple, tuple[DataFrame, DataFrame | None]] = {}


def _files(spark: SparkSession, d: str) -> tuple:
    """What tells whether a folder's tables have changed: names, sizes, times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(d)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in there))


def _load(spark: SparkSession, d: str, spec: scd.DimensionSpec, staged: Callable[[int], DataFrame], loads: int) -> tuple[DataFrame, DataFrame | None]:
    """A dimension after so many loads. Each load of a folder's tables is made
    once a session and written; all facts and reports then read its files. When a
    file of the folder changes, what was made of the folder before is forgotten."""
    key = (spark.sparkContext.applicationId, d, _files(spark, d), spec.name, loads)
    for old in [k for k in _loaded if k[:2] == key[:2] and k[2] != key[2]]:
        del _loaded[old]
    if key not in _loaded:
        if loads:
            with scratch(spark):
                _loaded[key] = scd.apply_scd(_load(spark, d, spec, staged, loads - 1)[0], staged(loads), spec, shapes.LOADS[loads - 1])
        else:
            _loaded[key] = scd.empty_dimension(staged(1), spec), None
    return _loaded[key]


def product_dim(spark: SparkSession, d: str, versions: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The product dimension before and after its last load, and the counts of that."""
    staged = lambda v: shapes.staged_product(spark, d, v)
    return _load(spark, d, scd.PRODUCT, staged, versions - 1)[0], *_load(spark, d, scd.PRODUCT, staged, versions)


def customer_dim(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, scd.CUSTOMER, lambda v: shapes.staged_customer(spark, d), 1)[0]


def salesperson_dim(spark: SparkSession, d: str, versions: int = 2) -> DataFrame:
    return _load(spark, d, scd.SALESPERSON, lambda v: shapes.staged_salesperson(spark, d, v)[0], versions)[0]


def territory_dim(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, scd.TERRITORY, lambda v: shapes.staged_territory(spark, d)[0], 1)[0]


def sales_fact(spark: SparkSession, d: str, dim: DataFrame | None = None, before_first: str = "unknown", attributes: tuple[str, ...] = ()) -> DataFrame:
    detail, header = shapes.order_sources(spark, d)
    dim = product_dim(spark, d)[1] if dim is None else dim
    others = {
        "CustomerKey": (customer_dim(spark, d), scd.CUSTOMER, "CustomerID"), "SalesPersonKey": (salesperson_dim(spark, d), scd.SALESPERSON, "SalesPersonID"),
        "TerritoryKey": (territory_dim(spark, d), scd.TERRITORY, "TerritoryID"),
    }
    return fact.load_fact(detail, header, dim, scd.PRODUCT, others, before_first, attributes=attributes)


# The same in SQL.


def apply_sql(steps: list[str], key: str, type1: list[str], type2: list[str], type0: list[str] = (), modified_counts: bool = False, empty_is_null: tuple[str, ...] = (), loads=shapes.LOADS) -> str:
    """CTEs dim1, dim2, ... of a dimension after each of the staged snapshots."""
    attributes = [key, *type0, *type1, *type2, "SourceModifiedDate", "RowHash"]
    out = []
    for i, staged in enumerate(steps):
        t = f"TIMESTAMP '{loads[i]}'"
        fresh_columns = ", ".join(f"s.{a}" for a in attributes)
        new = f"{t} AS Start, TIMESTAMP '9999-12-31 23:59:59.999999' AS Finish, true AS Cur"
        if i == 0:
            out.append(f"s1 AS ({staged}), dim1 AS (SELECT row_number() OVER (ORDER BY s.{key}) AS k, {fresh_columns}, {new} FROM s1 s)")
            continue
        n, prev = i + 1, f"dim{i}"
        diffs = [f"coalesce(d.{c}, '') <> coalesce(s.{c}, '')" if c in empty_is_null else f"d.{c} IS DISTINCT FROM s.{c}" for c in type1] + (["d.SourceModifiedDate <> s.SourceModifiedDate"] if modified_counts else [])
        kept = ", ".join(f"CASE WHEN a = 't1' THEN s.{c} ELSE d.{c} END AS {c}" if c in [*type1, "SourceModifiedDate"] else f"d.{c}" for c in attributes)
        out.append(f"""s{n} AS ({staged}),
            act{n} AS (SELECT coalesce(d.{key}, s.{key}) AS bk, CASE WHEN s.{key} IS NULL THEN 'keep' WHEN d.{key} IS NULL THEN 'new' WHEN d.RowHash <> s.RowHash THEN 't2' WHEN {' OR '.join(diffs)} THEN 't1' ELSE 'same' END AS a
                FROM (SELECT * FROM {prev} WHERE Cur) d FULL JOIN s{n} s ON d.{key} = s.{key}),
            dim{n} AS (SELECT * FROM {prev} WHERE NOT Cur
                UNION ALL SELECT d.k, {kept}, d.Start, CASE WHEN a = 't2' THEN {t} ELSE d.Finish END, a <> 't2' FROM {prev} d JOIN act{n} ON d.{key} = bk LEFT JOIN s{n} s ON s.{key} = bk WHERE d.Cur
                UNION ALL SELECT (SELECT max(k) FROM {prev}) + row_number() OVER (ORDER BY s.{key}), {fresh_columns}, {new} FROM s{n} s JOIN act{n} ON bk = s.{key} WHERE a IN ('new', 't2'))""")
    return "WITH " + ",\n".join(out)


PRODUCT_DIMS = apply_sql([shapes.product_sql(v) for v in (1, 2, 3)], "ProductID", ["ProductName", "ProductNumber"], list(scd.PRODUCT.type2), modified_counts=True)
SALESPERSON_DIMS = apply_sql([shapes.salesperson_sql(v) for v in (1, 2)], "BusinessEntityID", list(scd.SALESPERSON.type1), list(scd.SALESPERSON.type2), ["HireDate"], empty_is_null=("MiddleName",))

#: After PRODUCT_DIMS: the fact with its measures.
FACT = f"""{PRODUCT_DIMS},
    cdim AS (SELECT row_number() OVER (ORDER BY CustomerID) AS ck, CustomerID AS cid FROM ({shapes.CUSTOMER_SQL})),
    tdim AS (SELECT row_number() OVER (ORDER BY TerritoryID) AS tk, * FROM ({shapes.TERRITORY_SQL})),
    pdim AS ({SALESPERSON_DIMS} SELECT * FROM dim2),
    raw AS (SELECT l.*, coalesce(d.k, -1) AS ProductKey, CASE WHEN l.OrderDate >= TIMESTAMP '1995-07-01' THEN coalesce(tk, -1) ELSE -1 END AS TerritoryKey, coalesce(p.k, -1) AS SalesPersonKey, CASE WHEN l.OrderDate >= TIMESTAMP '1995-07-01' THEN coalesce(ck, -1) ELSE -1 END AS CustomerKey, d.StandardCost, CAST(OrderQty * UnitPrice AS DECIMAL(19,4)) AS GrossAmount,
            CAST(OrderQty * UnitPrice * UnitPriceDiscount AS DECIMAL(19,4)) AS DiscountAmount
        FROM ({shapes.LINES_SQL}) l LEFT JOIN dim3 d ON d.ProductID = l.ProductID AND l.OrderDate >= d.Start AND l.OrderDate < d.Finish LEFT JOIN cdim ON cid = l.CustomerID
        LEFT JOIN tdim t ON t.TerritoryID = l.TerritoryID LEFT JOIN pdim p ON p.BusinessEntityID = l.SalesPersonID AND l.OrderDate >= p.Start AND l.OrderDate < p.Finish),
    fact AS (SELECT *, CAST(GrossAmount - DiscountAmount AS DECIMAL(19,4)) AS NetAmount, CAST(OrderQty * StandardCost AS DECIMAL(19,4)) AS TotalCost,
            CAST(GrossAmount - DiscountAmount - OrderQty * StandardCost AS DECIMAL(19,4)) AS GrossProfit,
            CAST(strftime(OrderDate, '%Y%m%d') AS INT) AS OrderDateKey, CAST(strftime(DueDate, '%Y%m%d') AS INT) AS DueDateKey, coalesce(CAST(strftime(ShipDate, '%Y%m%d') AS INT), -1) AS ShipDateKey FROM raw)"""
