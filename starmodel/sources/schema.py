"""Contracts of the source, staging and log tables, and how rows are brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY, RATE = T.DecimalType(19, 4), T.DecimalType(10, 4)
STAMP = T.TimestampNTZType()

#: Each contract: column name -> (type, may be null).
_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.BooleanType()

SOURCES = {
    "product": {
        "ProductID": (_L, False), "Name": (_S, False), "ProductNumber": (_S, False), "Color": (_S, True), "Size": (_S, True), "StandardCost": (MONEY, False), "ListPrice": (MONEY, False),
        "ProductSubcategoryID": (_L, True), "SellStartDate": (STAMP, False), "SellEndDate": (STAMP, True), "DiscontinuedDate": (STAMP, True), "ModifiedDate": (STAMP, False),
    },
    "product_subcategory": {"ProductSubcategoryID": (_L, False), "ProductCategoryID": (_L, False), "Name": (_S, False)},
    "product_category": {"ProductCategoryID": (_L, False), "Name": (_S, False)},
    "customer": {"CustomerID": (_L, False), "PersonID": (_L, True), "StoreID": (_L, True), "TerritoryID": (_L, True), "AccountNumber": (_S, False), "ModifiedDate": (STAMP, False)},
    "person": {"BusinessEntityID": (_L, False), "PersonType": (_S, False), "FirstName": (_S, False), "MiddleName": (_S, True), "LastName": (_S, False), "ModifiedDate": (STAMP, False)},
    "store": {"BusinessEntityID": (_L, False), "Name": (_S, False), "ModifiedDate": (STAMP, False)},
    "sales_territory": {"TerritoryID": (_L, False), "Name": (_S, False), "CountryRegionCode": (_S, False), "Group": (_S, False), "ModifiedDate": (STAMP, False)},
    "country_region": {"CountryRegionCode": (_S, False), "Name": (_S, False), "ModifiedDate": (STAMP, False)},
    "sales_person": {"BusinessEntityID": (_L, False), "TerritoryID": (_L, True), "SalesQuota": (MONEY, True), "Bonus": (MONEY, False), "CommissionPct": (RATE, False), "ModifiedDate": (STAMP, False)},
    "employee": {"BusinessEntityID": (_L, False), "JobTitle": (_S, False), "HireDate": (_D, False), "CurrentFlag": (_B, False), "ModifiedDate": (STAMP, False)},
    "sales_order_header": {
        "SalesOrderID": (_L, False), "OrderDate": (STAMP, False), "DueDate": (STAMP, False), "ShipDate": (STAMP, True), "CustomerID": (_L, False), "SalesPersonID": (_L, True), "TerritoryID": (_L, True),
        "SubTotal": (MONEY, False), "TaxAmt": (MONEY, False), "Freight": (MONEY, False),
    },
    "sales_order_detail": {
        "SalesOrderID": (_L, False), "SalesOrderDetailID": (_L, False), "OrderQty": (_I, False), "ProductID": (_L, False), "UnitPrice": (MONEY, False), "UnitPriceDiscount": (MONEY, False), "LineTotal": (T.DecimalType(38, 6), True),
    },
}

STAGING = {
    "product": {
        "ProductID": (_L, False), "ProductName": (_S, False), "ProductNumber": (_S, False), "Color": (_S, True), "Size": (_S, True), "StandardCost": (MONEY, False), "ListPrice": (MONEY, False), "SubcategoryName": (_S, False),
        "CategoryName": (_S, False), "SellStartDate": (STAMP, False), "SellEndDate": (STAMP, True), "DiscontinuedDate": (STAMP, True), "SourceModifiedDate": (STAMP, False), "RowHash": (_S, False), "ExtractedAt": (STAMP, False),
    },
    "customer": {
        "CustomerID": (_L, False), "PersonID": (_L, True), "StoreID": (_L, True), "PersonType": (_S, True), "CustomerType": (_S, False), "CustomerName": (_S, False), "FirstName": (_S, True), "MiddleName": (_S, True),
        "LastName": (_S, True), "StoreName": (_S, True), "AccountNumber": (_S, False), "SourceModifiedDate": (STAMP, False), "ExtractedAt": (STAMP, False), "RowHash": (_S, False),
    },
    "territory": {
        "TerritoryID": (_L, False), "TerritoryName": (_S, False), "CountryRegionCode": (_S, False), "CountryRegionName": (_S, False), "TerritoryGroup": (_S, False), "SourceModifiedDate": (STAMP, False), "ExtractedAt": (STAMP, False),
        "RowHash": (_S, False),
    },
    "salesperson": {
        "BusinessEntityID": (_L, False), "SalesPersonName": (_S, False), "FirstName": (_S, False), "MiddleName": (_S, True), "LastName": (_S, False), "JobTitle": (_S, False), "HireDate": (_D, False), "CurrentFlag": (_B, False),
        "SalesQuota": (MONEY, True), "Bonus": (MONEY, False), "CommissionPct": (RATE, False), "TerritoryID": (_L, True), "SourceModifiedDate": (STAMP, False), "ExtractedAt": (STAMP, False), "RowHash": (_S, False),
    },
}

RUN_LOG = {
    "ExecutionID": (_L, False), "ProcessName": (_S, False), "SourceObject": (_S, True), "TargetObject": (_S, True), "StartTime": (STAMP, False), "EndTime": (STAMP, True), "Status": (_S, False),
    "RowsRead": (_L, True), "RowsInserted": (_L, True), "RowsUpdated": (_L, True), "RowsRejected": (_L, True), "ErrorMessage": (_S, True), "ExecutedBy": (_S, True),
}

REJECTS = {"ExecutionID": (_L, False), "TargetObject": (_S, False), "Reasons": (_S, False), "RejectedRow": (_S, False)}


def struct(contract: dict) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, (kind, nullable) in contract.items()])


def conform(df: DataFrame, contract: dict) -> DataFrame:
    """The contract's columns in order and type; others are dropped, and a
    column that is missing is an error. A null where none may be is an error of
    the task that comes upon it, for columns that the input says may be null."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    nullable = {f.name for f in df.schema.fields if f.nullable}

    def column(c: str) -> Column:
        kind, may_be_null = contract[c]
        value = F.col(c).cast(kind)
        return (value if may_be_null or c not in nullable else F.coalesce(value, F.raise_error(F.lit(f"{c} is null")).cast(kind))).alias(c)

    return df.select(*[column(c) for c in contract])


def required(contract: dict) -> list[str]:
    return [c for c, (_, nullable) in contract.items() if not nullable]
