"""Staging: source tables joined, cleaned, classified and fingerprinted.

Each transform gives one row for each business key in its current state. Rows
that cannot be staged come back as rejects with their reasons instead of getting
lost in an inner join or failing the load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.functions.clean import blank_to_null, full_name, to_second
from starmodel.functions.rowhash import row_hash
from starmodel.sources.schema import MONEY, RATE, STAGING, required

UNCATEGORIZED, UNKNOWN_CUSTOMER = "Uncategorized", "Unknown Customer"

#: The fields that are hashed, in order.
PRODUCT_HASH = ("Color", "Size", "StandardCost", "ListPrice", "SubcategoryName", "CategoryName", "SellStartDate", "SellEndDate", "DiscontinuedDate")
CUSTOMER_HASH = ("CustomerType", "CustomerName", "FirstName", "MiddleName", "LastName", "StoreName", "AccountNumber")
TERRITORY_HASH = ("CountryRegionCode", "TerritoryGroup")
SALESPERSON_HASH = ("JobTitle", "CurrentFlag", "SalesQuota", "Bonus", "CommissionPct")


def _stamp(load_ts: dt.datetime) -> Column:
    """One load time for all rows of a run."""
    return F.lit(load_ts.isoformat(sep=" ")).cast(T.TimestampNTZType())


def stage_product(product: DataFrame, subcategory: DataFrame, category: DataFrame, load_ts: dt.datetime, layout: str = "named", charset: str = "UTF-8") -> DataFrame:
    """Products with the names of their subcategory and category."""
    sub = subcategory.select(F.col("ProductSubcategoryID"), F.col("ProductCategoryID"), F.col("Name").alias("_sub"))
    cat = category.select(F.col("ProductCategoryID"), F.col("Name").alias("_cat"))
    joined = product.join(sub, "ProductSubcategoryID", "left").join(cat, "ProductCategoryID", "left")
    out = joined.select(
        "ProductID", F.col("Name").alias("ProductName"), "ProductNumber", "Color", "Size", F.col("StandardCost").cast(MONEY).alias("StandardCost"), F.col("ListPrice").cast(MONEY).alias("ListPrice"),
        F.coalesce("_sub", F.lit(UNCATEGORIZED)).alias("SubcategoryName"), F.coalesce("_cat", F.lit(UNCATEGORIZED)).alias("CategoryName"), "SellStartDate", "SellEndDate", "DiscontinuedDate",
        F.col("ModifiedDate").alias("SourceModifiedDate"),
    )
    return out.select("*", row_hash(out, PRODUCT_HASH, layout, charset, lead=True).alias("RowHash"), _stamp(load_ts).alias("ExtractedAt"))


def stage_customer(customer: DataFrame, person: DataFrame, store: DataFrame, load_ts: dt.datetime, layout: str = "named", charset: str = "UTF-8") -> DataFrame:
    """Customers as stores or individuals; a store id outranks a person id, and
    a store's contact changes neither its attributes nor its modified date."""
    p = person.select(F.col("BusinessEntityID").alias("PersonID"), "PersonType", "FirstName", "MiddleName", "LastName", F.col("ModifiedDate").alias("_pm"))
    s = store.select(F.col("BusinessEntityID").alias("StoreID"), F.col("Name").alias("_store"), F.col("ModifiedDate").alias("_sm"))
    joined = customer.join(p, "PersonID", "left").join(s, "StoreID", "left")
    is_store, has_person = F.col("StoreID").isNotNull(), F.col("PersonID").isNotNull()
    of_person = lambda c: F.when(~is_store & has_person, F.col(c)).alias(c)
    name = (
        F.when(is_store, F.coalesce(blank_to_null(F.col("_store")), F.lit(UNKNOWN_CUSTOMER)))
        .when(has_person, full_name(F.col("FirstName"), F.col("MiddleName"), F.col("LastName"), UNKNOWN_CUSTOMER))
        .otherwise(F.lit(UNKNOWN_CUSTOMER))
    )
    modified = F.when(is_store, F.greatest("ModifiedDate", "_sm")).when(has_person, F.greatest("ModifiedDate", "_pm")).otherwise(F.col("ModifiedDate"))
    out = joined.select(
        "CustomerID", "PersonID", "StoreID", "PersonType", F.when(is_store, "Store").when(has_person, "Individual").otherwise("Unknown").alias("CustomerType"), name.alias("CustomerName"), of_person("FirstName"),
        of_person("MiddleName"), of_person("LastName"), F.when(is_store, F.col("_store")).alias("StoreName"), "AccountNumber", modified.alias("SourceModifiedDate"),
    )
    return out.select("*", _stamp(load_ts).alias("ExtractedAt"), row_hash(out, CUSTOMER_HASH, layout, charset).alias("RowHash"))


def split_missing(df: DataFrame, contract: dict, extra: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with `reject_reasons`: `extra` (a text
    or null) and the columns that may not be null but are."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required(contract) if c in df.columns]
    marked = df.withColumn("reject_reasons", F.array_compact(F.array(*([extra] if extra is not None else []), *reasons)))
    return marked.where(F.size("reject_reasons") == 0).drop("reject_reasons"), marked.where(F.size("reject_reasons") > 0)


def stage_territory(territory: DataFrame, country: DataFrame, load_ts: dt.datetime, layout: str = "named", charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Territories with the name of their country; and those without a country,
    or with a blank where a value is needed."""
    c = country.select("CountryRegionCode", F.col("Name").alias("_country"), F.col("ModifiedDate").alias("_cm"), F.lit(True).alias("_found"))
    joined = territory.join(c, "CountryRegionCode", "left")
    out = joined.select(
        "TerritoryID", blank_to_null(F.col("Name")).alias("TerritoryName"), blank_to_null(F.col("CountryRegionCode")).alias("CountryRegionCode"), blank_to_null(F.col("_country")).alias("CountryRegionName"),
        blank_to_null(F.col("Group")).alias("TerritoryGroup"), F.greatest("ModifiedDate", "_cm").alias("SourceModifiedDate"), "_found",
    )
    out = out.select("*", _stamp(load_ts).alias("ExtractedAt"), row_hash(out, TERRITORY_HASH, layout, charset).alias("RowHash"))
    good, bad = split_missing(out, STAGING["territory"], F.when(F.col("_found").isNull(), F.lit("no such country")))
    return good.drop("_found"), bad.drop("_found")


def stage_salesperson(salesperson: DataFrame, person: DataFrame, employee: DataFrame, load_ts: dt.datetime, layout: str = "named", charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Sales persons with their names and employment; and those who are not
    among the persons or the employees, or lack a value that is needed."""
    key = "BusinessEntityID"
    p = person.select(key, "FirstName", "MiddleName", "LastName", F.col("ModifiedDate").alias("_pm"), F.lit(True).alias("_person"))
    e = employee.select(key, "JobTitle", "HireDate", "CurrentFlag", F.col("ModifiedDate").alias("_em"), F.lit(True).alias("_employee"))
    joined = salesperson.join(p, key, "left").join(e, key, "left")
    out = joined.select(
        key, full_name(F.col("FirstName"), F.col("MiddleName"), F.col("LastName")).alias("SalesPersonName"), *[blank_to_null(F.col(c)).alias(c) for c in ("FirstName", "MiddleName", "LastName", "JobTitle")],
        "HireDate", F.col("CurrentFlag").cast("boolean").alias("CurrentFlag"), F.col("SalesQuota").cast(MONEY).alias("SalesQuota"), F.col("Bonus").cast(MONEY).alias("Bonus"), F.col("CommissionPct").cast(RATE).alias("CommissionPct"),
        "TerritoryID", F.greatest(to_second(F.col("ModifiedDate")), to_second(F.col("_pm")), to_second(F.col("_em"))).alias("SourceModifiedDate"), "_person", "_employee",
    )
    out = out.select("*", _stamp(load_ts).alias("ExtractedAt"), row_hash(out, SALESPERSON_HASH, layout, charset).alias("RowHash"))
    reason = F.when(F.col("_person").isNull(), F.lit("no such person")).when(F.col("_employee").isNull(), F.lit("no such employee"))
    good, bad = split_missing(out, STAGING["salesperson"], reason)
    return good.drop("_person", "_employee"), bad.drop("_person", "_employee")
