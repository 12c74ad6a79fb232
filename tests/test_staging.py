import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from starmodel.functions import clean
from starmodel.functions.rowhash import hash_text, row_hash
from starmodel.operators import quality, staging
from starmodel.sources.schema import SOURCES, conform, struct

T0, T1, T2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 1)
LOAD = dt.datetime(2021, 1, 1)


def make(spark, name, rows):
    return spark.createDataFrame(rows, struct({c: (k, True) for c, (k, _) in SOURCES[name].items()}))


def customers(spark, contact=T1, contact_name="Ann"):
    c = make(spark, "customer", [(1, 10, None, 1, "A1", T0), (2, 10, 20, 1, "A2", T0), (3, None, 20, 1, "A3", T0), (4, None, None, 1, "A4", T0), (5, 11, None, 1, "A5", T0), (6, None, 21, 1, "A6", T0)])
    p = make(spark, "person", [(10, "IN", f" {contact_name} ", None, "Lee", contact), (11, "IN", " ", "", "  ", T0)])
    s = make(spark, "store", [(20, " Shop ", T2), (21, "  ", T0)])
    return {r.CustomerID: r for r in staging.stage_customer(c, p, s, LOAD).collect()}


def test_customer_kinds(spark):
    got = customers(spark)
    assert [(got[i].CustomerType, got[i].CustomerName) for i in range(1, 7)] == [
        ("Individual", "Ann Lee"), ("Store", "Shop"), ("Store", "Shop"), ("Unknown", "Unknown Customer"), ("Individual", "Unknown Customer"), ("Store", "Unknown Customer"),
    ]
    assert got[1].FirstName == " Ann " and got[2].FirstName is None and got[2].StoreName == " Shop " and got[1].StoreName is None
    assert [got[i].SourceModifiedDate for i in (1, 2, 4)] == [T1, T2, T0]


def test_store_contact_changes_nothing(spark):
    before, after = customers(spark), customers(spark, dt.datetime(2022, 1, 1), "Eve")
    assert before[2].RowHash == after[2].RowHash and before[2].SourceModifiedDate == after[2].SourceModifiedDate
    assert before[1].RowHash != after[1].RowHash


def test_uncategorized(spark):
    row = lambda i, sub: (i, "n", "no", None, None, Decimal("1.5"), Decimal("2"), sub, T0, None, None, T0)
    p = make(spark, "product", [row(1, 5), row(2, None), row(3, 6)])
    sub = make(spark, "product_subcategory", [(5, 1, "Sub"), (6, 9, "Lost")])
    cat = make(spark, "product_category", [(1, "Cat")])
    got = {r.ProductID: (r.SubcategoryName, r.CategoryName) for r in staging.stage_product(p, sub, cat, LOAD).collect()}
    assert got == {1: ("Sub", "Cat"), 2: ("Uncategorized", "Uncategorized"), 3: ("Lost", "Uncategorized")}


def test_territory_rejects(spark):
    t = make(spark, "sales_territory", [(1, " West ", "US", "NA", T0), (2, "Lost", "XX", "NA", T0), (3, "  ", "US", " ", T0)])
    c = make(spark, "country_region", [("US", "United States", T1)])
    good, bad = staging.stage_territory(t, c, LOAD)
    assert [(r.TerritoryName, r.SourceModifiedDate) for r in good.collect()] == [("West", T1)]
    assert {r.TerritoryID: r.reject_reasons for r in bad.collect()} == {2: ["no such country", "CountryRegionName is missing"], 3: ["TerritoryName is missing", "TerritoryGroup is missing"]}


def salespeople(spark, quota):
    sp = make(spark, "sales_person", [(1, 1, quota, Decimal("10"), Decimal("0.1"), dt.datetime(2020, 1, 1, 0, 0, 0, 600_000)), (2, 1, None, Decimal("1"), Decimal("0"), T0)])
    p = make(spark, "person", [(1, "SP", " A", None, "B ", T0), (2, "SP", "C", None, "D", T0)])
    e = make(spark, "employee", [(1, " Rep ", dt.date(2010, 1, 1), True, T0)])
    return staging.stage_salesperson(sp, p, e, LOAD)


def test_salesperson(spark):
    good, bad = salespeople(spark, None)
    r = good.first()
    assert (r.SalesPersonName, r.FirstName, r.JobTitle, r.SourceModifiedDate) == ("A B", "A", "Rep", dt.datetime(2020, 1, 1, 0, 0, 1))
    assert bad.first().reject_reasons[0] == "no such employee"
    assert r.RowHash != salespeople(spark, Decimal("0"))[0].first().RowHash


def test_hash_text_forms(spark):
    df = spark.createDataFrame([("a|Size=b", None, True, Decimal("133.34"), dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2, 3, 4, 5, 120_000))], "Color string, Size string, Flag boolean, Cost decimal(19,4), At timestamp_ntz, Exact timestamp_ntz")
    text = df.select(hash_text(df, ["Color", "Size", "Flag", "Cost", "At", "Exact"])).first()[0]
    assert text == "Color=a|Size=b|Size=<NULL>|Flag=1|Cost=133.3400|At=2020-01-02T03:04:05|Exact=2020-01-02T03:04:05.120"


def test_separator_in_a_value(spark):
    df = spark.createDataFrame([("a|Size=b", "c"), ("a", "b|Size=c"), ("<NULL>", None), (None, "<NULL>")], "Color string, Size string")
    named = [r[0] for r in df.select(row_hash(df, ["Color", "Size"])).collect()]
    safe = [r[0] for r in df.select(row_hash(df, ["Color", "Size"], "safe")).collect()]
    assert named[2] == named[3] and len(set(safe)) == 4
    assert df.select(row_hash(df, ["Color"], charset="UTF-16LE")).first()[0] != named[0]
    with pytest.raises(ValueError):
        row_hash(df, ["Color"], "other")


def test_column_functions(spark):
    df = spark.createDataFrame([(" x ", None, "b", dt.date(2020, 12, 31), dt.date(2021, 1, 1))], "a string, n string, b string, d date, e date")
    r = df.select(
        clean.blank_to_null(F.lit("  ")).alias("blank"), clean.join_text(F.col("a"), F.col("n"), F.col("b")).alias("joined"), clean.full_name(F.col("n"), F.col("n"), F.col("n")).alias("empty"),
        clean.differs(F.col("n"), F.lit("")).alias("d1"), clean.differs(F.col("n"), F.lit(""), True).alias("d2"), clean.years_apart(F.col("d"), F.col("e")).alias("years"), clean.date_key(F.col("d")).alias("key"),
        clean.margin_pct(F.lit(0.0), F.lit(1.0)).alias("margin"),
    ).first()
    assert tuple(r) == (None, " x b", "", True, False, 1, 20201231, None)


def test_contract(spark):
    df = spark.createDataFrame([(1, "x")], "ProductCategoryID int, Name string")
    assert conform(df, SOURCES["product_category"]).dtypes == [("ProductCategoryID", "bigint"), ("Name", "string")]
    with pytest.raises(ValueError, match="missing columns: Name"):
        conform(df.drop("Name"), SOURCES["product_category"])


def test_split_rejects(spark):
    df = spark.createDataFrame([(1, -1), (2, 5), (3, None)], "id int, v int")
    good, bad = quality.split_rejects(df, {"negative": F.col("v") < 0, "null": F.col("v").isNull()})
    assert [r.id for r in good.collect()] == [2] and {r.id: r.reject_reasons for r in bad.collect()} == {1: ["negative"], 3: ["null"]}
