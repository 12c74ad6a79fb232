"""A database as a source: Derby, which comes with Spark, holding a copy of the orders."""

import datetime as dt

from pyspark.sql import functions as F

from starmodel.sources.tables import read_database, read_jdbc

SMALL = "/root/testdata/sf0.001"


def test_ranges_and_watermark(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    orders.write.format("jdbc").option("url", f"{url};create=true").option("dbtable", "orders").options(**driver).save()
    n = orders.count()
    whole = read_database(spark, url, "orders", '"o_orderkey"', rows=-(-n // 4), **driver)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == n
    sizes = [len(p) for p in whole.select("o_orderkey").rdd.glom().collect()]
    assert max(sizes) < 2 * n / 4
    mark = dt.datetime(1997, 1, 1)
    late = read_database(spark, url, "orders", '"o_orderkey"', since=('"o_orderdate"', f"TIMESTAMP('{mark}')"), rows=200, **driver)
    want = orders.where(F.col("o_orderdate") > F.lit(mark))
    assert sorted(r.o_orderkey for r in late.collect()) == sorted(r.o_orderkey for r in want.collect())
    pushed = read_jdbc(spark, url, "orders", **driver).where(F.col("o_custkey") > 100).select("o_orderkey")
    assert "PushedFilters: [*IsNotNull(o_custkey), *GreaterThan(o_custkey,100)]" in pushed._jdf.queryExecution().toString()
    assert pushed.count() == orders.where("o_custkey > 100").count()
    none = read_database(spark, url, "orders", '"o_orderkey"', since=('"o_orderdate"', "TIMESTAMP('2100-01-01 00:00:00')"), **driver)
    assert none.count() == 0 and none.columns == orders.columns
