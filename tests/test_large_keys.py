"""Product loads where parts have keys of over a million."""

import duckdb
import pytest
from pyspark.sql import functions as F

from starmodel.plans import registry, shapes

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("step, want", [(999_000, 1_000_000), (1_000_000, 2_000_000), (3_000_000, 1_000_000)])
def test_new_keys_are_new(spark, step, want):
    part = spark.createDataFrame([(i + c * step,) for i in range(20) for c in range(2)], "p_partkey long")
    assert shapes.new_key_step(part) == want


def test_loads_with_large_keys(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    for name in ("a2_load_actions", "a2_load_totals", "c17_current_members", "c13_rerun_changes_nothing"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        # the SQL's own new keys are there already, so it is asked with others
        result = con.execute(registry.ORACLE_SQL[name].replace("id + 1000000", "id + 2000000"))
        names = [d[0] for d in result.description]
        assert sorted(df.select(*names).collect(), key=repr) == sorted(result.fetchall(), key=repr)
