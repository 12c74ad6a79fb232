import datetime as dt

import pytest
from pyspark.sql import functions as F

from starmodel.operators import fact, load, runlog, scd
from starmodel.plans import registry, shapes
from starmodel.sources import shared
from starmodel.sources.schema import conform
from starmodel.sources.store import SnapshotStore
from starmodel.sources.tables import source

SMALL = "/root/testdata/sf0.001"
T = [dt.datetime(2024, 1, n) for n in (1, 2, 3)]


def test_failed_load_is_logged_and_raised(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    good = shapes.staged_product(spark, SMALL, 1)
    load.run_load(store, scd.PRODUCT, 1, "part", lambda: (good, None), T[0], lambda: T[0])

    def broken():
        raise RuntimeError("no such source")

    with pytest.raises(RuntimeError):
        load.run_load(store, scd.PRODUCT, 2, "part", broken, T[1], lambda: T[1])
    with pytest.raises(ValueError, match="null or repeated"):
        load.run_load(store, scd.PRODUCT, 3, "part", lambda: (good.union(good.limit(1)), None), T[2], lambda: T[2])
    log = load.run_log(store)
    assert log.count() == 6
    state = {r.ExecutionID: r for r in runlog.run_state(log).collect()}
    assert [state[i].Status for i in (1, 2, 3)] == ["Succeeded", "Failed", "Failed"]
    assert state[2].ErrorMessage == "RuntimeError: no such source" and state[1].ExecutedBy
    assert store.versions("product") == [1] and store.read("staging_product").columns == good.columns


def test_null_key_is_refused(spark):
    staged = shapes.staged_product(spark, SMALL, 1)
    none = staged.limit(1).withColumn("ProductID", F.lit(None).cast("long"))
    with pytest.raises(ValueError):
        scd.apply_scd(scd.empty_dimension(staged, scd.PRODUCT), staged.union(none), scd.PRODUCT, T[0])


def test_guard_of_the_fact(spark):
    detail, header = shapes.order_sources(spark, SMALL)
    staged = shapes.staged_product(spark, SMALL, 1)
    dim, _ = scd.apply_scd(scd.empty_dimension(staged, scd.PRODUCT), staged, scd.PRODUCT, dt.datetime(1990, 1, 1))
    n = detail.join(header, "SalesOrderID").count()
    assert fact.load_fact(detail, header, dim, scd.PRODUCT, guard=True).count() == n
    with pytest.raises(ValueError, match="several rows"):
        fact.load_fact(detail, header, dim.union(dim.limit(3)), scd.PRODUCT, guard=True)


def test_null_where_none_may_be(spark):
    row = spark.createDataFrame([(1, 2, None)], "ProductSubcategoryID long, ProductCategoryID long, Name string")
    with pytest.raises(Exception, match="Name is null"):
        source(row, "product_subcategory").collect()
    with pytest.raises(ValueError, match="missing"):
        conform(row.drop("Name"), {"Name": (row.schema["Name"].dataType, False)})


def test_scratch(spark):
    with shared.scratch(spark):
        gone, stays = shared.materialize(spark.range(3), "x"), shared.keep(spark.range(4), "y")
    assert stays.count() == 4
    with pytest.raises(Exception):
        gone.collect()


def test_two_writers_have_versions_of_their_own(spark, tmp_path):
    one, two = (SnapshotStore(spark, f"file://{tmp_path}") for _ in range(2))
    assert one._claimed(f"file://{tmp_path}/t/v1.claim") and not two._claimed(f"file://{tmp_path}/t/v1.claim")
    assert two.write("t", spark.range(2)) == 2 and one.read("t").count() == 2


def test_repeated_keys_stage_parts_once(spark, monkeypatch):
    seen, run_load = [], load.run_load

    def watched(store, spec, execution_id, source, extract, load_ts):
        seen.append({f.rpartition("/")[2] for f in extract()[0].inputFiles()})
        run_load(store, spec, execution_id, source, extract, load_ts)

    monkeypatch.setattr(load, "run_load", watched)
    assert registry.QUERIES["c1_repeated_keys"](spark, SMALL).count() == 8
    assert len(seen) == 8 and not any("part.parquet" in files for files in seen)


def test_whole_fact_is_not_counted_by_grain(spark, tmp_path, monkeypatch):
    store, detail_header, counted = SnapshotStore(spark, f"file://{tmp_path}"), shapes.order_sources(spark, SMALL), []
    staged = shapes.staged_product(spark, SMALL, 1)
    dim, _ = scd.apply_scd(scd.empty_dimension(staged, scd.PRODUCT), staged, scd.PRODUCT, dt.datetime(1990, 1, 1))
    breaks = fact.grain_breaks
    monkeypatch.setattr(fact, "grain_breaks", lambda *given: counted.append(1) or breaks(*given))
    load.run_fact_load(store, 1, "lineitem", lambda: detail_header, dim, scd.PRODUCT)
    assert not counted and store.read("sales").count() == detail_header[0].count()
    twice = dim.union(dim.limit(3))
    with pytest.raises(ValueError, match="several rows"):
        load.run_fact_load(store, 2, "lineitem", lambda: detail_header, twice, scd.PRODUCT)
    assert counted


def test_lines_are_written_once(spark, tmp_path, monkeypatch):
    store, written = SnapshotStore(spark, f"file://{tmp_path}"), []
    staged = shapes.staged_product(spark, SMALL, 1)
    dim, _ = scd.apply_scd(scd.empty_dimension(staged, scd.PRODUCT), staged, scd.PRODUCT, dt.datetime(1990, 1, 1))
    monkeypatch.setattr(load, "materialize", lambda df, name: written.append(name) or shared.materialize(df, name))
    load.run_fact_load(store, 1, "lineitem", lambda: shapes.order_sources(spark, SMALL), dim, scd.PRODUCT)
    assert written == ["lines"]
    want = fact.load_fact(*shapes.order_sources(spark, SMALL), dim, scd.PRODUCT)
    assert store.read("sales").drop("OrderMonth").columns == want.columns and store.read("sales").select(*want.columns).exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="several rows"):
        load.run_fact_load(store, 2, "lineitem", lambda: shapes.order_sources(spark, SMALL), dim.union(dim.limit(3)), scd.PRODUCT)
    assert store.versions("sales") == [1] and len(list((tmp_path / "sales" / "data").glob("w=*"))) == 1
