"""Snapshots in parts: what is written, what readers see, what a rerun does."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starmodel.operators import fact, load, runlog, scd
from starmodel.plans import shapes, warehouse
from starmodel.sources.store import SnapshotStore

SMALL = "/root/testdata/sf0.001"
SPEC = scd.DimensionSpec("d", "id", "key", ("name",), ("price",))
T = [dt.datetime(2020, m, 1) for m in range(1, 7)]


def table(spark, pairs):
    return spark.createDataFrame(pairs, "p string, n long")


def content(df):
    return sorted((r.p, r.n) for r in df.collect())


def test_parts_are_replaced_added_or_left(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.write_parts("t", table(spark, [("a", 1), ("b/=%", 2), ("c", 3)]), "p")
    old = store.read("t")
    store.write_parts("t", table(spark, [("a", 10), ("b/=%", 20)]), "p", replace=["a", "c"])
    assert content(store.read("t")) == [("a", 10), ("b/=%", 2), ("b/=%", 20)]
    assert content(old) == content(store.read("t", 1)) == [("a", 1), ("b/=%", 2), ("c", 3)]
    assert content(store.read("t", parts=["a", "nothing"])) == [("a", 10)] and store.read("t", parts=[]).count() == 0
    parts = [store._marker("t", v)["parts"] for v in (1, 2)]
    assert parts[1]["b/=%"][0] == parts[0]["b/=%"][0] and "c" not in parts[1]
    store.write_parts("t", table(spark, [("z", 1)]), "p", replace=["z"])
    store.drop_before("t", keep=2)
    assert store.versions("t") == [2, 3] and content(store.read("t", 2)) == [("a", 10), ("b/=%", 2), ("b/=%", 20)]
    with pytest.raises(Exception):
        old.collect()  # its own files are gone


def staged(spark, pairs):
    df = spark.createDataFrame([(i, f"n{i}", p, T[0]) for i, p in pairs], "id long, name string, price int, SourceModifiedDate timestamp_ntz")
    return df.withColumn("RowHash", F.sha2(F.col("price").cast("string"), 256))


def versions(dim):
    return sorted((r.id, r.price, r.EffectiveStartDateTime.month, r.IsCurrent) for r in dim.collect())


def test_a_load_writes_its_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    one = [(i, i % 5) for i in range(1000)]
    assert scd.load_parts(store, SPEC, staged(spark, one), T[0], buckets=64)["new"] == 1000
    two = [(i, 9 if i % 100 == 1 else i % 5) for i in range(0, 1000)]
    found = scd.load_parts(store, SPEC, staged(spark, two), T[1])
    assert found["t2"] == 10 and found["same"] == 990
    before, after = (store._marker("d", v)["parts"] for v in (1, 2))
    changed = [p for p in after if after[p] != before.get(p)]
    assert 2 <= len(changed) <= 20 and len(before) == 64
    # history is added to, not written again; the third load ends some of the same keys
    scd.load_parts(store, SPEC, staged(spark, [(1, 7), (2000, 1)]), T[2], gone=spark.createDataFrame([(5,), (77777,)], "id long"))
    last = store.marker("d")["parts"]
    assert all(last[p][: len(f)] == f for p, f in after.items() if p.startswith("h"))
    # the same as whole loads
    dim, _ = scd.apply_scd(scd.empty_dimension(staged(spark, one), SPEC), staged(spark, one), SPEC, T[0])
    dim, _ = scd.apply_scd(dim, staged(spark, two), SPEC, T[1])
    assert versions(store.read("d", 2)) == versions(dim)
    dim, _ = scd.apply_scd(dim, staged(spark, [(1, 7), (2000, 1)]), SPEC, T[2])
    want = [(i, p, m, c and i != 5) for i, p, m, c in versions(dim)]
    assert versions(store.read("d")) == want
    keys = [r.key for r in store.read("d").collect()]
    assert sorted(keys) == list(range(1, 1013)) and store.marker("d")["top"] == 1012
    n = store.read("d").count()
    assert scd.load_parts(store, SPEC, staged(spark, [(1, 7)]), T[3])["same"] == 1 and store.read("d").count() == n
    with pytest.raises(ValueError, match="not later"):
        scd.load_parts(store, SPEC, staged(spark, [(1, 8)]), T[1])
    with pytest.raises(ValueError, match="1 staged keys"):
        scd.load_parts(store, SPEC, staged(spark, [(1, 7), (1, 8), (3, 3)]), T[4])
    assert store.read("d").count() == n


@pytest.mark.parametrize("change", [{}, {"price": 99}, {"name": "other"}])
def test_repeated_keys_whatever_they_would_do(spark, change):
    rows = staged(spark, [(1, 1), (2, 2), (3, 3)])
    dim, _ = scd.apply_scd(scd.empty_dimension(rows, SPEC), rows, SPEC, T[0])
    again = rows.where("id = 1").withColumns({c: F.lit(v) for c, v in change.items()}).withColumn("RowHash", F.sha2(F.col("price").cast("string"), 256))
    with pytest.raises(ValueError, match="1 staged keys of d are null or repeated"):
        scd.apply_scd(dim, rows.unionByName(again), SPEC, T[1])


def test_a_run_counts_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    good, bad = shapes.staged_territory(spark, SMALL)
    for _ in range(2):
        load.run_load(store, scd.TERRITORY, 4, "nation", lambda: (good, bad), T[0])
    assert load.run_log(store).count() == 2 and len(store.versions("territory")) == 1
    assert load.stored_rejects(store).count() == bad.count()

    def broken():
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        load.run_load(store, scd.TERRITORY, 5, "nation", broken, T[1])
    load.run_load(store, scd.TERRITORY, 5, "nation", lambda: (good, bad), T[1])  # under its id again
    assert [r.Status for r in load.run_log(store).where("ExecutionID = 5").orderBy("EndTime").collect()].count("Succeeded") == 1
    assert load.stored_rejects(store).where("ExecutionID = 5").count() == bad.count()
    # the log's last row is lost after the switch
    lost = SnapshotStore(spark, f"file://{tmp_path}/lost")
    append = lost.append

    def failing(table, df):
        if table == load.LOG and df.where("Status = 'Succeeded'").count():
            raise OSError("no space")
        append(table, df)

    lost.append = failing
    with pytest.raises(OSError):
        load.run_load(lost, scd.TERRITORY, 1, "nation", lambda: (good, None), T[0])
    lost.append = append
    assert {r.Status for r in load.run_log(lost).collect()} == {"Running"} and lost.versions("territory") == [1]
    load.run_load(lost, scd.TERRITORY, 1, "nation", lambda: (good, None), T[0])
    state = runlog.run_state(load.run_log(lost)).first()
    assert (state.Status, state.RowsInserted) == ("Succeeded", good.count()) and lost.versions("territory") == [1]


def test_publish_is_pruned_and_switched(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    out = warehouse.sales_fact(spark, SMALL)
    fact.publish(store, "sales", out)
    reader = store.read("sales")
    plan = reader.where("OrderMonth = '1997-03'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(OrderMonth" in plan
    n = out.count()
    fact.publish(store, "sales", out.where("OrderDate < '1997-04-01'"), ["1997-03", "1997-04"])
    assert reader.count() == n  # who has begun to read sees what was there
    gone = out.where("OrderDate >= '1997-04-01' AND OrderDate < '1997-05-01'").count()
    assert gone and store.read("sales").count() == n - gone
    one, two = (store._marker("sales", v)["parts"] for v in (1, 2))
    assert {p for p in one if one[p] != two.get(p)} == {"1997-03", "1997-04"}
