import datetime as dt

import pytest
from pyspark.sql import functions as F

from starmodel.operators import incremental, lookup, quality, runlog, scd
from starmodel.plans import shapes, warehouse
from starmodel.sources.store import SnapshotStore

SMALL = "/root/testdata/sf0.001"
SPEC = scd.DimensionSpec("d", "id", "key", ("name",), ("price",), null_is_empty=("name",))
T = [dt.datetime(2020, m, 1) for m in range(1, 7)]


def staged(spark, rows, modified=T[0]):
    df = spark.createDataFrame([(i, n, p, modified) for i, n, p in rows], "id long, name string, price int, SourceModifiedDate timestamp_ntz")
    return df.withColumn("RowHash", F.sha2(F.coalesce(F.col("price").cast("string"), F.lit("<NULL>")), 256))


def load(spark, dim, rows, t, spec=SPEC, modified=T[0]):
    s = staged(spark, rows, modified)
    out, counts = scd.apply_scd(scd.empty_dimension(s, spec) if dim is None else dim, s, spec, t)
    return out, {r.action: r.n for r in counts.collect()}


def versions(dim):
    return sorted((r.key, r.id, r["name"], r.price, r.EffectiveStartDateTime.month, r.IsCurrent) for r in dim.collect())


def test_actions_and_versions(spark):
    dim, n = load(spark, None, [(1, "a", 10), (2, "b", 20), (3, None, 30)], T[0])
    assert n == {"new": 3, "t1": 0, "t2": 0, "same": 0, "keep": 0}
    dim, n = load(spark, dim, [(1, "A", 10), (2, "B", 21), (3, "", 30), (4, "d", 40)], T[1])
    assert n == {"new": 1, "t1": 1, "t2": 1, "same": 1, "keep": 0}
    # an ended version keeps the old name, the new one has the latest
    assert versions(dim) == [(1, 1, "A", 10, 1, True), (2, 2, "b", 20, 1, False), (3, 3, None, 30, 1, True), (4, 2, "B", 21, 2, True), (5, 4, "d", 40, 2, True)]
    again, n = load(spark, dim, [(1, "A", 10), (2, "B", 21), (3, "", 30), (4, "d", 40)], T[2])
    assert n == {"new": 0, "t1": 0, "t2": 0, "same": 4, "keep": 0} and versions(again) == versions(dim)
    back, n = load(spark, dim, [(2, "B", 20)], T[3])  # an old value again; the others are absent
    assert n == {"new": 0, "t1": 0, "t2": 1, "same": 0, "keep": 3} and len(versions(back)) == 6
    for check in (quality.check_current_open, quality.check_one_current, quality.check_intervals):
        assert check(back, SPEC).count() == 0


def test_load_time_must_move_on(spark):
    dim, _ = load(spark, None, [(1, "a", 10)], T[1])
    with pytest.raises(ValueError):
        load(spark, dim, [(1, "a", 11)], T[1])


def test_empty_staging_changes_nothing(spark):
    dim, _ = load(spark, None, [(1, "a", 10)], T[0])
    after, n = load(spark, dim, [], T[1])
    assert versions(after) == versions(dim) and n == {"new": 0, "t1": 0, "t2": 0, "same": 0, "keep": 1}


def test_what_an_overwrite_needs(spark):
    rows = [(1, "a", 10)]
    by_date = scd.DimensionSpec("d", "id", "key", ("name",), ("price",), type1_by="modified")
    dim, _ = load(spark, None, rows, T[0])
    assert load(spark, dim, rows, T[1], SPEC, T[1])[1]["same"] == 1
    assert load(spark, dim, rows, T[1], by_date, T[1])[1]["t1"] == 1
    by_hash = scd.DimensionSpec("d", "id", "key", ("name", "price"), type1_by="hash")
    dim, _ = load(spark, None, rows, T[0], by_hash)
    after, n = load(spark, dim, [(1, "b", 11)], T[1], by_hash)
    assert n["t1"] == 1 and versions(after) == [(1, 1, "b", 11, 1, True)]


def test_unknown_member_is_left_alone(spark):
    dim, _ = load(spark, None, [(1, "a", 10)], T[0])
    dim = scd.with_unknown_member(dim, SPEC)
    after, n = load(spark, dim, [(1, "a", 11), (-1, "x", 1)], T[1])
    assert n["keep"] == 0 and n["t2"] == 1 and n["new"] == 1
    assert after.where("key = -1").count() == 1 and {r.key for r in after.collect()} == {-1, 1, 2, 3}
    assert scd.with_unknown_member(after, SPEC).where("key = -1").count() == 1
    assert scd.current_members(after, SPEC).count() == 2


def test_three_snapshots_counts(spark):
    """The counts that the snapshots are made for, at any size: tenths of the keys."""
    n = spark.read.parquet(f"{SMALL}/part.parquet").groupBy((F.col("p_partkey") % 10).alias("m")).count().collect()
    tenth = {r.m: r["count"] for r in n}
    _, dim, counts = warehouse.product_dim(spark, SMALL, 2)
    got = {r.action: r.n for r in counts.collect()}
    assert got == {"new": tenth[9], "t1": tenth[1] + tenth[4], "t2": tenth[0] + tenth[2], "same": sum(tenth[m] for m in (5, 6, 7, 8, 9)), "keep": tenth[3]}
    _, again = scd.apply_scd(dim, shapes.staged_product(spark, SMALL, 2), scd.PRODUCT, dt.datetime(1998, 1, 1))
    assert {r.action: r.n for r in again.collect()} == {"new": 0, "t1": 0, "t2": 0, "same": sum(tenth.values()) - tenth[3] + tenth[9], "keep": tenth[3]}


def test_keys_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = sorted((r.x, r.k) for r in scd.assign_keys(df, ["x"], "k", 5).collect())
    assert got == [(i, i + 5) for i in range(1000)]


def facts(spark):
    rows = [(1, 1, dt.datetime(2019, 12, 31)), (2, 1, T[0]), (3, 1, dt.datetime(2020, 1, 31, 23, 59, 59)), (4, 1, T[1]), (5, 9, T[1]), (6, None, T[1])]
    return spark.createDataFrame(rows, "n int, id long, t timestamp_ntz")


def test_lookup_edges(spark):
    dim, _ = load(spark, None, [(1, "a", 10)], T[0])
    dim, _ = load(spark, dim, [(1, "a", 11)], T[1])
    for small in (lookup.SMALL, 0):
        keep, lookup.SMALL = lookup.SMALL, small
        try:
            got = {r.n: (r.key, r.price) for r in lookup.lookup_key(facts(spark), dim, SPEC, "id", "t", attributes=("price",)).collect()}
            assert got == {1: (-1, None), 2: (1, 10), 3: (1, 10), 4: (2, 11), 5: (-1, None), 6: (-1, None)}
            assert {r.n: r.key for r in lookup.lookup_key(facts(spark), dim, SPEC, "id", "t", before_first="first_version").collect()}[1] == 1
        finally:
            lookup.SMALL = keep
    with pytest.raises(ValueError):
        lookup.lookup_key(facts(spark), dim, SPEC, "id", "t", before_first="never")


def test_broken_history_is_found(spark):
    day = lambda m: dt.datetime(2020, m, 1)
    rows = [(1, 1, day(1), day(3), False), (2, 1, day(2), None, True), (3, 2, day(1), day(2), False), (4, 2, day(3), None, True), (5, 3, day(1), None, True), (6, 3, day(2), None, True), (7, 4, day(2), day(1), False)]
    df = spark.createDataFrame(rows, "key long, id long, s timestamp_ntz, e timestamp_ntz, IsCurrent boolean")
    df = df.select("key", "id", F.col("s").alias(scd.START), F.coalesce("e", scd.stamp(scd.OPEN_END)).alias(scd.END), "IsCurrent")
    assert {(r.key, r.detail) for r in quality.check_intervals(df, SPEC).collect()} == {("1", "overlap"), ("3", "gap"), ("5", "overlap")}
    assert {(r.key, r.detail) for r in quality.check_one_current(df, SPEC).collect()} == {("3", "2"), ("4", "0")}
    assert {r.key for r in quality.check_order(df, ["key"], scd.START, scd.END).collect()} == {"7"}
    assert quality.check_current_open(df.withColumn("IsCurrent", ~F.col("IsCurrent")), SPEC).count() == 7


def test_store_switches_when_done(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    assert store.read("t") is None and store.note("t") == ""
    assert store.write("t", spark.range(3), note="one") == 1
    (tmp_path / "t" / "v2").mkdir()  # a load that failed on the way
    assert store.read("t").count() == 3 and store.note("t") == "one"
    assert store.write("t", store.read("t").union(spark.range(2)), note="two") == 2
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3
    store.write("t", spark.range(1))
    store.drop_before("t", keep=1)
    assert store.versions("t") == [3]


def test_watermark_moves_after_success(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, T[0]), (2, T[1])], "id int, t timestamp_ntz")

    def fail(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        incremental.load_since(store, "x", rows, "t", fail)
    seen = []
    for part in (rows, rows, rows.union(spark.createDataFrame([(3, T[2])], rows.schema))):
        incremental.load_since(store, "x", part, "t", lambda r: seen.append([x.id for x in r.collect()]))
    assert [sorted(s) for s in seen] == [[1, 2], [3]]


def test_changes_and_deletes(spark):
    def changes(rows):
        df = staged(spark, [(i, n, p) for i, n, p, _, _ in rows])
        extra = spark.createDataFrame([(i, o, q, n) for i, n, _, o, q in rows], "id long, op string, seq int, name string")
        return df.join(extra, ["id", "name"])

    dim = scd.empty_dimension(staged(spark, []), SPEC)
    dim, _ = incremental.apply_changes(dim, changes([(1, "a", 1, "insert", 1), (2, "b", 2, "insert", 2), (1, "c", 3, "update", 3)]), SPEC, T[0], ["seq"])
    assert [(v[1], v[2], v[3]) for v in versions(dim)] == [(1, "c", 3), (2, "b", 2)]
    dim, _ = incremental.apply_changes(dim, changes([(2, "b", 2, "delete", 4)]), SPEC, T[1], ["seq"])
    assert [(v[1], v[5]) for v in versions(dim)] == [(1, True), (2, False)]
    dim, n = incremental.apply_changes(dim, changes([(2, "b", 2, "insert", 5)]), SPEC, T[2], ["seq"])
    assert [(v[1], v[5]) for v in versions(dim)] == [(1, True), (2, False), (2, True)]


def test_run_log(spark):
    started = runlog.run_started(spark, 1, "p", T[0])
    failed = runlog.run_finished(started, T[1], read=5, error="x" * 5000)
    state = runlog.run_state(started.unionByName(failed)).collect()
    assert len(state) == 1 and state[0].Status == "Failed" and len(state[0].ErrorMessage) == 4000 and state[0].ExecutedBy
    bad = runlog.run_finished(started, dt.datetime(2019, 1, 1), inserted=-1)
    assert quality.check_counters(bad).first().detail == "negative counter" and quality.check_counters(failed).count() == 0


def test_counts_that_do_not_match(spark):
    before, _ = load(spark, None, [(1, "a", 10), (2, "b", 20)], T[0])
    after, _ = load(spark, before, [(1, "a", 11), (2, "c", 20)], T[1])
    assert quality.check_counts_match(before, after, SPEC, 1, 2).count() == 0
    assert {r.key for r in quality.check_counts_match(before, after, SPEC, 2, 0).collect()} == {"inserted", "updated"}
    assert {(r.id, r.added, r.overwritten) for r in quality.version_changes(before, after, SPEC).collect()} == {(1, 1, False), (2, 0, True)}
