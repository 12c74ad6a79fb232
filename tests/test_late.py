"""Late and backdated changes against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starmodel.operators import backdated, quality, scd
from starmodel.streaming import late_stream

SPEC = scd.DimensionSpec("d", "id", "key", type2=("v",))
T0 = dt.datetime(2024, 1, 1)
END = dt.datetime.fromisoformat(scd.OPEN_END)


def changes(spark, rows):
    """(id, day, order, value or None to delete)"""
    df = spark.createDataFrame([(i, T0 + dt.timedelta(days=t), o, v or "-", "update" if v else "delete") for i, t, o, v in rows], "id long, SourceModifiedDate timestamp_ntz, o long, v string, op string")
    return df.withColumn("RowHash", F.sha2("v", 256))


def model(points, rows):
    """Points (id, day) -> value after changes: the last of a time counts; what changes nothing goes."""
    new = dict(points)
    for i, t, o, v in sorted(rows, key=lambda r: r[2]):
        new[i, t] = v
    kept, before = {}, {}
    for i, t in sorted(new):
        if new[i, t] != before.get(i):
            kept[i, t] = before[i] = new[i, t]
    return kept


def versions(points):
    out = []
    for i, t in sorted(points):
        later = min((u for j, u in points if j == i and u > t), default=None)
        if points[i, t] is not None:
            out.append((i, points[i, t], t, later))
    return sorted(out, key=repr)


def read(dim):
    day = lambda x: None if x == END else (x - T0).days
    return sorted(((r.id, r.v, day(r.EffectiveStartDateTime), day(r.EffectiveEndDateTime)) for r in dim.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_backdated_changes(spark, seed):
    r = random.Random(seed)
    dim, points, held = None, {}, {}
    for n in range(3):
        rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(40), 100 * n + o, r.choice(["a", "b", "c", None])) for o in range(r.choice([3, 25]))]
        staged = changes(spark, rows)
        dim = backdated.apply_backdated(scd.empty_dimension(staged, SPEC) if dim is None else dim, staged, SPEC, "SourceModifiedDate", ["o"], "op")
        points = model(points, rows)
        assert read(dim) == versions(points)
        keys = {(x.id, x.EffectiveStartDateTime): x.key for x in dim.collect()}
        assert len(set(keys.values())) == len(keys)
        assert all(keys[k] == s for k, s in held.items() if k in keys and s in keys.values())
        held = keys
        again = backdated.apply_backdated(dim, staged, SPEC, "SourceModifiedDate", ["o"], "op")
        assert read(again) == read(dim)  # a second time


def test_one_change_cuts_a_version(spark):
    dim = backdated.apply_backdated(scd.empty_dimension(changes(spark, [(1, 0, 0, "a")]), SPEC), changes(spark, [(1, 0, 0, "a"), (1, 10, 1, "b"), (2, 5, 2, "x")]), SPEC, "SourceModifiedDate", ["o"])
    key = {(r.id, r.v): r.key for r in dim.collect()}
    cut = backdated.apply_backdated(dim, changes(spark, [(1, 4, 3, "c")]), SPEC, "SourceModifiedDate", ["o"])
    assert read(cut) == [(1, "a", 0, 4), (1, "b", 10, None), (1, "c", 4, 10), (2, "x", 5, None)]
    assert {(r.id, r.v): r.key for r in cut.collect()} == key | {(1, "c"): 4}
    earlier = backdated.apply_backdated(cut, changes(spark, [(1, 7, 4, "b")]), SPEC, "SourceModifiedDate", ["o"])
    assert read(earlier) == [(1, "a", 0, 4), (1, "b", 7, None), (1, "c", 4, 7), (2, "x", 5, None)]
    assert {(r.id, r.v): r.key for r in earlier.collect()} == key | {(1, "c"): 4}  # the neighbour has moved, with its key
    for check in (quality.check_intervals, quality.check_current_open, quality.check_one_current):
        assert check(earlier, SPEC).count() == 0
    none = changes(spark, [(9, 1, 1, "q")]).withColumn("id", F.lit(None).cast("long"))
    assert read(backdated.apply_backdated(earlier, none, SPEC, "SourceModifiedDate", ["o"])) == read(earlier)
    assert backdated.apply_backdated(earlier.limit(0), none.limit(0), SPEC, "SourceModifiedDate", ["o"]).count() == 0


SCHEMA = "k long, ts timestamp_ntz, i long, v string"


def test_late_history(spark, tmp_path):
    """Batches in any order within the bound, with rows again, some nulls, and one row that is too late."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [
        [(1, at(5), 1, "a"), (1, at(1), 2, "b"), (2, at(3), 3, "x"), (None, at(3), 4, "x"), (2, None, 5, "x")],
        [(1, at(3), 6, "c"), (1, at(5), 1, "a"), (2, at(2), 7, None)],
        [(1, at(30), 8, "a"), (3, at(29), 9, "z")],
        [(1, at(25), 10, "d"), (2, at(2), 11, "late")],
        [(3, at(60), 12, "z")],
    ]
    source, out, base = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        for _ in range(2):  # the second time nothing is new
            history = late_stream.late_history(stream, "k", "ts", "i", ["v"], "10 hours")
            late_stream.write_late_history(history, out, base).awaitTermination()
    got = sorted(((r.k, r.v, r.start, r.until) for r in late_stream.read_late_history(spark, out, "k", "v string").collect()), key=repr)
    want = [(1, "b", at(1), at(3)), (1, "c", at(3), at(5)), (1, "a", at(5), at(25)), (1, "d", at(25), at(30)), (1, "a", at(30), None), (2, None, at(2), at(3)), (2, "x", at(3), None), (3, "z", at(29), None)]
    assert got == sorted(want, key=repr)
    kinds = {r.kind for r in spark.read.parquet(out).collect()}
    assert kinds == {late_stream.SETTLED, late_stream.OPEN}
    log = spark.createDataFrame([(*r, n) for n, rows in enumerate(batches) for r in rows], SCHEMA + ", batch int")
    assert [r.k for r in late_stream.late_keys(log, "k", "ts", "batch", "10 hours").collect()] == [2]


def test_groups_of_keys(spark, tmp_path):
    """Keys that share a group keep to themselves: one settles when another gets changes."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    r = random.Random(5)
    batches = [[(k, at(20 * n + r.randrange(25)), 1000 * n + 10 * k + j, r.choice("abc")) for k in range(n % 2, 40, 1 + n % 2) for j in range(3)] for n in range(4)]
    source, out, base = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        history = late_stream.late_history(spark.readStream.schema(SCHEMA).parquet(source), "k", "ts", "i", ["v"], "30 hours", groups=3)
        late_stream.write_late_history(history, out, base).awaitTermination()
    got = sorted((x.k, x.start, x.until or END, x.v) for x in late_stream.read_late_history(spark, out, "k", "v string").collect())
    want = []
    for k in range(40):
        moved = []
        for _, t, _, v in sorted(x for rows in batches for x in rows if x[0] == k):
            if not moved or moved[-1][1] != v:
                moved.append((t, v))
        want += [(k, t, u, v) for (t, v), (u, _) in zip(moved, [*moved[1:], (END, None)])]
    assert got == want
