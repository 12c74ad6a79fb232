"""Windows in range parts against Spark's own windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starmodel.operators import incremental, lookup, ordered, scd

T0 = dt.datetime(2024, 1, 1)


def table(spark, n=400, seed=1):
    r = random.Random(seed)
    # one key has most rows, some have one, one is null
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None, f"k{i % 7}"]), i // 3, i, r.choice([None, "x", "y"]), r.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, i long, v string, w long").repartition(3)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("after", [False, True])
def test_neighbours(spark, after):
    df = table(spark)
    parts = ordered.dealt(df, ["k"], ["t", "i"], 7)
    assert parts.where("k = 'hot'").select(ordered.PART).distinct().count() > 3
    got = ordered.with_neighbour(parts, ["k"], ["t", "i"], ["v", "w"], "near", after)
    w = Window.partitionBy("k").orderBy("t", "i")
    step = F.lead if after else F.lag
    want = df.withColumn("near", step(F.struct("v", "w")).over(w))
    assert rows(got, "k", "i", "near") == rows(want, "k", "i", "near")


def test_filled_forward(spark):
    df = table(spark).withColumn("v", F.when(F.col("i") % 50 == 7, F.col("v")))
    got = ordered.filled_forward(ordered.dealt(df, ["k"], ["t", "i"], 7), ["k"], ["t", "i"], "v")
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "k", "i", "v") == rows(df.withColumn("v", F.last("v", ignorenulls=True).over(w)), "k", "i", "v")


def test_ranks(spark):
    df = table(spark).withColumn("w", F.when(F.col("i") % 9 != 0, F.col("w") * F.col("i") % 40))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("w").desc_nulls_last())
    want = df.withColumn("Rank", F.rank().over(w).cast("long")).withColumn("DenseRank", F.dense_rank().over(w).cast("long"))
    assert rows(ordered.ranked(df, "w", parts=5), "i", "Rank", "DenseRank") == rows(want, "i", "Rank", "DenseRank")
    assert ordered.ranked(df.limit(0), "w").count() == 0


def test_history_of_a_hot_key(spark):
    df = table(spark, 900).withColumn("t", F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("t").cast("int")))
    whole = incremental.history_from_changes(df, ["k"], "t", ["v"], ["i"])
    cut = incremental.history_from_changes(df, ["k"], "t", ["v"], ["i"], hot=100)
    columns = ["k", "v", scd.START, scd.END, scd.CURRENT]
    assert rows(cut, *columns) == rows(whole, *columns)


def test_as_of_is_the_join(spark):
    spec = scd.DimensionSpec("d", "id", "key", type2=("v",))
    day = lambda n: T0 + dt.timedelta(days=n)
    end = dt.datetime.fromisoformat(scd.OPEN_END)
    versions = [(1, "a", day(0), day(5)), (1, "b", day(5), day(9)), (1, "c", day(12), end), (2, "x", day(3), end)]  # a gap from day 9 on
    dim = spark.createDataFrame([(n, i, v, s, e, e == end) for n, (i, v, s, e) in enumerate(versions, 1)], "key long, id long, v string, EffectiveStartDateTime timestamp_ntz, EffectiveEndDateTime timestamp_ntz, IsCurrent boolean")
    r = random.Random(2)
    facts = [(r.choice([1] * 8 + [2, 3, None]), r.choice([None, *[day(n) for n in range(-1, 15)]])) for _ in range(300)] + [(1, day(5))] * 3
    facts = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(facts)], "i long, id long, at timestamp_ntz")
    for first in ("unknown", "first_version"):
        small, large = (lookup.lookup_key(facts, dim, spec, "id", "at", before_first=first, attributes=("v",), small=n) for n in (1 << 30, 0))
        assert small.columns == large.columns
        assert rows(large, "i", "key", "v") == rows(small, "i", "key", "v") and large.count() == 303
    assert ordered.as_of(facts, "id", "at", dim, "id", scd.START, "v", parts=6).where("v = 'b'").count() > 0


@pytest.mark.parametrize("many", [64, 1])
def test_lookup_gives_the_same_rows_whatever_the_size(spark, monkeypatch, many):
    monkeypatch.setattr(lookup, "MANY", many)
    spec = scd.DimensionSpec("d", "id", "key", type2=("v",))
    day = lambda n: T0 + dt.timedelta(days=n)
    end = dt.datetime.fromisoformat(scd.OPEN_END)
    versions = [(1, "a", day(0), day(7)), (1, "b", day(5), day(9)), (1, "c", day(6), end), (2, "x", day(3), day(6)), (2, "y", day(6), end), (3, "z", day(2), end), (3, "e", day(4), day(4))]  # 1 overlaps, 3 has an empty one
    dim = spark.createDataFrame([(n, i, v, s, e, e == end) for n, (i, v, s, e) in enumerate(versions, 1)], "key long, id long, v string, EffectiveStartDateTime timestamp_ntz, EffectiveEndDateTime timestamp_ntz, IsCurrent boolean")
    r = random.Random(4)
    facts = [(i, r.choice([1, 1, 2, 3, 4, None]), r.choice([None, *[day(n) for n in range(-1, 12)]])) for i in range(200)]
    facts = spark.createDataFrame(facts, "i long, id long, at timestamp_ntz")
    small, large = (lookup.lookup_key(facts, dim, spec, "id", "at", attributes=("v",), small=n) for n in (1 << 30, 0))
    assert small.columns == large.columns and small.count() > 200
    assert rows(large, "i", "id", "at", "key", "v") == rows(small, "i", "id", "at", "key", "v")
