import datetime as dt

from pyspark.sql import functions as F

from starmodel.operators import scd
from starmodel.sources.store import SnapshotStore
from starmodel.streaming import scd_stream

SMALL = "/root/testdata/sf0.001"
USER = scd.DimensionSpec("user", "user_id", "user_key", type2=("kind",))


def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


def prepare(batch):
    return batch.select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("SourceModifiedDate"), F.sha2("event_type", 256).alias("RowHash"), "event_id")


def test_stream_is_the_batches(spark, tmp_path):
    """Files arrive one after the other; the dimension is as after the same loads in batch."""
    days = [(0, "2024-01-10"), (1, "2024-01-20"), (2, "2100-01-01")]
    source, store = f"{tmp_path}/in", SnapshotStore(spark, f"file://{tmp_path}/tables")
    want = scd.empty_dimension(prepare(events(spark)), USER)
    last = "1900-01-01"
    for n, day in days:
        part = events(spark).where((F.col("ts") >= F.lit(last).cast("timestamp_ntz")) & (F.col("ts") < F.lit(day).cast("timestamp_ntz")))
        last = day
        part.coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second time there is nothing new
            stream = spark.readStream.schema(part.schema).parquet(source)
            scd_stream.stream_scd(stream, store, USER, ["SourceModifiedDate", "event_id"], lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k), f"{tmp_path}/checkpoint", prepare).awaitTermination()
        staged = prepare(part)
        from starmodel.operators.incremental import latest_change

        want, _ = scd.apply_scd(want, latest_change(staged, ["user_id"], ["SourceModifiedDate", "event_id"]).select(*USER.attributes), USER, dt.datetime(2024, 1, 1) + dt.timedelta(days=n))
    rows = lambda df: sorted((r.user_id, r.kind, r.user_key, r.IsCurrent) for r in df.collect())
    assert rows(store.read("user")) == rows(want)
    assert len(store.versions("user")) == len([1 for _ in days])
