"""Slowly changing dimensions and change logs fed by Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starmodel.operators.incremental import latest_change
from starmodel.operators.scd import DimensionSpec, load_parts
from starmodel.sources.shared import materialize, scratch
from starmodel.sources.store import SnapshotStore


def stream_scd(
    stream: DataFrame, store: SnapshotStore, spec: DimensionSpec, order: Sequence[str], load_ts: Callable[[int], dt.datetime], checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None, operation: str | None = None, keep: int = 3,
) -> StreamingQuery:
    """Applies each micro-batch of staged rows to the dimension in `store`. The
    last row of a key in a batch counts. The batch's number is kept with the
    snapshot, so a batch that is delivered again changes nothing. With `operation`
    rows are changes, that column saying which of them delete. A batch reads and
    writes only the buckets of the dimension that its keys fall into. Of the
    snapshots the last `keep` stay. A row counts as of its batch, whatever its own
    time is; `late_history` orders rows by that."""

    def apply(batch: DataFrame, number: int) -> None:
        done = store.note(spec.name)
        if done and int(done) >= number:
            return
        rows = prepare(batch) if prepare else batch
        with scratch(store.spark):
            more = [c for c in (operation, *order) if c and c not in spec.attributes]
            last = materialize(latest_change(rows.select(*spec.attributes, *more), [spec.business_key], order), "batch")
            staged, gone = last, None
            if operation:
                staged, gone = last.where(F.col(operation) != "delete"), last.where(F.col(operation) == "delete").select(spec.business_key)
            load_parts(store, spec, staged.select(*spec.attributes), load_ts(number), gone, note=lambda _: str(number))
        store.drop_before(spec.name, keep)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and window of event time; late ones count until the
    watermark has passed their window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
