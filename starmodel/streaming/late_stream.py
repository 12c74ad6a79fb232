"""Histories from streams whose changes come late and out of order.

The state of a key is its last settled version and the changes after it. What the
watermark has passed is settled and leaves the state; until then a change takes its
place by its own time, however late its batch is. Keys are dealt into groups, which
share a call and a state, as a call for each key costs far more than its work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a row of the output is: a version that no change can alter any more, or one
#: that may still be altered.
SETTLED, OPEN = "settled", "open"

#: A group's keys, each with its last version and the number of changes after it; and all these changes.
_STATE = "keys array<{kind}>, starts array<long>, ties array<long>, vals array<string>, begun array<boolean>, counts array<int>, ts array<long>, ids array<long>, texts array<string>"


def late_history(stream: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str], late: str, groups: int = 1024) -> DataFrame:
    """Versions of each key from a stream of changes in any order: `key`, `kind`,
    `value` (`columns` as JSON), `start`, `until` (microseconds; null for the
    current version). `tie` (a long) orders changes at the same time and tells a
    change that is delivered again from a new one.

    A change may be `late` by that much: then it takes its place. Later ones are
    left out by the watermark; `late_keys` finds their keys in a log of the changes,
    to be made anew. A key's `open` rows are all of its versions that are not
    settled, as of that batch. With the watermark's progress, timers settle keys
    that get no more changes. A key's state is the changes within `late`, not its
    history. Rows without a key or time take no part.

    `key` is a number, text or date. Keys are dealt by hash into so many `groups`,
    which cannot be changed for a checkpoint; a group's state is in memory while its
    changes are placed, so with very many keys (over about 100 million) name more."""
    kind = stream.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    group = F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int")
    given = marked.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    given = given.select(group.alias("_group"), F.col(key).alias("_key"), micros.alias("_ts"), F.col(tie).cast("long").alias("_tie"), "_at", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_value"))

    def place(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get) if state.exists else {}
        touched = set()
        for pdf in frames:
            for k, t, i, v in zip(pdf["_key"].tolist(), pdf["_ts"].tolist(), pdf["_tie"].tolist(), pdf["_value"]):
                held.setdefault(k, (0, 0, None, False, {}))[4][t, i] = v
                touched.add(k)
        mark = state.getCurrentWatermarkMs() * 1000
        out, first = [], None
        for k, (start, tie_, value, begun, changes) in held.items():
            if k in touched or (changes and min(changes)[0] <= mark):
                held[k], rows = _placed(start, tie_, value, begun, changes, mark)
                out += [(k, *r) for r in rows]
            if held[k][4]:
                earliest = min(held[k][4])[0]
                first = earliest if first is None else min(first, earliest)
        state.update(_packed(held))
        if first is not None:
            state.setTimeoutTimestamp(max(first, mark) // 1000 + 1)
        made = pd.DataFrame(out, columns=[key, "kind", "value", "start", "until"])
        made["until"] = pd.array([x[4] for x in out], dtype="Int64")
        yield made

    return given.groupBy("_group").applyInPandasWithState(place, f"`{key}` {kind}, kind string, value string, start long, until long", _STATE.format(kind=kind), "update", GroupStateTimeout.EventTimeTimeout)


def _placed(start: int, tie: int, value: str | None, begun: bool, changes: dict, mark: int) -> tuple[tuple, list[tuple]]:
    """A key's next state and its rows: its changes in order after its last settled
    version, those that the watermark has passed settled."""
    out = []
    versions = [(start, tie, value)] if begun else []
    for (t, i), v in sorted(changes.items()):
        if not versions or versions[-1][2] != v:
            versions.append((t, i, v))
    done = 0
    while len(versions) > done + 1 and versions[done + 1][0] <= mark:  # nothing can come between any more
        out.append((SETTLED, versions[done][2], versions[done][0], versions[done + 1][0]))
        done += 1
    versions = versions[done:]
    begun = begun or (bool(versions) and versions[0][0] <= mark)
    if begun:
        start, tie, value = versions[0]
        changes = {c: v for c, v in changes.items() if c > (start, tie) and c[0] > mark}
    for a, b in zip(versions, [*versions[1:], None]):
        out.append((OPEN, a[2], a[0], b[0] if b else None))
    return (start, tie, value, begun, changes), out


def _packed(held: dict) -> tuple:
    """A group's state as a row of `_STATE`."""
    places = [(c, v) for x in held.values() for c, v in sorted(x[4].items())]
    columns = [[x[j] for x in held.values()] for j in range(4)]
    return list(held), *columns, [len(x[4]) for x in held.values()], [c[0] for c, _ in places], [c[1] for c, _ in places], [v for _, v in places]


def _unpacked(row: tuple) -> dict:
    keys, starts, ties, vals, begun, counts, ts, ids, texts = row
    changes = zip(zip(ts, ids), texts)
    return {k: (s, i, v, b, dict(islice(changes, n))) for k, s, i, v, b, n in zip(keys, starts, ties, vals, begun, counts)}


def write_late_history(history: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch of `late_history` to a folder of its own, which a batch
    that is delivered again replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return history.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_late_history(spark: SparkSession, path: str, key: str, columns: str) -> DataFrame:
    """The versions that have been written so far: `key`, the columns of the DDL
    `columns`, `start`, `until`; settled ones and each key's latest open ones."""
    rows = spark.read.parquet(path).withColumn("v", F.from_json("value", columns))
    to_time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    latest = rows.where(F.col("kind") == OPEN).groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_batch"))
    opened = rows.where(F.col("kind") == OPEN).join(latest, (F.col(key) == F.col("_key")) & (F.col("batch") == F.col("_batch")), "left_semi")
    versions = rows.where(F.col("kind") == SETTLED).unionByName(opened)
    return versions.select(key, "v.*", to_time("start"), to_time("until"))


def late_keys(log: DataFrame, key: str, ts: str, batch: str, late: str) -> DataFrame:
    """The keys of `log` (changes with the number of their batch) with a change that
    was too late: at or before the watermark of its batch, which is the largest
    time in earlier batches less `late`."""
    latest = log.groupBy(F.col(batch).alias("_batch")).agg(F.max(ts).alias("_latest"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    marks = latest.select("_batch", (F.max("_latest").over(earlier) - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return log.join(F.broadcast(marks), F.col(batch) == F.col("_batch")).where(F.col(ts) <= F.col("_mark")).select(key).distinct()
