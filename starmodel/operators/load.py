"""A whole load of a dimension: log, staging, rejects, comparison, snapshot, log."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from starmodel.operators import fact, runlog, scd
from starmodel.sources.schema import REJECTS, RUN_LOG, struct
from starmodel.sources.shared import materialize, scratch
from starmodel.sources.store import SnapshotStore

#: Tables of a store that rows are only added to.
LOG, REJECTED = "run_log", "rejects"


def run_load(
    store: SnapshotStore, spec: scd.DimensionSpec, execution_id: int, source: str, extract: Callable[[], tuple[DataFrame, DataFrame | None]], load_ts: dt.datetime, now: Callable[[], dt.datetime] = dt.datetime.now
) -> None:
    """Loads the dimension of `spec` in `store` with what `extract` returns: good
    rows of staging, and rejects with `reject_reasons` or None.

    A row is added to the log before anything is read. The good rows are written
    as a version of the staging table and read from there; rejects are stored under
    the run's id; staged keys must be unique; the buckets of the dimension that
    change are written and then switched to, with the run's id in the marker; and
    the log gets a row with the counts. Whatever goes wrong before the switch is logged as a failed
    run with its message and raised again; the dimension is then as it was before.

    A run whose id has been switched to is done: run again it does nothing, but
    for the log's last row if that was lost. A failed run may be run again under its
    id; its rejects replace those of the failed one."""
    with logged(store, execution_id, f"load {spec.name}", source, spec.name, now) as run:
        if run is None:
            return
        rows, rejects = extract()
        store.write(f"staging_{spec.name}", rows)
        staged = store.read(f"staging_{spec.name}")
        rejected = store_rejects(store, execution_id, spec.name, rejects)

        def note(found: dict[str, int]) -> str:
            new, t1, t2 = found["new"], found["t1"], found["t2"]
            run.update(read=new + t1 + t2 + found["same"] + rejected, inserted=new + t2, updated=t1 + t2, rejected=rejected)
            return json.dumps({"run": execution_id} | run)

        with scratch(store.spark):
            scd.load_parts(store, spec, staged, load_ts, note=note)


def run_fact_load(
    store: SnapshotStore, execution_id: int, source: str, extract: Callable[[], tuple[DataFrame, DataFrame]], product_dim: DataFrame, product: scd.DimensionSpec, dims: dict | None = None, table: str = "sales",
    now: Callable[[], dt.datetime] = dt.datetime.now, **options,
) -> None:
    """Loads and publishes the sales fact with the lines and headers that `extract`
    returns, in the steps of `run_load`: lines without a header are stored as
    rejects, the lines with their keys and measures are written once, by month; it is an
    error if one has become several (lines are counted one by one only where there
    are more rows than lines with a header), else the months are switched to together, under
    the run's id. A failed run leaves what was published as it was."""
    with logged(store, execution_id, f"load {table}", source, table, now) as run:
        if run is None:
            return
        with scratch(store.spark):
            detail, header = extract()
            given, watch = Observation(), Observation()
            detail = materialize(detail.observe(given, F.count("*").alias("n")), "lines")
            rejected = store_rejects(store, execution_id, table, fact.line_rejects(detail, header))
            lines = fact.load_fact(detail, header, product_dim, product, dims, measures=False, **options)

            def note(written: DataFrame) -> str:
                n = watch.get["n"]
                # each line with a header is at least one row, so equal counts leave none that is several
                if n != given.get["n"] - rejected and (more := fact.grain_breaks(written.select(*fact.GRAIN), detail).count()):
                    raise ValueError(f"{more} order lines have become several rows")
                run.update(read=n + rejected, inserted=n, updated=0, rejected=rejected)
                return json.dumps({"run": execution_id} | run)

            fact.publish(store, table, lines, note=note, finish=lambda rows: fact.finished(rows).observe(watch, F.count("*").alias("n")))


@contextmanager
def logged(store: SnapshotStore, execution_id: int, process: str, source: str, target: str, now: Callable[[], dt.datetime]) -> Iterator[dict | None]:
    """A run in the log. Gives a dict for its counts, or None if a version of `target`
    (a table of `store`) says that the run is done."""
    done = _done(store, target, execution_id)
    state = {r["Status"] for r in run_log(store).where(F.col("ExecutionID") == execution_id).select("Status").distinct().collect()}
    if done is not None and "Succeeded" in state:
        yield None
        return
    started = runlog.run_started(store.spark, execution_id, process, now(), source, target)
    counts: dict = dict(done or {})
    if done is None:
        store.append(LOG, started)
        try:
            yield counts
        except Exception as e:
            if _done(store, target, execution_id) is None:
                store.append(LOG, runlog.run_finished(started, now(), error=f"{type(e).__name__}: {e}"))
            raise
    else:
        yield None
    store.append(LOG, runlog.run_finished(started, now(), counts.get("read", 0), counts.get("inserted", 0), counts.get("updated", 0), counts.get("rejected", 0)))


def _done(store: SnapshotStore, table: str, execution_id: int) -> dict | None:
    """The counts of a run that a version of the table is from."""
    for note in store.notes(table):
        found = json.loads(note) if note.startswith("{") else {}
        if found.get("run") == execution_id:
            return {k: v for k, v in found.items() if k != "run"}
    return None


def store_rejects(store: SnapshotStore, execution_id: int, target: str, rejects: DataFrame | None) -> int:
    """Stores rejected rows (with `reject_reasons`) under the run's id, in place of
    those that are there, and returns how many there are, observed while writing."""
    if rejects is None:
        return 0
    columns = [c for c in rejects.columns if c != "reject_reasons"]
    rows = rejects.select(F.lit(execution_id).cast("long").alias("ExecutionID"), F.lit(target).alias("TargetObject"), F.array_join("reject_reasons", "; ").alias("Reasons"), F.to_json(F.struct(*columns)).alias("RejectedRow"))
    watch = Observation()
    store.replace(REJECTED, f"{target}-{execution_id}", rows.observe(watch, F.count("*").alias("n")))
    return watch.get["n"]


def run_log(store: SnapshotStore) -> DataFrame:
    """All rows of the log."""
    return store.read_rows(LOG, struct(RUN_LOG))


def stored_rejects(store: SnapshotStore) -> DataFrame:
    """The rejects of all runs: `ExecutionID`, `TargetObject`, `Reasons`, `RejectedRow` (JSON)."""
    return store.read_rows(REJECTED, struct(REJECTS))
