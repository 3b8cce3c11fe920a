"""Landing-folder ingestion as Structured Streaming.

* Z1: file source with a fixed schema (inferred schemas are not stable across
  micro-batches), ``_file`` from the file metadata, ``trigger(availableNow)``.
* Z2: ``foreachBatch`` runs the incremental load (L9) per micro-batch; the batch
  id is recorded in ``load_audit`` so a replayed batch is skipped -> exactly-once
  effect on the table.
* Z3: rows whose period is already covered by the table (<= its high-water
  period) are routed to a side table instead of the load. ``ingest`` asks the catalog;
  ``covered_files`` keeps the high water of every table as keyed state
  (``transformWithState``): tasks first sum up what a file brings, so a table's state
  sees a row per file and task however many rows the table gets.
* Z4: approval expiry: open windows of 30 minutes as keyed state with event-time timers
  (``transformWithState`` on RocksDB); jobs share the keys, and an expired job is
  emitted once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.functions import periods
from sheaf.plans import load as L
from sheaf.sources.store import TableStore

APPROVAL_TIMEOUT = dt.timedelta(minutes=30)


def landing_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Streaming scan of a landing folder with a fixed schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path).withColumn("_file", F.col("_metadata.file_path"))


def split_covered(batch: DataFrame, high_water: str | None, period_col: str) -> tuple[DataFrame, DataFrame]:
    """Z3: (fresh, covered) against the table's high-water period (typed compare)."""
    if high_water is None:
        return batch, batch.limit(0)
    gt = periods.compare_period(F.col(period_col), F.lit(high_water))["gt"]
    return batch.where(gt | F.col(period_col).isNull()), batch.where(~gt)


def ingest(stream: DataFrame, store: TableStore, table_name: str, keys: list[str], checkpoint: str,
           period_col: str | None = None, route_covered: bool = False, now=None):
    """Z2 (+ Z3): run the landing stream to completion (``availableNow``); every
    micro-batch is one incremental load with its batch id."""
    def per_batch(df: DataFrame, batch_id: int):
        store.ensure_catalog()
        if L.batch_done(store, table_name, int(batch_id)):
            return  # a replayed batch touches neither table
        data = df.drop("_file")
        if route_covered and period_col:
            om = store.read("operational_metadata").where(F.col("table_name") == table_name.lower()) \
                .select("last_available_value").first()
            data, covered = split_covered(data, om[0] if om is not None else None, period_col)
            # merged by key, so that a batch that failed after this point can be run again
            side = f"{table_name}__covered"
            store.create_table(side, covered.schema, keys)
            store.upsert(side, covered, keys, ts=now)
        L.incremental_load(store, table_name, data, batch_id=int(batch_id), key_columns=keys, now=now)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


HIGH_WATER_OUT = "table_name string, _file string, high_before long"
_FILE_PERIODS = "table_name string, _file string, top long"


class HighWater(StatefulProcessor):
    """The highest period of each table over all batches before this one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "top long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        before = self.high.get()[0] if self.high.exists() else None
        top = before
        for row in rows:    # one per file and task
            if row.top is not None and (top is None or row.top > top):
                top = row.top
            yield Row(table_name=key[0], _file=row["_file"], high_before=before)
        if top is not None and top != before:
            self.high.update((top,))

    def close(self) -> None:
        pass


def covered_files(stream: DataFrame, table_col: str, rank: Column) -> DataFrame:
    """Z3: for each file and table of a batch the table's high water before the batch
    (null: none yet). ``rank`` is a long that grows with the period; null ranks never
    cover anything."""
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int | None] = {}
        for batch in batches:
            for table, file, top in zip(*[c.to_pylist() for c in batch.columns]):
                old = seen.get((table, file))
                seen[table, file] = top if old is None else old if top is None else max(old, top)
        if seen:
            yield pa.RecordBatch.from_pylist([{"table_name": t, "_file": f, "top": v} for (t, f), v in seen.items()],
                                             schema=pa.schema([("table_name", pa.string()), ("_file", pa.string()), ("top", pa.int64())]))

    per_file = stream.select(F.col(table_col).cast("string").alias("table_name"), "_file", rank.cast("long").alias("top"))
    return (per_file.mapInArrow(tops, _FILE_PERIODS).groupBy("table_name")
            .transformWithState(HighWater(), HIGH_WATER_OUT, "append", "none"))


def route_covered(stream: DataFrame, table_col: str, rank: Column, checkpoint: str,
                  load: Callable[[DataFrame, DataFrame, int], None], read: Callable[[list[str]], DataFrame]):
    """Z3: run a landing stream to completion; every batch is split into fresh rows and rows
    that its tables had covered before it, and ``load(fresh, covered, batch_id)`` gets both.
    ``read`` reads files of the landing folder (those of one batch) with their ``_file``.
    A batch that is run again starts from the same state, so it is split the same way;
    ``load`` must skip or repeat without effect a batch id that it has seen."""
    def per_batch(told: DataFrame, batch_id: int) -> None:
        high = told.groupBy("table_name", "_file").agg(F.max("high_before").alias("high_before")).persist()
        try:
            files = [r[0] for r in high.select("_file").distinct().collect()]   # those of one batch
            if files:
                rows = read(files).withColumn("_t", F.col(table_col).cast("string"))
                known = high.select(F.col("table_name").alias("_ht"), F.col("_file").alias("_hf"), "high_before")
                rows = rows.join(known, rows["_t"].eqNullSafe(F.col("_ht")) & (rows["_file"] == F.col("_hf")), "left").drop("_t", "_ht", "_hf")
                covered = F.coalesce(rank <= F.col("high_before"), F.lit(False))
                load(rows.where(~covered).drop("high_before"), rows.where(covered).drop("high_before"), int(batch_id))
        finally:
            high.unpersist()

    with keyed_state(stream.sparkSession):
        q = (covered_files(stream, table_col, rank).writeStream.foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return q


EXPIRY_OUT = "job_id long, expired_at timestamp, last_update timestamp"
_WINDOW = APPROVAL_TIMEOUT // dt.timedelta(microseconds=1)
JOB_GROUPS = 2048   # keys of the state: jobs share one, so its calls follow groups and not jobs
_ENDS_MS = lambda since: (since + _WINDOW) // 1000 + 1  # noqa: E731  first watermark that ends a window


def _expired_frame(jobs: np.ndarray, unnamed: np.ndarray, since: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"job_id": pd.arrays.IntegerArray(jobs, unnamed), "since": since})


class ApprovalTimer(StatefulProcessor):
    """The jobs of a group that await approval (time of the last event in microseconds), with
    a timer for the window that ends first. The events of a group's batch are judged as
    arrays; the state holds open windows only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "jobs array<long>, since array<long>")

    def _open(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        jobs, since = self.waiting.get() if self.waiting.exists() else ([], [])
        return (np.array([0 if j is None else j for j in jobs], "int64"), np.array([j is None for j in jobs], bool),
                np.array(since, "int64"))

    def _hold(self, before: np.ndarray, jobs: np.ndarray, unnamed: np.ndarray, since: np.ndarray) -> None:
        """Keep the open windows; the one timer is at the end of the first of them."""
        old, new = (int(_ENDS_MS(s.min())) if len(s) else None for s in (before, since))
        if len(since):
            self.waiting.update(([None if n else j for j, n in zip(jobs.tolist(), unnamed.tolist())], since.tolist()))
        elif len(before):
            self.waiting.clear()
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        jobs, unnamed, since = self._open()
        parts = [(jobs, unnamed, since, np.ones(len(jobs), "int64"), np.ones(len(jobs), bool))]
        for r in rows:
            parts.append((r["job"].to_numpy("int64"), r["unnamed"].to_numpy(bool), r["at"].to_numpy("int64"),
                          r["turn"].to_numpy("int64"), np.zeros(len(r), bool)))
        job, none, at, turn, held = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((turn, at, ~held, job, none))    # by job: the open window, then events by time
        job, none, at, turn, held = (c[order] for c in (job, none, at, turn, held))
        first = np.ones(len(job), bool)
        first[1:] = (job[1:] != job[:-1]) | (none[1:] != none[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(job)), 0))
        left = ~(held[start] & (at < at[start]))            # events older than the open window say nothing
        job, none, at, turn, first = (c[left] for c in (job, none, at, turn, first))
        last = np.append(first[1:], True)[:len(job)]
        awaits = turn == 1
        over = awaits & ~last & (np.append(at[1:], 0)[:len(at)] - at > _WINDOW)
        stays = awaits & last
        self._hold(since, job[stays], none[stays], at[stays])
        yield _expired_frame(job[over], none[over], at[over])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        jobs, unnamed, since = self._open()
        over = _ENDS_MS(since) <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            self._hold(since, jobs[~over], unnamed[~over], since[~over])
            yield _expired_frame(jobs[over], unnamed[over], since[over])

    def close(self) -> None:
        pass


def approval_expiry(job_events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """``job_events(job_id, status, updated_at)`` stream -> windows of 30 minutes after an
    event ``awaiting_approval`` that passed without another event of the job, as seen by
    the event-time watermark or by the job's next event. The result does not depend on how
    events fall into batches. Start the query inside ``keyed_state``."""
    asks = F.lit("awaiting_approval")
    # of events at the same time the last by status counts
    turn = F.when(F.col("status") < asks, 0).when(F.col("status") == asks, 1).otherwise(2)
    events = job_events.where(F.col("updated_at").isNotNull()).select(
        F.pmod(F.xxhash64("job_id"), F.lit(JOB_GROUPS)).alias("job_group"), F.coalesce("job_id", F.lit(0)).cast("long").alias("job"),
        F.col("job_id").isNull().alias("unnamed"), F.unix_micros("updated_at").alias("at"), turn.cast("long").alias("turn"), "updated_at")
    over = (events.withWatermark("updated_at", watermark).groupBy("job_group")
            .transformWithStateInPandas(ApprovalTimer(), "job_id long, since long", "append", "eventTime"))
    return over.select("job_id", F.timestamp_micros(F.col("since") + _WINDOW).alias("expired_at"), F.timestamp_micros("since").alias("last_update"))
