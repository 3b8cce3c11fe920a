import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from sheaf.plans import load as L
from sheaf.session import table
from sheaf.sources.store import TableStore
from sheaf.streaming import landing as Z
from tests.conftest import SF_SMALL


def test_landing_stream_upsert_matches_batch(spark, tmpdir_path):
    ev = table(spark, SF_SMALL, "events")
    land = os.path.join(tmpdir_path, "landing")
    # one file per day (the landing folder)
    ev.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(land)
    store = TableStore(spark, f"db_{uuid.uuid4().hex[:12]}", os.path.join(tmpdir_path, "wh"))
    store.create_table("events_t", ev.schema, ["event_id"])
    L.one_time_load(store, "events_t", ev.limit(0), key_columns=["event_id"], now=dt.datetime(2026, 1, 1))
    stream = Z.landing_stream(spark, land, ev.schema, max_files_per_trigger=5)
    Z.ingest(stream, store, "events_t", ["event_id"], os.path.join(tmpdir_path, "ckpt"),
             now=dt.datetime(2026, 1, 2))
    got = store.read("events_t")
    assert got.count() == ev.count()
    assert got.join(ev, "event_id", "left_anti").count() == 0
    audit = store.read("load_audit").where(F.col("table_name") == "events_t")
    assert audit.agg(F.sum("rows_inserted")).first()[0] == ev.count()
    assert audit.count() >= 2          # several micro-batches
    # replaying a recorded batch id is a no-op
    assert L.incremental_load(store, "events_t", ev, batch_id=0)["skipped"]


def test_covered_rows_routed(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), ("2024-03-01",)], "period string")
    fresh, covered = Z.split_covered(df, "2024-02-01", "period")
    assert [r[0] for r in fresh.collect()] == ["2024-03-01"]
    assert sorted(r[0] for r in covered.collect()) == ["2024-01-01", "2024-02-01"]


def test_approval_expiry_timer(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "jobs")
    t0 = dt.datetime(2026, 1, 1, 10, 0)
    rows = [(1, "awaiting_approval", t0), (2, "awaiting_approval", t0),
            (2, "approved", t0 + dt.timedelta(minutes=10)), (3, "awaiting_approval", t0 + dt.timedelta(minutes=50)),
            (4, "completed", t0 + dt.timedelta(minutes=120))]
    spark.createDataFrame(rows, "job_id long, status string, updated_at timestamp").write.parquet(src)
    stream = spark.readStream.schema("job_id long, status string, updated_at timestamp").parquet(src)
    out = os.path.join(tmpdir_path, "expired")
    with Z.keyed_state(spark):
        q = (Z.approval_expiry(stream).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted(r["job_id"] for r in spark.read.parquet(out).collect())
    # watermark = 12:00: job 1 (10:30) and job 3 (11:20) expired; 2 approved; 4 done
    assert got == [1, 3]


def test_expiry_does_not_depend_on_batches(spark, tmpdir_path):
    """The same events in one batch and in one run each give the same expiries."""
    t0 = dt.datetime(2026, 1, 1, 10, 0)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [(1, "awaiting_approval", at(0)), (2, "awaiting_approval", at(1)), (2, "approved", at(31)), (3, "awaiting_approval", at(2)),
            (3, "approved", at(33)), (4, "awaiting_approval", at(5)), (4, "awaiting_approval", at(34)), (4, "awaiting_approval", at(70)),
            (5, "awaiting_approval", at(80)), (9, "completed", at(100)), (6, "awaiting_approval", at(105)), (9, "completed", at(110))]
    exp = {(1, at(0)), (3, at(2)), (4, at(34)), (4, at(70))}    # job 5's window ends at the last event: still open
    for name, steps in (("once", [rows]), ("each", [[r] for r in sorted(rows, key=lambda r: r[2])])):
        home = os.path.join(tmpdir_path, name)
        for step in steps:
            spark.createDataFrame(step, "job_id long, status string, updated_at timestamp").coalesce(1).write.mode("append").parquet(f"{home}/in")
            with Z.keyed_state(spark):
                q = (Z.approval_expiry(Z.landing_stream(spark, f"{home}/in", "job_id long, status string, updated_at timestamp").drop("_file"))
                     .writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/ck")
                     .trigger(availableNow=True).start())
                q.awaitTermination()
        got = spark.read.schema(Z.EXPIRY_OUT).parquet(f"{home}/out").collect()
        assert sorted((r.job_id, r.last_update) for r in got) == sorted(exp), name
        assert all(r.expired_at - r.last_update == dt.timedelta(minutes=30) for r in got)


def test_covered_rows_by_state_and_a_batch_that_runs_again(spark, tmpdir_path):
    schema = "t string, k long, p long"
    steps = [[("a", 1, 5), ("b", 2, 1), (None, 3, 9)], [("a", 4, 5), ("a", 5, 6), ("b", 6, None), ("c", 7, 0)],
             [("a", 8, 6), ("a", 9, 7), ("b", 10, 1), ("b", 11, 2), (None, 12, 9), ("c", 13, 0)]]
    loads = []

    def load(fresh, covered, batch_id):
        loads.append((batch_id, sorted(r.k for r in fresh.collect()), sorted(r.k for r in covered.collect())))

    def read(files):
        return spark.read.schema(schema).parquet(*files).withColumn("_file", F.col("_metadata.file_path"))

    def run():
        Z.route_covered(Z.landing_stream(spark, f"{tmpdir_path}/in", schema), "t", F.col("p"), f"{tmpdir_path}/ck", load, read)

    for step in steps:
        spark.createDataFrame(step, schema).repartition(2).write.mode("append").parquet(f"{tmpdir_path}/in")
        run()
    exp = [(0, [1, 2, 3], []), (1, [5, 6, 7], [4]), (2, [9, 11], [8, 10, 12, 13])]
    assert loads == exp
    run()                       # nothing new: no batch
    assert loads == exp
    for name in ("2", ".2.crc"):    # a crash after the load and before the commit
        os.remove(f"{tmpdir_path}/ck/commits/{name}")
    run()
    assert loads == [*exp, exp[2]]


def test_expiry_state_follows_groups_of_jobs(spark, tmpdir_path, monkeypatch):
    """Many jobs share a key of the state; windows of one key end at different times, in a
    later run, by a next event or by the watermark, and a job without id is a job."""
    monkeypatch.setattr(Z, "JOB_GROUPS", 2)
    t0 = dt.datetime(2026, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    wait, done = "awaiting_approval", "completed"
    steps = [[(j, wait, at(j)) for j in range(40)] + [(None, wait, at(3)), (50, wait, at(4)), (50, done, at(4)), (51, "aborted", at(5)), (51, wait, at(5))],
             [(j, done, at(j + 30 + j % 2)) for j in range(10, 40)] + [(None, done, at(39))], [(99, done, at(200))]]
    exp = {*((j, at(j)) for j in range(10)), *((j, at(j)) for j in range(11, 40, 2)), (None, at(3)), (51, at(5))}
    schema = "job_id long, status string, updated_at timestamp"
    for step in steps:
        spark.createDataFrame(step, schema).write.mode("append").parquet(f"{tmpdir_path}/in")
        with Z.keyed_state(spark):
            (Z.approval_expiry(Z.landing_stream(spark, f"{tmpdir_path}/in", schema).drop("_file")).writeStream.format("parquet")
             .option("path", f"{tmpdir_path}/out").option("checkpointLocation", f"{tmpdir_path}/ck")
             .trigger(availableNow=True).start().awaitTermination())
    got = [(r.job_id, r.last_update) for r in spark.read.schema(Z.EXPIRY_OUT).parquet(f"{tmpdir_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == exp
