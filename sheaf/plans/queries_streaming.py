"""Streaming queries (Z1, Z3, Z4): landing folders are filled from the tables in steps and
each step is read by a stream with ``availableNow``, as a scheduled job would."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.plans.queries_jobs import JOBS_SQL, jobs_ledger
from sheaf.plans.registry import register
from sheaf.session import ensure_checkpoint_dir, keep, table
from sheaf.streaming import landing as Z


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheaf-stream-{uuid.uuid4().hex}"


@register("z4_approval_expiry", f"""
WITH {JOBS_SQL},
e AS (SELECT job_id, 'awaiting_approval' AS status, created_at AS t FROM jobs
      UNION ALL SELECT job_id, status, updated_at + INTERVAL 1 SECOND FROM jobs),
n AS (SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t) AS next_t, max(t) OVER () AS seen FROM e)
SELECT job_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_update, strftime(t + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS expired_at
FROM n WHERE status = 'awaiting_approval' AND coalesce(next_t, seen) > t + INTERVAL 30 MINUTE""")
def q_expiry(spark, sf_dir):
    """Every job of the ledger asks for approval when it is created and takes its
    status later; windows of 30 minutes that pass are found by timers over four runs of
    the stream, or by the job's next event."""
    j = jobs_ledger(spark, sf_dir)
    first = j.select("job_id", F.lit("awaiting_approval").alias("status"), F.col("created_at").cast("timestamp").alias("updated_at"))
    then = j.select("job_id", "status", (F.col("updated_at").cast("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("updated_at"))
    events = keep(first.unionByName(then))     # read by every run
    lo, hi = events.agg(F.min("updated_at"), F.max("updated_at")).first()
    cuts = [lo + (hi - lo) * k / 4 for k in range(4)]
    home = _folder(spark)
    for k, cut in enumerate(cuts):
        at = F.col("updated_at")
        part = events.where((at >= F.lit(cut)) & (at < F.lit(cuts[k + 1])) if k < 3 else at >= F.lit(cut))
        part.write.mode("append").parquet(f"{home}/in")
        with Z.keyed_state(spark):
            stream = Z.landing_stream(spark, f"{home}/in", events.schema).drop("_file")
            (Z.approval_expiry(stream).writeStream.format("parquet").option("path", f"{home}/out")
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.schema(Z.EXPIRY_OUT).parquet(f"{home}/out").select("job_id", text("last_update"), text("expired_at"))


@register("z3_covered_rows", """
WITH b AS (SELECT o_orderkey, o_orderpriority, o_orderdate,
             CASE WHEN year(o_orderdate) <= 1994 THEN o_orderkey % 4 // 3 WHEN year(o_orderdate) <= 1996 THEN 1 + o_orderkey % 4 // 3 ELSE 2 END AS batch
           FROM orders),
h AS (SELECT o_orderpriority, batch, max(o_orderdate) AS top FROM b GROUP BY ALL)
SELECT o_orderkey, o_orderpriority, batch::BIGINT AS batch,
       coalesce(o_orderdate <= (SELECT max(top) FROM h WHERE h.o_orderpriority = b.o_orderpriority AND h.batch < b.batch), false) AS covered
FROM b""")
def q_covered(spark, sf_dir):
    """Orders land in three batches, a quarter of each too late; the table of each
    priority keeps its high water as state, and every batch is split into fresh rows and
    rows already covered. Batches are written under their id, so that one which runs
    again replaces itself."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    late = F.expr("o_orderkey % 4 div 3")
    batch = F.when(F.year("o_orderdate") <= 1994, late).when(F.year("o_orderdate") <= 1996, late + 1).otherwise(2)
    home = _folder(spark)

    def load(fresh, covered, batch_id):
        both = fresh.withColumn("covered", F.lit(False)).unionByName(covered.withColumn("covered", F.lit(True)))
        both.drop("_file").write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    def read(files):
        return spark.read.schema(o.schema).parquet(*files).withColumn("_file", F.col("_metadata.file_path"))

    for k in range(3):
        o.where(batch == k).write.mode("append").parquet(f"{home}/in")
        Z.route_covered(Z.landing_stream(spark, f"{home}/in", o.schema), "o_orderpriority", F.unix_date("o_orderdate"),
                        f"{home}/checkpoint", load, read)
    return spark.read.parquet(f"{home}/out").select("o_orderkey", "o_orderpriority", F.col("batch").cast("long").alias("batch"), "covered")
