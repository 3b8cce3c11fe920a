"""Job-ledger and decision queries (G1-G5, D5, D6, D8) over a ledger derived
from orders: one job per order (created at the order date)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import decide as D
from sheaf.plans import jobs as G
from sheaf.plans.registry import register
from sheaf.session import table

JOBS_SQL = """
jobs0 AS (
  SELECT o_orderkey AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
              ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'awaiting_approval'
                   WHEN '2' THEN 'schema_mismatch' WHEN '3' THEN 'duplicate_data_detected'
                   WHEN '4' THEN 'awaiting_approval' ELSE 'preprocessing' END END AS status,
         o_orderdate AS created_at,
         o_orderdate + to_minutes(CAST(o_orderkey % 90 AS BIGINT)) AS updated_at,
         substr(o_orderpriority, 1, 1) IN ('2', '3') AS is_incremental_load,
         'cust_' || CAST(o_custkey AS VARCHAR) AS proposed_table_name,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN 'cust_' || CAST(o_custkey AS VARCHAR) END
           AS matched_table_name,
         o_custkey, o_totalprice > 1000 AS has_data,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'https://example.org/' || CAST(o_custkey AS VARCHAR) END
           AS source_url
  FROM orders),
anch AS (SELECT o_custkey, min(job_id) FILTER (WHERE NOT is_incremental_load) AS a FROM jobs0 GROUP BY 1),
jobs AS (SELECT jobs0.*, CASE WHEN is_incremental_load THEN anch.a END AS peer_anchor_job_id
         FROM jobs0 JOIN anch USING (o_custkey))"""


def jobs_ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p1 = F.substring("o_orderpriority", 1, 1)
    inc = p1.isin("2", "3")
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
              .otherwise(F.when(p1 == "1", "awaiting_approval").when(p1 == "2", "schema_mismatch")
                         .when(p1 == "3", "duplicate_data_detected").when(p1 == "4", "awaiting_approval")
                         .otherwise("preprocessing")))
    j = o.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("MINUTE", F.pmod("o_orderkey", F.lit(90)), F.col("o_orderdate")).alias("updated_at"),
        inc.alias("is_incremental_load"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("proposed_table_name"),
        F.when(inc, F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))).alias("matched_table_name"),
        F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("final_table_name"),
        "o_custkey", (F.col("o_totalprice") > 1000).alias("has_data"),
        F.create_map(F.lit("source"), F.lit("ledger"),
                     F.lit("source_url"), F.when(F.col("o_orderpriority") != "5-LOW",
                                                 F.concat(F.lit("https://example.org/"), F.col("o_custkey").cast("string"))),
                     F.lit("released_on"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                     F.lit("updated_on"), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("user_metadata"))
    anch = j.groupBy("o_custkey").agg(F.min(F.when(~F.col("is_incremental_load"), F.col("job_id"))).alias("a"))
    return j.join(anch, "o_custkey").withColumn(
        "peer_anchor_job_id", F.when(F.col("is_incremental_load"), F.col("a"))).drop("a", "o_custkey")


@register("g1_pending_jobs", f"""
WITH {JOBS_SQL}
SELECT job_id, status, CASE WHEN is_incremental_load OR matched_table_name IS NOT NULL THEN 'incremental'
                            ELSE 'one_time' END AS load_type,
       lower(coalesce(matched_table_name, proposed_table_name)) AS table_name, created_at
FROM jobs WHERE status IN ('awaiting_approval', 'schema_mismatch', 'duplicate_data_detected')""")
def q_pending(spark, sf_dir):
    """G1: approvable jobs with load type and target table."""
    return G.pending(jobs_ledger(spark, sf_dir))


@register("g2_retry_plan", f"""
WITH {JOBS_SQL}
SELECT job_id,
       CASE WHEN NOT has_data THEN 'Missing processed DataFrame in memory'
            WHEN NOT (is_incremental_load OR matched_table_name IS NOT NULL) AND source_url IS NULL
              THEN 'Missing stored approval metadata for one-time-load retry' ELSE '' END AS reason,
       reason = '' AS queued,
       CASE WHEN NOT has_data THEN 'unknown' WHEN is_incremental_load OR matched_table_name IS NOT NULL
            THEN 'incremental' ELSE 'one_time' END AS load_type,
       CASE WHEN NOT has_data THEN '' ELSE lower(coalesce(matched_table_name, proposed_table_name)) END AS table_name
FROM jobs WHERE status = 'failed'""")
def q_retry(spark, sf_dir):
    """Failed jobs -> queued or the reason they cannot be retried."""
    return G.retry_plan(jobs_ledger(spark, sf_dir))


@register("g3_expired_jobs", f"""
WITH {JOBS_SQL}
SELECT job_id FROM jobs
WHERE status = 'awaiting_approval' AND updated_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 MINUTE""")
def q_expired(spark, sf_dir):
    """Approval timeout (30 min) as of the newest order date (a one-row
    aggregate; the clock is a parameter, never the wall clock)."""
    j = jobs_ledger(spark, sf_dir)
    as_of = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    return G.expired(j, F.lit(as_of))


@register("g4_batch_approval", f"""
WITH RECURSIVE {JOBS_SQL},
p AS (SELECT *, is_incremental_load AND matched_table_name IS NOT NULL AS il FROM jobs
      WHERE status IN ('awaiting_approval', 'schema_mismatch', 'duplicate_data_detected')),
w AS (SELECT p.*, a.job_id IS NOT NULL AND p.il
               AND a.status NOT IN ('completed', 'incremental_load_completed', 'approved') AS waits,
             a.status IN ('awaiting_approval', 'schema_mismatch', 'duplicate_data_detected')
               AND ROW(a.is_incremental_load, a.created_at, a.job_id) < ROW(p.is_incremental_load, p.created_at, p.job_id) AS earlier
      FROM p LEFT JOIN jobs a ON a.job_id = p.peer_anchor_job_id),
d AS (SELECT job_id, CASE WHEN waits THEN 'skip' ELSE 'approve' END AS action FROM w WHERE NOT (waits AND earlier)
      UNION ALL SELECT w.job_id, d.action FROM w JOIN d ON w.peer_anchor_job_id = d.job_id WHERE w.waits AND w.earlier)
SELECT p.job_id, p.il AS is_incremental, p.created_at, d.action,
       CASE WHEN p.il THEN p.matched_table_name ELSE lower(p.proposed_table_name) END AS table_name,
       CAST(row_number() OVER (ORDER BY p.is_incremental_load, p.created_at, p.job_id) AS INTEGER) AS approval_order
FROM p JOIN d ON p.job_id = d.job_id""")
def q_batch(spark, sf_dir):
    """Batch approval plan in order: new tables first, then increments whose anchor is
    done or was approved earlier in the batch; others skipped."""
    return G.batch_approval(jobs_ledger(spark, sf_dir))


@register("g5_approval_metadata", """
SELECT o_orderkey AS job_id, 'ledger' AS source,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'https://example.org/' || CAST(o_custkey AS VARCHAR) END AS source_url,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS released_on,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS updated_on,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'missing fields: source_url' END AS error
FROM orders""")
def q_meta(spark, sf_dir):
    """Approval metadata from the ledger: dates in two formats parsed, missing
    fields reported."""
    j = jobs_ledger(spark, sf_dir)
    m = j.select("job_id", F.col("user_metadata")["source"].alias("source"),
                 F.col("user_metadata")["source_url"].alias("source_url"),
                 F.col("user_metadata")["released_on"].alias("released_on"),
                 F.col("user_metadata")["updated_on"].alias("updated_on"),
                 F.lit(None).cast("string").alias("business_metadata"))
    out = G.approval_metadata(m)
    bad = F.col("error").isNotNull()
    return out.select("job_id", "source", "source_url",
                      F.when(~bad, F.col("released_on")).cast("timestamp_ntz").alias("released_on"),
                      F.when(~bad, F.col("updated_on")).cast("timestamp_ntz").alias("updated_on"), "error")


@register("d6_duplicate_periods", """
WITH ex AS (SELECT o_orderpriority AS table_name, strftime(max(o_orderdate), '%Y-%m-%d') AS last_v
            FROM orders WHERE o_orderdate < '1999-01-01' GROUP BY 1),
nw AS (SELECT o_orderpriority || '/' || o_orderstatus AS file_id, o_orderpriority AS table_name,
              strftime(min(o_orderdate), '%Y-%m-%d') AS new_first, strftime(max(o_orderdate), '%Y-%m-%d') AS new_last
       FROM orders WHERE o_orderdate >= '1998-07-01' GROUP BY 1, 2)
SELECT file_id, table_name, new_first, new_last, last_v AS existing_last,
       CASE WHEN last_v IS NULL THEN 'NO_PERIOD_COLUMN' WHEN new_first > last_v THEN 'NEW_DATA'
            WHEN last_v > new_last THEN 'DUPLICATE' ELSE 'PARTIAL_OVERLAP' END AS status,
       CASE WHEN last_v IS NOT NULL THEN 'date' END AS comparison_method
FROM nw LEFT JOIN ex USING (table_name)""")
def q_dup(spark, sf_dir):
    """Every (priority, status) slice of recent orders is an incoming file for
    the priority's table; its first/last period against the table's last period."""
    o = table(spark, sf_dir, "orders")
    ex = (o.where(F.col("o_orderdate") < "1999-01-01").groupBy(F.col("o_orderpriority").alias("table_name"))
          .agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_available_value")))
    nw = (o.where(F.col("o_orderdate") >= "1998-07-01")
          .withColumn("p", F.date_format("o_orderdate", "yyyy-MM-dd"))
          .groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("file_id"),
                   F.col("o_orderpriority").alias("table_name"))
          .agg(F.min("p").alias("new_first"), F.max("p").alias("new_last")))
    return D.duplicate_period_status(nw, ex)


@register("d8_increment_preview", """
WITH nw AS (SELECT o_orderpriority || '/' || o_orderstatus AS file_id, o_orderpriority AS table_name,
                   count(*) AS n FROM orders WHERE o_orderdate >= '1999-01-01' GROUP BY 1, 2),
cur AS (SELECT o_orderpriority AS table_name, count(*) AS c FROM orders WHERE o_orderdate < '1999-01-01' GROUP BY 1)
SELECT file_id, table_name, CAST(n AS BIGINT) AS new_rows_count, CAST(coalesce(c, 0) AS BIGINT) AS current_rows_count,
       CAST(n + coalesce(c, 0) AS BIGINT) AS total_rows_after
FROM nw LEFT JOIN cur USING (table_name)""")
def q_preview(spark, sf_dir):
    """Rows new / current / after for every incremental file."""
    o = table(spark, sf_dir, "orders")
    new = o.where(F.col("o_orderdate") >= "1999-01-01")
    files = new.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("file_id"),
                       F.col("o_orderpriority").alias("table_name")).distinct()
    fr = new.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("file_id")) \
        .agg(F.count(F.lit(1)).alias("new_rows"))
    tr = o.where(F.col("o_orderdate") < "1999-01-01").groupBy(F.col("o_orderpriority").alias("table_name")) \
        .agg(F.count(F.lit(1)).alias("current_rows"))
    return D.increment_preview(files, fr, tr)
