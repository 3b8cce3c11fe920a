"""Job-ledger queries (G1-G5) over a ``jobs`` DataFrame:
``(job_id, status, created_at, updated_at, is_incremental_load, proposed_table_name,
matched_table_name, table_name, final_table_name, peer_anchor_job_id, has_data,
user_metadata map<string,string>)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.dates import parse_formats
from sheaf.operators.ordered import row_numbers
from sheaf.session import cut_lineage

# ---- fixed values ------------------------------------------------------------
STATUSES = ["preprocessing", "awaiting_approval", "approved", "rejected", "completed", "failed",
            "similarity_search", "incremental_load_auto", "schema_mismatch",
            "incremental_load_completed", "duplicate_data_detected"]
APPROVABLE = ["awaiting_approval", "schema_mismatch", "duplicate_data_detected"]
ANCHOR_DONE = ["completed", "incremental_load_completed", "approved"]
APPROVAL_TIMEOUT_MINUTES = 30
REQUIRED_METADATA = ["source", "source_url", "released_on", "updated_on"]
RETRY_REASONS = {"data": "Missing processed DataFrame in memory", "target": "Could not resolve target table name",
                 "metadata": "Missing stored approval metadata for one-time-load retry"}
METADATA_DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy",
                         "dd-MM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/MM/dd"]
# ------------------------------------------------------------------------------


def _is_inc() -> Column:
    return F.coalesce(F.col("is_incremental_load"), F.lit(False)) | _named("matched_table_name").isNotNull()


def _named(c: str) -> Column:
    """A blank name is no name."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def target_table() -> Column:
    return F.lower(F.coalesce(*[_named(c) for c in (
        "matched_table_name", "table_name", "final_table_name", "proposed_table_name")]))


def pending(jobs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """G1: jobs in an approvable status with load type, target and (optional) J5 group."""
    p = jobs.where(F.col("status").isin(*APPROVABLE)).select(
        "job_id", "status", F.when(_is_inc(), "incremental").otherwise("one_time").alias("load_type"),
        target_table().alias("table_name"), "created_at")
    if groups is not None:
        p = p.join(groups.select(F.col("id").alias("job_id"), "anchor_id", "role"), "job_id", "left")
    return p


def retry_plan(jobs: DataFrame) -> DataFrame:
    """For failed jobs: queued or the reason it cannot be (no data, no target,
    one-time load without stored metadata)."""
    f = jobs.where(F.col("status") == "failed")
    meta_ok = F.lit(True)
    for k in REQUIRED_METADATA:
        v = F.col("user_metadata")[k]
        meta_ok = meta_ok & v.isNotNull() & (v != "")
    tgt = F.coalesce(target_table(), F.lit(""))
    reason = (F.when(~F.coalesce("has_data", F.lit(False)), F.lit(RETRY_REASONS["data"]))
              .when(tgt == "", F.lit(RETRY_REASONS["target"]))
              .when(~_is_inc() & ~F.coalesce(meta_ok, F.lit(False)),
                    F.lit(RETRY_REASONS["metadata"]))
              .otherwise(F.lit("")))
    return f.select("job_id", (reason == "").alias("queued"), reason.alias("reason"),
                    F.when(~F.coalesce("has_data", F.lit(False)), F.lit("unknown"))
                    .when(_is_inc(), F.lit("incremental")).otherwise(F.lit("one_time")).alias("load_type"),
                    F.when(~F.coalesce("has_data", F.lit(False)), F.lit("")).otherwise(tgt).alias("table_name"))


def expired(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Awaiting approval and last updated more than 30 minutes before ``as_of``."""
    limit = as_of - F.expr(f"INTERVAL {APPROVAL_TIMEOUT_MINUTES} MINUTES")
    return jobs.where((F.col("status") == "awaiting_approval") & (F.col("updated_at") < limit)).select("job_id")


def batch_approval(jobs: DataFrame) -> DataFrame:
    """Pending jobs in approval order (``is_incremental_load`` false first, then by
    age; ``approval_order``). An increment with an anchor is skipped unless the anchor is
    done or approved, at the start or earlier in the same batch. Anchors form chains; each
    round decides the jobs whose anchor is decided, until none is open."""
    inc = F.coalesce(F.col("is_incremental_load"), F.lit(False))
    p = jobs.where(F.col("status").isin(*APPROVABLE)).withColumn("_inc", inc).withColumn(
        "_il", inc & _named("matched_table_name").isNotNull())
    place = F.struct(F.col("_inc"), F.col("created_at"), F.col("job_id"))
    anchor = jobs.select(F.col("job_id").alias("peer_anchor_job_id"), F.col("status").alias("_astatus"),
                         F.struct(inc.alias("_inc"), F.col("created_at"), F.col("job_id")).alias("_aplace"))
    j = p.withColumn("_place", place).join(anchor, "peer_anchor_job_id", "left")
    waits = (F.col("_il") & F.col("_astatus").isNotNull() & ~F.col("_astatus").isin(*ANCHOR_DONE))
    earlier = F.col("_astatus").isin(*APPROVABLE) & (F.col("_aplace") < F.col("_place"))
    j = j.withColumn("action", F.when(~F.coalesce(waits, F.lit(False)), "approve").when(~earlier, "skip"))
    j = cut_lineage(j.drop("_aplace", "_place"))
    while not j.where("action IS NULL").isEmpty():
        known = j.where("action IS NOT NULL").select(F.col("job_id").alias("peer_anchor_job_id"), F.col("action").alias("_known"))
        j = cut_lineage(j.join(known, "peer_anchor_job_id", "left")
                        .withColumn("action", F.coalesce("action", "_known")).drop("_known"))
    j = row_numbers(j, ["_inc", "created_at", "job_id"], "_order")
    return j.select("job_id", F.col("_il").alias("is_incremental"), "created_at", "action",
                    F.when(F.col("_il"), F.col("matched_table_name"))
                    .otherwise(F.lower(F.col("proposed_table_name"))).alias("table_name"),
                    F.col("_order").cast("int").alias("approval_order"))


def parse_metadata_date(c: Column) -> Column:
    """Flexible date parse over a fixed format list; NULL when unparseable."""
    s = F.trim(c)
    return parse_formats(s, METADATA_DATE_FORMATS)


def approval_metadata(meta: DataFrame) -> DataFrame:
    """``meta(job_id, source, source_url, released_on, updated_on, business_metadata)``
    -> parsed dates and an ``error`` for missing fields or bad dates."""
    missing = F.concat_ws(", ", *[F.when(F.col(k).isNull() | (F.trim(k) == ""), F.lit(k))
                                  for k in REQUIRED_METADATA])
    rel, upd = parse_metadata_date(F.col("released_on")), parse_metadata_date(F.col("updated_on"))
    err = (F.when(missing != "", F.concat(F.lit("missing fields: "), missing))
           .when(rel.isNull() | upd.isNull(), F.lit("Invalid date format")))
    return meta.select("job_id", "source", "source_url", rel.alias("released_on"), upd.alias("updated_on"),
                       "business_metadata", err.alias("error"))
