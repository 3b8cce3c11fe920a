"""Load decision (D1-D8): candidate ladder, guards, overrides, manual modes,
duplicate-period detection, routing and increment preview -- all as joins,
filters and ``when`` chains over decision DataFrames, many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import periods
from sheaf.functions.names import name_jaccard

# ---- fixed values ------------------------------------------------------------
SOURCE_PRIORITY = {"exact": 1, "vector": 2, "column": 3, "peer": 4}
MIN_MATCH_PCT = 60.0
OVERRIDE_MIN_OVERLAP = 85.0
OVERRIDE_MAX_CONFIDENCE = 0.85
OVERRIDE_MIN_NAME_SIM = 0.5
OVERRIDE_UNCONDITIONAL_OVERLAP = 95.0
# ------------------------------------------------------------------------------


def structural_override(overlap_pct: Column, confidence: Column, name_sim: Column) -> Column:
    """D3: structural evidence beats a rejection: (overlap >= 85 and confidence
    < 0.85 and name similarity >= 0.5) or (overlap >= 95 and confidence < 0.85)."""
    low_conf = confidence < F.lit(OVERRIDE_MAX_CONFIDENCE)
    return (((overlap_pct >= OVERRIDE_MIN_OVERLAP) & low_conf & (name_sim >= OVERRIDE_MIN_NAME_SIM))
            | ((overlap_pct >= OVERRIDE_UNCONDITIONAL_OVERLAP) & low_conf))


def match_ladder(candidates: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """D1 + D2 + D3: ``candidates(file_id, file_table, table_name, source, rank,
    score, match_pct)``. Vector candidates count only at rank 1; vector and column
    candidates need match % >= 60; a decision row ``(file_id, table_name,
    is_related, confidence)`` may reject (unless D3 overrides); no decision ->
    accept. The first survivor by (source priority, rank) wins; files without one
    become new tables. Output one row per file."""
    pr = F.create_map(*[x for k, v in SOURCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    c = candidates.withColumn("priority", pr[F.col("source")])
    c = c.where((F.col("source") != "vector") | (F.col("rank") == 1))
    c = c.where(~F.col("source").isin("vector", "column") | (F.col("match_pct") >= MIN_MATCH_PCT))
    if decisions is not None:
        c = c.join(decisions.select("file_id", "table_name", "is_related", "confidence"),
                   ["file_id", "table_name"], "left")
    else:
        c = c.withColumn("is_related", F.lit(None).cast("boolean")).withColumn("confidence", F.lit(None).cast("double"))
    override = structural_override(F.col("match_pct"), F.coalesce("confidence", F.lit(1.0)),
                                   name_jaccard(F.col("file_table"), F.col("table_name")))
    c = c.withColumn("accepted", F.coalesce(F.col("is_related"), F.lit(True)) | F.coalesce(override, F.lit(False)))
    c = c.where(F.col("accepted"))
    w = Window.partitionBy("file_id").orderBy("priority", "rank", "table_name")
    best = c.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1)
    files = candidates.select("file_id").distinct()
    return (files.join(best, "file_id", "left")
            .select("file_id", F.col("table_name").alias("target_table"), F.col("source").alias("matched_by"),
                    "score", "match_pct", F.col("table_name").isNotNull().alias("is_incremental")))


def manual_modes(files: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    """``files(file_id, sql_mode, table_name_override)``: 'otl' forces a new
    table; 'inc' forces the target, which must exist (else an error row)."""
    tgt = F.regexp_replace(F.lower(F.trim("table_name_override")), " ", "_")
    f = files.withColumn("_target", tgt)
    j = f.join(catalog_tables.select(F.col("table_name").alias("_target"), F.lit(True).alias("_exists")),
               "_target", "left")
    return j.select(
        "file_id", "sql_mode",
        F.when(F.col("sql_mode") == "inc", F.col("_target")).alias("target_table"),
        F.when(F.col("sql_mode") == "otl", F.lit(False)).when(F.col("sql_mode") == "inc", F.lit(True))
        .alias("is_incremental"),
        F.when((F.col("sql_mode") == "inc") & F.col("_exists").isNull(),
               F.concat(F.lit("target table does not exist: "), F.col("_target"))).alias("error"))


def duplicate_period_status(new_bounds: DataFrame, existing: DataFrame) -> DataFrame:
    """``new_bounds(file_id, table_name, new_first, new_last)`` against
    ``existing(table_name, last_available_value)``: NEW_DATA when the new first
    period is after the existing last (or nothing to compare); DUPLICATE when the
    existing last is strictly after the new last; else PARTIAL_OVERLAP;
    NO_PERIOD_COLUMN without new periods or without a metadata row."""
    j = new_bounds.join(existing.select("table_name", F.lit(True).alias("_meta"), "last_available_value"),
                        "table_name", "left")
    first_gt = periods.compare_period(F.col("new_first"), F.col("last_available_value"))
    last_lt = periods.compare_period(F.col("last_available_value"), F.col("new_last"))
    status = (F.when(F.col("_meta").isNull() | F.col("new_first").isNull(), F.lit("NO_PERIOD_COLUMN"))
              .when(F.col("last_available_value").isNull(), F.lit("NEW_DATA"))
              .when(first_gt["gt"], F.lit("NEW_DATA"))
              .when(last_lt["gt"], F.lit("DUPLICATE"))
              .otherwise(F.lit("PARTIAL_OVERLAP")))
    return j.select("file_id", "table_name", "new_first", "new_last",
                    F.col("last_available_value").alias("existing_last"), status.alias("status"),
                    F.when(F.col("last_available_value").isNotNull(), first_gt["method"]).alias("comparison_method"))


def route(decisions: DataFrame) -> DataFrame:
    """Increment + full duplicate + same schema -> duplicate_data_detected; any
    other increment -> schema_mismatch (review); new tables -> awaiting_approval."""
    return decisions.withColumn(
        "status", F.when(F.col("is_incremental") & (F.col("dup_status") == "DUPLICATE") & F.col("is_compatible"),
                         F.lit("duplicate_data_detected"))
        .when(F.col("is_incremental"), F.lit("schema_mismatch"))
        .otherwise(F.lit("awaiting_approval")))


def increment_preview(files: DataFrame, file_rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Rows new / current / after (current + new) per incremental file."""
    return (files.join(file_rows, "file_id", "left").join(table_rows, "table_name", "left")
            .select("file_id", "table_name", F.coalesce("new_rows", F.lit(0)).alias("new_rows_count"),
                    F.coalesce("current_rows", F.lit(0)).alias("current_rows_count"),
                    (F.coalesce("current_rows", F.lit(0)) + F.coalesce("new_rows", F.lit(0))).alias("total_rows_after")))
