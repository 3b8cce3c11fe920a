"""Schema comparison (M1-M6) and type drift (T5, T6) over long schema frames.

Schemas are DataFrames ``(column_name, col_type)`` (optionally keyed by table),
so many files can be compared against many tables in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import types as TY

RESERVED = "ingested_at"


def type_drift(existing: DataFrame, incoming: DataFrame, keys=("column_name",)) -> DataFrame:
    """T5: per shared column, (from_type, to_type, safe) when the types differ and
    the incoming type is not text. Types are alias-normalised (T3) with
    parameters stripped, safety from the lattice (T4)."""
    k = list(keys)
    e = existing.select(*k, TY.normalise_type("col_type").alias("from_type"))
    i = incoming.select(*k, TY.normalise_type("col_type").alias("to_type"))
    j = e.join(i, k, "inner")
    return (j.where((F.col("from_type") != F.col("to_type")) & (F.col("to_type") != "text"))
            .select(*k, "from_type", "to_type", TY.safe_widening("from_type", "to_type").alias("safe")))


def effective_types(table_types: DataFrame, inferred: DataFrame, keys=("column_name",)) -> DataFrame:
    """The table's type wins; inferred type for columns the table lacks."""
    k = list(keys)
    return (inferred.select(*k, F.col("col_type").alias("inf"))
            .join(table_types.select(*k, F.col("col_type").alias("tab")), k, "left")
            .select(*k, F.coalesce("tab", "inf").alias("col_type")))


def column_set_diff(pairs: DataFrame, new_sets: DataFrame, table_sets: DataFrame) -> DataFrame:
    """M1, M2, M4 for many (new file, table) pairs at once.

    ``pairs(new_id, table_id)``; sets are ``(set_id, col)`` (lower-cased names,
    audit column excluded by the caller). A full outer join per pair on the
    column name gives side flags; counts come from one aggregate."""
    n = new_sets.select(F.col("set_id").alias("new_id"), F.lower("col").alias("col"), F.lit(True).alias("in_new"))
    t = table_sets.select(F.col("set_id").alias("table_id"), F.lower("col").alias("col"),
                          F.lit(True).alias("in_table")).where(F.col("col") != RESERVED)
    pn = pairs.join(n, "new_id")
    pt = pairs.join(t, "table_id")
    both = pn.join(pt, ["new_id", "table_id", "col"], "full_outer")
    agg = both.groupBy("new_id", "table_id").agg(
        F.count(F.when(F.col("in_table") & F.col("in_new").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("in_new") & F.col("in_table").isNull(), 1)).alias("n_extra"),
        F.count(F.when(F.col("in_new") & F.col("in_table"), 1)).alias("n_matching"),
        F.count(F.when(F.col("in_table"), 1)).alias("n_existing"))
    return agg.select(
        "new_id", "table_id", "n_missing", "n_extra", "n_matching",
        F.when(F.col("n_existing") > 0, F.round(F.col("n_matching") * 100.0 / F.col("n_existing"), 2))
        .otherwise(F.lit(0.0)).alias("match_pct"),
        ((F.col("n_missing") == 0) & (F.col("n_extra") == 0)).alias("is_compatible"),
        (F.col("n_missing") == 0).alias("is_additive"))


def schema_diff_lists(pairs: DataFrame, new_sets: DataFrame, table_sets: DataFrame,
                      reconciled: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """M1-M4 with the column lists (sorted), M3 reconciled renames counted into the
    match %, and the unsafe-drift flag for additive evolution. Lists are bounded by
    the table width."""
    n = new_sets.select(F.col("set_id").alias("new_id"), F.lower("col").alias("col"), F.lit(True).alias("in_new"))
    t = table_sets.select(F.col("set_id").alias("table_id"), F.lower("col").alias("col"),
                          F.lit(True).alias("in_table")).where(F.col("col") != RESERVED)
    both = pairs.join(n, "new_id").join(pairs.join(t, "table_id"), ["new_id", "table_id", "col"], "full_outer")
    agg = both.groupBy("new_id", "table_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("in_table") & F.col("in_new").isNull(), F.col("col")))).alias("missing"),
        F.sort_array(F.collect_list(F.when(F.col("in_new") & F.col("in_table").isNull(), F.col("col")))).alias("extra"),
        F.sort_array(F.collect_list(F.when(F.col("in_new") & F.col("in_table"), F.col("col")))).alias("matching"),
        F.count(F.when(F.col("in_table"), 1)).alias("n_existing"))
    if reconciled is not None:
        rec = reconciled.groupBy("new_id", "table_id").agg(
            F.collect_list("existing").alias("rec_existing"), F.collect_list("new").alias("rec_new"))
        agg = agg.join(rec, ["new_id", "table_id"], "left")
    else:
        agg = agg.withColumn("rec_existing", F.array().cast("array<string>")) \
            .withColumn("rec_new", F.array().cast("array<string>"))
    agg = (agg.withColumn("missing", F.array_except("missing", F.coalesce("rec_existing", F.array())))
           .withColumn("extra", F.array_except("extra", F.coalesce("rec_new", F.array())))
           .withColumn("n_reconciled", F.size(F.coalesce("rec_existing", F.array()))))
    if drift is not None:
        unsafe = drift.where(~F.col("safe")).groupBy("new_id", "table_id").agg(F.lit(True).alias("has_unsafe"))
        agg = agg.join(unsafe, ["new_id", "table_id"], "left")
    else:
        agg = agg.withColumn("has_unsafe", F.lit(None).cast("boolean"))
    pct = F.when(F.col("n_existing") > 0,
                 F.round((F.size("matching") + F.col("n_reconciled")) * 100.0 / F.col("n_existing"), 2)).otherwise(0.0)
    return agg.select("new_id", "table_id", "missing", "extra", "matching", "n_reconciled",
                      pct.alias("match_pct"),
                      ((F.size("missing") == 0) & (F.size("extra") == 0)).alias("is_compatible"),
                      ((F.size("missing") == 0) & ~F.coalesce("has_unsafe", F.lit(False))).alias("is_additive"))


def reconcile_pairs(candidates: DataFrame) -> DataFrame:
    """M3: proposed ``(new_id, table_id, existing, new, ord)`` rename pairs, taken in
    ``ord`` order: a pair is accepted when neither of its sides was used by an accepted
    pair before it, so a rejected pair blocks nobody. Folded per pair of tables over their
    proposals (at most columns x columns). Validity of both sides is checked by the
    caller's join."""
    pairs = candidates.groupBy("new_id", "table_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "existing", "new"))).alias("_p"))
    none = F.expr("cast(array() as array<struct<ord:bigint,existing:string,new:string>>)")

    def take(done, p):
        free = ~F.exists(done, lambda d: (d["existing"] == p["existing"]) | (d["new"] == p["new"]))
        own = F.struct(p["ord"].cast("bigint").alias("ord"), p["existing"].alias("existing"), p["new"].alias("new"))
        return F.when(free, F.concat(done, F.array(own))).otherwise(done)

    kept = pairs.select("new_id", "table_id", F.explode(F.aggregate("_p", none, take)).alias("k"))
    return kept.select("new_id", "table_id", "k.existing", "k.new", "k.ord")


def discrepancy_report(diff: DataFrame, max_matching: int = 10) -> DataFrame:
    """M5: report rows ``(new_id, table_id, section, column_name)``; the matching
    section lists at most ``max_matching`` names (as the text report does)."""
    secs = []
    for sec, col in (("missing", "missing"), ("extra", "extra")):
        secs.append(diff.select("new_id", "table_id", F.lit(sec).alias("section"),
                                F.explode(col).alias("column_name")))
    secs.append(diff.select("new_id", "table_id", F.lit("matching").alias("section"),
                            F.explode(F.slice("matching", 1, max_matching)).alias("column_name")))
    out = secs[0]
    for s in secs[1:]:
        out = out.unionByName(s)
    return out


def discrepancy_text(diff: DataFrame) -> DataFrame:
    """M5 text form, one row per pair."""
    return diff.select(
        "new_id", "table_id",
        F.concat_ws("\n",
                    F.format_string("Match: %.2f%%", F.col("match_pct")),
                    F.concat(F.lit("Missing columns: "), F.array_join("missing", ", ")),
                    F.concat(F.lit("Extra columns: "), F.array_join("extra", ", ")),
                    F.concat(F.lit("Matching columns: "), F.array_join(F.slice("matching", 1, 10), ", ")))
        .alias("report"))


def validate_increment(files: DataFrame, new_sets: DataFrame, tables_metadata: DataFrame,
                       reconciled: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """M6: ``files(new_id, table_id)`` against the columns that the catalog lists for their
    tables: M1-M5 composed, one row per file with verdict and report; a table that the
    catalog lacks gives an error."""
    known = tables_metadata.select(F.col("table_name").alias("table_id"), "columns")
    table_sets = known.select(F.col("table_id").alias("set_id"), F.explode("columns").alias("col")).distinct()
    pairs = files.join(known.select("table_id").distinct(), "table_id", "left_semi").select("new_id", "table_id")
    diff = schema_diff_lists(pairs, new_sets, table_sets, reconciled=reconciled, drift=drift)
    report = discrepancy_text(diff)
    told = diff.join(report, ["new_id", "table_id"]) if "table_id" in report.columns else diff.join(report, "new_id")
    found = files.join(told, ["new_id", "table_id"], "left")
    lacks = F.col("match_pct").isNull()
    error = F.when(lacks, F.format_string("Table '%s' not found in metadata", "table_id"))
    return found.select("new_id", "table_id", F.coalesce("is_compatible", F.lit(False)).alias("is_compatible"),
                        F.coalesce("is_additive", F.lit(False)).alias("is_additive"), "missing", "extra", "matching",
                        "match_pct", error.alias("error"), F.coalesce("report", error).alias("report"))
