"""Load flows: one-time load (L15), incremental load with audit (L9), catalog
upkeep (L10-L12), purge (L14), exports (L13)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import periods
from sheaf.functions import types as TY
from sheaf.operators import signatures as SG
from sheaf.operators import upsert as U
from sheaf.sources.store import LOAD_AUDIT, OPERATIONAL_METADATA, TABLES_METADATA, TableStore


def _row_df(spark, schema: T.StructType, row: dict) -> DataFrame:
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)


def coalesce_merge(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert where every non-key field is ``COALESCE(new, old)``."""
    j = existing.alias("o").join(incoming.alias("n"), keys, "full_outer")
    cols = [F.col(k) for k in keys]
    for c in existing.columns:
        if c in keys:
            continue
        if c in incoming.columns:
            cols.append(F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"o.`{c}`").alias(c))
    return j.select(*cols)


def upsert_operational_metadata(store: TableStore, row: dict):
    """L11 persisted: the operational row of one table, COALESCE(new, old) per field."""
    spark = store.spark
    inc = _row_df(spark, OPERATIONAL_METADATA, row)
    cur = store.read("operational_metadata").drop(U.AUDIT_COLUMN)
    old = cur.where(F.col("table_name") == row["table_name"])
    merged = coalesce_merge(old, inc, ["table_name"])
    store.upsert("operational_metadata", merged, ["table_name"], order=None)


def increment_operational(store: TableStore, table_name: str, rows_added: int, now: dt.datetime,
                          last_value: str | None):
    """rows_count += inserted rows; last_updated_on = now; last value advanced
    when known (recomputed by the caller)."""
    cur = store.read("operational_metadata").where(F.col("table_name") == table_name).drop(U.AUDIT_COLUMN)
    upd = cur.select(
        *[(F.col("rows_count") + F.lit(rows_added)).alias(c) if c == "rows_count"
          else F.lit(now).cast("timestamp").alias(c) if c == "last_updated_on"
          else (F.coalesce(F.lit(last_value), F.col(c)).alias(c) if c == "last_available_value" else F.col(c))
          for c in cur.columns])
    store.upsert("operational_metadata", upd, ["table_name"], order=None)


def one_time_load(store: TableStore, table_name: str, df: DataFrame, column_types: dict[str, str] | None = None,
                  key_columns: list[str] | None = None, meta: dict | None = None, now: dt.datetime | None = None,
                  period_col: str | None = None) -> dict:
    """Create -> append -> period SQL -> tables_metadata (L10) ->
    operational_metadata (L11) -> signature (J7, J11). Returns a summary dict."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    meta = meta or {}
    store.ensure_catalog()
    name = table_name.lower()
    schema = (T.StructType([T.StructField(c, TY.to_spark_type(t), True) for c, t in column_types.items()])
              if column_types else T.StructType([T.StructField(f.name.lower(), f.dataType, True)
                                                 for f in df.schema.fields if not f.name.startswith("_")]))
    store.create_table(name, schema, key_columns)
    data = df.select(*[c for c in df.columns if not c.startswith("_")] + (["_row"] if "_row" in df.columns else []))
    if key_columns:
        res = store.upsert(name, data, key_columns, ts=now)
        rows = res["rows_inserted"]
    else:
        rows, _ = store.append(name, data, ts=now)
    cols = [f.name for f in store.schema(name).fields if f.name != U.AUDIT_COLUMN]
    pcol = period_col or periods.detect_period_column_py(cols)
    first = last = None
    mn_sql = mx_sql = None
    if pcol:
        b = periods.period_bounds(store.read(name), pcol).first()
        first, last = b["first_value"], b["last_value"]
        mn_sql, mx_sql = periods.period_sql(name, pcol)
    tm = dict(meta, table_name=name, columns=cols, rows_count=rows, period_cols=pcol, created_at=now,
              min_period_sql=mn_sql, max_period_sql=mx_sql, updated_on=now, key_columns=key_columns or [],
              table_view=meta.get("table_view", "Table"))
    store.upsert("tables_metadata", _row_df(store.spark, TABLES_METADATA, tm), ["table_name"], order=None, ts=now)
    om = {"table_name": name, "table_view": tm["table_view"], "period_cols": pcol,
          "first_available_value": first, "last_available_value": last, "last_updated_on": now,
          "rows_count": rows, "columns": cols, "source_url": meta.get("source_url"),
          "business_metadata": meta.get("business_metadata"), "major_domain": meta.get("major_domain"),
          "sub_domain": meta.get("sub_domain"), "brief_summary": meta.get("brief_summary")}
    upsert_operational_metadata(store, om)
    write_signature(store, name)
    return {"table_name": name, "rows": rows, "period_col": pcol, "first": first, "last": last}


def write_signature(store: TableStore, table_name: str) -> None:
    """J11 insert: the table's signature replaces the one it had."""
    df = store.read(table_name).drop(U.AUDIT_COLUMN)
    keys = store.primary_keys(table_name)
    if keys:
        df = df.withColumn("_row", F.struct(*[F.col(f"`{k}`") for k in keys]))
    sig = SG.build_signature(df, table_name.lower(), store.column_types(table_name))
    store.upsert("signatures", sig, ["table_name"], order=None)


def delete_signature(store: TableStore, table_name: str) -> None:
    """J11 delete by name."""
    store.delete("signatures", store.spark.createDataFrame([(table_name.lower(),)], "table_name string"))


def backfill_signatures(store: TableStore, dry_run: bool = False) -> dict:
    """Signatures for the tables that have none; a dry run only counts."""
    store.ensure_catalog()
    names = store.spark.createDataFrame([(t,) for t in store.tables()], "table_name string")
    missing = [r[0] for r in SG.backfill_candidates(names, store.read("signatures")).collect()]
    if not dry_run:
        for t in missing:
            write_signature(store, t)
    return {"tables": len(store.tables()), "missing": len(missing), "written": 0 if dry_run else len(missing)}


def batch_done(store: TableStore, table_name: str, batch_id: int) -> bool:
    seen = store.read("load_audit").where((F.col("table_name") == table_name.lower()) & (F.col("batch_id") == batch_id))
    return not seen.isEmpty()


def incremental_load(store: TableStore, table_name: str, df: DataFrame, batch_id: int, key_columns: list[str] | None = None,
                     now: dt.datetime | None = None, on_missing: str = "null") -> dict:
    """Keys (L8) -> schema diff/evolution (L6) -> widening by the data (T7, T8) -> align
    (L5) -> stamp (L7) -> upsert or append -> operational increment (L12) -> audit row
    (``load_audit``). The caller names the batch; one that ``load_audit`` lists already is
    skipped (replay safety)."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    name = table_name.lower()
    store.ensure_catalog()
    if batch_done(store, name, batch_id):
        return {"skipped": True, "table_name": name, "batch_id": batch_id}
    warnings: list[str] = []
    rows_before = store.count(name)
    data_cols = [c for c in df.columns if not c.startswith("_")]
    keys = U.resolve_keys(store.primary_keys(name), key_columns, data_cols, warnings)
    ev = U.evolve_schema(store.schema(name), df.select(*[F.col(f"`{c}`") for c in data_cols]).schema)
    warnings += ev.warnings
    if ev.columns_added or ev.schema_changes:
        store.replace_schema(name, ev.schema)
    src = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
    changes = ev.schema_changes + store.widen(name, src)
    if keys:
        res = store.upsert(name, src, keys, ts=now, on_missing=on_missing)
        ins, upd, dup, nk = res["rows_inserted"], res["rows_updated"], res["duplicates"], res["null_keys"]
        warnings += res["warnings"]
    else:
        ins, lost = store.append(name, src, ts=now)
        warnings += lost
        upd = dup = nk = 0
    rows_after = store.count(name)
    om = store.read("operational_metadata").where(F.col("table_name") == name).select("period_cols").first()
    if om is not None:
        pcol, last = om["period_cols"], None
        if pcol and pcol in store.schema(name).names:
            last = periods.period_bounds(store.read(name), pcol).first()["last_value"]
        increment_operational(store, name, ins, now, last)
    audit = {"table_name": name, "batch_id": batch_id, "rows_before": rows_before, "rows_inserted": ins,
             "rows_updated": upd, "rows_after": rows_after, "duplicates": dup, "null_keys": nk,
             "columns_added": ev.columns_added, "schema_changes": changes, "warnings": warnings,
             "keys": keys, "timestamp": now}
    store.upsert("load_audit", _row_df(store.spark, LOAD_AUDIT, audit), ["table_name", "batch_id"],
                 order=None, ts=now)
    return audit


def purge_by_date(store: TableStore, day: dt.date, dry_run: bool = True) -> list[str]:
    """Tables created on ``day`` (catalog ``created_at``); unless a dry run,
    drop them and remove their catalog and signature rows."""
    store.ensure_catalog()
    sel = (store.read("tables_metadata").where(F.to_date("created_at") == F.lit(day))
           .select("table_name").distinct())
    names = [r[0] for r in sel.toLocalIterator()]  # names of tables: each is dropped by a command
    if not dry_run:
        drop_tables(store, names)
    return names


def drop_tables(store: TableStore, names: list[str]):
    """Drop tables and their catalog / signature rows."""
    if not names:
        return
    gone = store.spark.createDataFrame([(n.lower(),) for n in names], "table_name string")
    for n in names:
        store.drop_table(n)
    for cat in ("tables_metadata", "operational_metadata", "signatures"):
        store.delete(cat, gone)


def export(df: DataFrame, path: str, fmt: str = "csv"):
    """CSV with header, or JSON records keeping NULL fields; ISO dates."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd") \
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    else:
        w.option("ignoreNullFields", False).option("dateFormat", "yyyy-MM-dd") \
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
