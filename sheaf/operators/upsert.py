"""Merge operators for loads (L3-L8) as pure DataFrame transforms.

The table store (``sheaf.sources.store``) persists their results; here they are
plain plans so they can be tested against SQL and reused by streaming batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import types as TY

AUDIT_COLUMN = "ingested_at"


def _norm(c: str) -> str:
    return c.strip().lower()


def stamp(df: DataFrame, ts) -> DataFrame:
    """``ingested_at`` audit column; the timestamp is a parameter."""
    return df.withColumn(AUDIT_COLUMN, F.lit(ts).cast("timestamp"))


def align(df: DataFrame, schema: T.StructType, keep_audit: bool = False) -> DataFrame:
    """Columns in table order, matched case-insensitively after trim; table
    columns missing from ``df`` become typed NULLs; extra columns are dropped.
    Values are cast to the table type (``try_cast``: bad -> NULL)."""
    by_norm = {_norm(c): c for c in df.columns}
    out = []
    for f in schema.fields:
        if f.name == AUDIT_COLUMN and not keep_audit:
            continue
        src = by_norm.get(_norm(f.name))
        if src is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif df.schema[src].dataType == f.dataType:
            out.append(F.col(f"`{src}`").alias(f.name))
        else:
            out.append(F.col(f"`{src}`").try_cast(f.dataType).alias(f.name))
    return df.select(*out)


@dataclass
class Evolution:
    schema: T.StructType
    columns_added: list[str] = field(default_factory=list)
    schema_changes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def evolve_schema(table: T.StructType, incoming: T.StructType) -> Evolution:
    """Add incoming columns the table lacks (nullable, at the end); incoming text over
    a typed column is ignored (values are read into the table's type); apply safe widenings (lattice T4); unsafe changes keep the table type (values are coerced
    on write, bad -> NULL) and add a warning. Columns are never dropped."""
    have = {_norm(f.name): f for f in table.fields}
    fields = list(table.fields)
    ev = Evolution(schema=table)
    for f in incoming.fields:
        n = _norm(f.name)
        if n == AUDIT_COLUMN:
            continue
        if n not in have:
            fields.append(T.StructField(n, f.dataType, True))
            ev.columns_added.append(n)
            continue
        old = have[n]
        a, b = TY.spark_to_sql_type(old.dataType), TY.spark_to_sql_type(f.dataType)
        if a == b or b == "text":  # untyped text says nothing: the table keeps its type
            continue
        if TY.is_safe_widening_py(a, b):
            fields = [T.StructField(old.name, f.dataType, True) if x.name == old.name else x for x in fields]
            ev.schema_changes.append(f"{old.name}: {a} -> {b}")
        else:
            ev.warnings.append(f"{old.name}: unsafe change {a} -> {b}; values coerced to {a}, bad values -> NULL")
    ev.schema = T.StructType(fields)
    return ev


def dedupe_last(df: DataFrame, keys: list[str], order: Column | str | None = "_row",
                count_col: str | None = None) -> DataFrame:
    """Keep the last row (by ``order``) per key. ``max_by`` is a map-side partial
    aggregate, so a key holding a third of the rows never lands whole in one task.
    ``count_col`` adds the number of rows seen per key."""
    others = [c for c in df.columns if c not in keys]
    extra = [F.count(F.lit(1)).alias(count_col)] if count_col else []
    if order is None or not others:
        pick = F.first(F.struct(*[F.col(f"`{c}`") for c in others])) if others else None
    else:
        order = F.col(order) if isinstance(order, str) else order
        pick = F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), order)
    if pick is None:
        return df.groupBy(*keys).agg(*extra) if extra else df.dropDuplicates(keys)
    agg = df.groupBy(*keys).agg(pick.alias("_last"), *extra)
    return agg.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in others],
                      *([F.col(count_col)] if count_col else []))


@dataclass
class MergeResult:
    merged: DataFrame          # the table after the merge
    rejected: DataFrame        # incoming rows with a NULL key
    counts: DataFrame          # one row: inserted, updated, unchanged, duplicates, null_keys


def upsert_merge(existing: DataFrame, incoming: DataFrame, keys: list[str], ts=None,
                 order: Column | str | None = "_row", on_missing: str = "null",
                 hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> MergeResult:
    """L3: key match -> the incoming row replaces every non-key column and gets a
    fresh ``ingested_at``; new keys are inserted; other table rows stay as they are.

    * NULL keys go to ``rejected`` (a key cannot be NULL).
    * Repeated keys in one batch: the last by ``order`` wins; the repeats are counted.
    * ``on_missing='null'``: table columns absent from the file overwrite with NULL
      (source behaviour); ``'keep'`` keeps the stored value.
    The join is a full outer join on the (unique) keys; presence flags pick the
    side, and the counts come from the same flags in one aggregate. ``hold`` may write the
    joined rows out, so that the table and the counts share one join."""
    inc_cols = {_norm(c) for c in incoming.columns}
    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(k).isNotNull()
    rejected = incoming.where(~key_ok)
    good = incoming.where(key_ok)
    use_order = order is not None and (not isinstance(order, str) or order in good.columns)
    src = dedupe_last(good, keys, order if use_order else None, count_col="_n")
    counted = T.StructType([*existing.schema.fields, T.StructField("_n", T.LongType())])
    src = align(src, counted).withColumn("_new", F.lit(True))
    if AUDIT_COLUMN in existing.columns:
        src = src.withColumn(AUDIT_COLUMN, F.lit(ts).cast(existing.schema[AUDIT_COLUMN].dataType))
    old = existing.withColumn("_old", F.lit(True))
    j = old.alias("o").join(src.alias("n"), keys, "full_outer")
    cols = []
    for f in existing.schema.fields:
        c = f.name
        if c in keys:
            cols.append(F.col(c))
            continue
        newv, oldv = F.col(f"n.`{c}`"), F.col(f"o.`{c}`")
        if on_missing == "keep" and _norm(c) not in inc_cols and c != AUDIT_COLUMN:
            v = oldv
        else:
            v = F.when(F.col("n._new"), newv).otherwise(oldv)
        cols.append(v.alias(c))
    flags = hold(j.select(*cols, F.coalesce(F.col("n._new"), F.lit(False)).alias("_in_new"),
                     F.coalesce(F.col("o._old"), F.lit(False)).alias("_in_old"),
                     F.coalesce(F.col("n._n"), F.lit(0)).alias("_n")))
    merged = flags.drop("_in_new", "_in_old", "_n")
    # one long frame of metrics, pivoted over a fixed list -> one audit row
    metrics = flags.select(
        F.when(F.col("_in_new") & ~F.col("_in_old"), 1).otherwise(0).alias("inserted"),
        F.when(F.col("_in_new") & F.col("_in_old"), 1).otherwise(0).alias("updated"),
        F.when(~F.col("_in_new") & F.col("_in_old"), 1).otherwise(0).alias("unchanged"),
        F.greatest(F.col("_n") - 1, F.lit(0)).alias("duplicates"), F.lit(0).alias("null_keys"))
    rej = rejected.select(*[F.lit(0).alias(m) for m in ("inserted", "updated", "unchanged", "duplicates")],
                          F.lit(1).alias("null_keys"))
    counts = metrics.unionByName(rej).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in
                                            ("inserted", "updated", "unchanged", "duplicates", "null_keys")])
    return MergeResult(merged, rejected, counts)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  order: Column | str | None = "_row") -> tuple[DataFrame, DataFrame]:
    """L4: rows whose key is not in the table are appended (first per key);
    returns (new rows, table after)."""
    src = incoming
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    if order is not None and (not isinstance(order, str) or order in src.columns):
        o = F.col(order) if isinstance(order, str) else order
        others = [c for c in src.columns if c not in keys]
        src = src.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), o).alias("_f")) \
            .select(*keys, *[F.col(f"_f.`{c}`").alias(c) for c in others])
    else:
        src = src.dropDuplicates(keys)
    new = align(src.join(existing.select(*keys), keys, "left_anti"), existing.schema, keep_audit=True)
    return new, existing.unionByName(new)


def resolve_keys(catalog_keys: list[str] | None, explicit: list[str] | None, data_columns: list[str],
                 warnings: list[str]) -> list[str]:
    """Catalog key first, then the explicit list; keys absent from the data are
    skipped with a warning; none -> append mode (warned)."""
    chosen = catalog_keys or explicit or []
    have = {_norm(c) for c in data_columns}
    keys = [k for k in chosen if _norm(k) in have]
    for k in chosen:
        if _norm(k) not in have:
            warnings.append(f"key column {k} not in data; skipped")
    if not keys:
        warnings.append("no key columns: rows are appended")
    return keys
