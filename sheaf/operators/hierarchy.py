"""Hierarchical tables (category 2): row roles (C6), structural columns (C7),
hierarchy resolution (C8), data-row filter (C9), index drop (C10), category (C12).

Rows carry ``_file`` and ``_row``. Hierarchy resolution never windows over a whole
file: rows are cut into range slices of about equal numbers of rows, and each slice takes
the last header per level from the slices before it (``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators import data_columns
from sheaf.operators.clean import FOOTER_RE
from sheaf.operators.ordered import carry_max, range_slices

# ---- fixed values ------------------------------------------------------------
SUBTOTAL_RE = r"(?i)\b(sub[- ]?)?total\b"
DERIVED_RE = r"(?i)%|\bratio\b|\bshare\b|\bpercent(age)?\b|\bgrowth\b|\bper cent\b"
MARKER_RE = r"^\s*([A-Z]|[IVXLC]+|[ivxlc]+|\d+(\.\d+)*)\s*[.)]?\s*$"
ROLES = ["data", "group_header", "subtotal", "footer", "derived"]
# ------------------------------------------------------------------------------


def _q(c):
    return F.col(f"`{c}`")


def index_level(marker: Column) -> Column:
    """Level from the index style: single capital letter (not I/V/X) -> 0;
    upper roman -> 1; lower roman -> 2; ``1`` / ``1.1`` / ``1.1.1`` -> dots."""
    m = F.regexp_replace(F.trim(marker), r"[.)]$", "")
    return (F.when(m.rlike(r"^[A-HJ-UWYZ]$"), F.lit(0))
            .when(m.rlike(r"^[IVXLC]+$"), F.lit(1))
            .when(m.rlike(r"^[ivxlc]+$"), F.lit(2))
            .when(m.rlike(r"^\d+(\.\d+)*$"), F.size(F.split(m, r"\.")) - 1))


def structural_columns(df: DataFrame) -> tuple[str | None, str]:
    """Index column = the column whose non-null cells are mostly hierarchy
    markers (> 50 %); label column = the string column with the largest share of
    alphabetic text among the rest (fallback: first string column). One aggregate."""
    cols = data_columns(df)
    strs = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(strs):
        v = F.trim(_q(c))
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.when(v.rlike(MARKER_RE), 1)).alias(f"m{i}"),
                 F.count(F.when(v.rlike(r"\p{L}{3,}"), 1)).alias(f"t{i}")]
    if not aggs:
        return None, cols[0]
    r = df.agg(*aggs).first()
    idx, best = None, 0.5
    for i, c in enumerate(strs):
        share = r[f"m{i}"] / r[f"n{i}"] if r[f"n{i}"] else 0
        if share > best:
            idx, best = c, share
    label, lbest = None, -1.0
    for i, c in enumerate(strs):
        if c == idx:
            continue
        share = r[f"t{i}"] / r[f"n{i}"] if r[f"n{i}"] else 0
        if share > lbest:
            label, lbest = c, share
    return idx, label or strs[0]


def classify_rows(df: DataFrame, index_col: str | None, label_col: str,
                  measure_cols: list[str] | None = None) -> DataFrame:
    """Role per row -- subtotal (``total`` in the label), footer (C5 pattern),
    derived (``%``/ratio words), group_header (label present, every measure NULL;
    level from the index style, else 0), data otherwise. Adds ``_role``, ``_level``."""
    measures = measure_cols if measure_cols is not None else [
        c for c in data_columns(df) if c not in (index_col, label_col)]
    label = F.trim(_q(label_col).cast("string"))
    no_measure = F.lit(True)
    for m in measures:
        no_measure = no_measure & (_q(m).isNull() | (F.trim(_q(m).cast("string")) == ""))
    lvl = index_level(_q(index_col).cast("string")) if index_col else F.lit(None).cast("int")
    role = (F.when(label.rlike(SUBTOTAL_RE), F.lit("subtotal"))
            .when(label.rlike(FOOTER_RE), F.lit("footer"))
            .when(label.rlike(DERIVED_RE), F.lit("derived"))
            .when(label.isNotNull() & (label != "") & no_measure, F.lit("group_header"))
            .otherwise(F.lit("data")))
    return df.withColumn("_role", role).withColumn(
        "_level", F.when(F.col("_role") == "group_header", F.coalesce(lvl, F.lit(0))))


def resolve_hierarchy(df: DataFrame, label_col: str, levels: int, slices: int | None = None,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Every row gets ``group_cols[k]`` = label of the newest level-k header
    above it, when that header is newer than every header of a shallower level
    (a header clears deeper levels). Needs ``_file``, ``_row``, ``_role``, ``_level``."""
    names = group_cols or [f"level_{k}" for k in range(levels)]
    hdr = F.col("_role") == "group_header"
    # per-level "last header so far" as struct(row, label)
    d = carry_max(range_slices(df, ["_file", "_row"], slices), "_file", "_row", {
        f"_h{k}": F.when(hdr & (F.col("_level") == k), F.struct(F.col("_row").alias("r"), F.trim(_q(label_col)).alias("l")))
        for k in range(levels)})
    newest_shallower = F.lit(None).cast("long")
    out_cols = []
    for k in range(levels):
        r = F.col(f"_h{k}.r")
        valid = r.isNotNull() & (newest_shallower.isNull() | (r > newest_shallower))
        out_cols.append(F.when(valid, F.col(f"_h{k}.l")).alias(names[k]))
        newest_shallower = F.greatest(newest_shallower, r) if k else r
    keep = [c for c in df.columns]
    return d.select(*[F.col(f"`{c}`") for c in keep], *out_cols)


def keep_data_rows(df: DataFrame) -> DataFrame:
    """C9."""
    return df.where(F.col("_role") == "data")


def table_category(df_roles: DataFrame) -> DataFrame:
    """C12 per file: 2 when any row is not a data row, else 1; plus the share of
    mostly-empty columns as evidence (Q3)."""
    cols = [c for c in data_columns(df_roles)]
    empty_share = [F.avg(F.when(_q(c).isNull(), 1.0).otherwise(0.0)).alias(f"e{i}") for i, c in enumerate(cols)]
    a = df_roles.groupBy("_file").agg(
        F.max(F.when(F.col("_role") != "data", 1).otherwise(0)).alias("_mixed"), *empty_share)
    n_empty = sum((F.when(F.col(f"e{i}") > 0.5, 1).otherwise(0) for i in range(len(cols))), F.lit(0))
    return a.select("_file", F.when(F.col("_mixed") == 1, 2).otherwise(1).alias("category"),
                    n_empty.alias("mostly_empty_columns"))


def flatten(df: DataFrame, levels: int = 2, slices: int | None = None,
            index_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """C6 -> C8 -> C9 -> C10 (+ C11 on labels by the caller)."""
    if label_col is None:
        index_col, label_col = structural_columns(df)
    roles = classify_rows(df, index_col, label_col)
    resolved = resolve_hierarchy(roles, label_col, levels, slices)
    out = keep_data_rows(resolved).drop("_role", "_level")
    return out.drop(index_col) if index_col else out
