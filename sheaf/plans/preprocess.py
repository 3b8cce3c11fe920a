"""Category-1 / category-2 preprocessing flows (C13) as lazy transform chains."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import periods
from sheaf.functions import numbers
from sheaf.operators import clean, headers, hierarchy, reshape


def add_standard_columns(df: DataFrame, as_of: dt.date | str, data_period: str | None = None,
                         period_value: str | None = None) -> DataFrame:
    """``refresh_date`` (the as-of date is a parameter, so runs are repeatable),
    ``data_period`` as ``Mmm yyyy``, and optionally ``period`` + ``fy``."""
    out = df.withColumn("refresh_date", F.lit(str(as_of)))
    if data_period:
        out = out.withColumn("data_period", periods.normalize_mmm_yyyy(F.lit(data_period)))
    if period_value:
        out = out.withColumn("period", F.lit(period_value))
        out = out.withColumn("fy", periods.derive_fy(F.lit(period_value)))
    return out


def preprocess_category1(df: DataFrame, analysis: dict | None = None, as_of=None) -> DataFrame:
    """C13 (category 1): header merge -> wide->long + period split -> clean ->
    period split of a native ``period`` column -> standard columns -> units ->
    month_numeric."""
    analysis = analysis or {}
    raw_names = [c for c in df.columns if not c.startswith("_")]
    out = df
    if analysis.get("needs_header_merge"):
        out = headers.merge_row_headers(out)
    out = reshape.melt_period_columns(out, hints=analysis.get("date_columns"))
    out = clean.clean_data(out)
    if "period" in out.columns:
        out = periods.split_period(out, "period")
    if as_of is not None:
        out = add_standard_columns(out, as_of, analysis.get("data_period"))
    out = clean.add_unit_columns(out, raw_names)
    return periods.add_month_numeric(out)


def monthly_long(wide: DataFrame, key: str) -> DataFrame:
    """Flagship body: wide monthly report -> W2/W1 -> P1/P4 -> empty cells out ->
    C2-C4 -> H4 names -> P8 month_numeric."""
    long = reshape.melt_period_columns(wide)
    long = long.where(F.col("value").isNotNull())
    long = clean.trim_and_nullify(long)
    long = clean.drop_sparse_rows(long)
    data = [c for c in long.columns if not c.startswith("_")]
    long = clean.rename_columns(long, dict(zip(data, clean.N.clean_names(data))))
    long = periods.add_month_numeric(long)
    return long


def preprocess_category2(df: DataFrame, analysis: dict | None = None, as_of=None, levels: int = 2,
                         slices: int | None = None) -> DataFrame:
    """C13 (category 2): header merge -> structural columns (C7) -> row roles
    -> hierarchy (C8) -> data rows (C9) -> index dropped (C10) -> labels (C11) ->
    Indian-format numbers (N1) -> guarded wide->long (W3) -> period split ->
    standard columns (P11) -> clean (C1-C4, H4) -> month_numeric (P8)."""
    analysis = analysis or {}
    out = df
    if analysis.get("needs_header_merge"):
        out = headers.merge_row_headers(out)
    out = hierarchy.flatten(out, levels=levels, slices=slices,
                            index_col=analysis.get("index_column"), label_col=analysis.get("label_column"))
    out = clean.standardize_labels(out)
    out = numbers.parse_indian_numbers(out)
    out = reshape.melt_period_columns(out, hints=analysis.get("date_columns"), guard_metrics=True)
    if "period" in out.columns:
        out = periods.split_period(out, "period")
    if as_of is not None:
        out = add_standard_columns(out, as_of, analysis.get("data_period"))
    out = clean.clean_data(out, footer=False)
    return periods.add_month_numeric(out)
