"""Wide -> long reshape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import periods
from sheaf.operators import LINEAGE

# ---- fixed values ------------------------------------------------------------
# Words that mark a "date" column name as a metric description (no melt).
METRIC_NAME_RE = (r"crore|INR|for the month|as on|No\. of|Funds Mobilised|Net Assets|"
                  r"Repurchase|Redemption|Inflow|Outflow|Average Net|segregated portfolio")
# Header patterns that mark a column as a period column (regex fallback).
PERIOD_HEADER_PATTERNS = ["date_range", "fiscal", "month_year", "quarter", "year"]
# ------------------------------------------------------------------------------


def _py_re(name):
    pat = periods.PATTERN_RE[name]
    return re.compile(pat.replace("(?i)", ""), re.I if pat.startswith("(?i)") else 0)


def choose_period_columns(columns: list[str], hints: list[str] | None = None) -> list[str]:
    """Hinted names (exact, else substring) plus every header matching a
    period pattern; order = hinted first, then by position."""
    cols = [c for c in columns if c not in LINEAGE]
    chosen: list[str] = []
    for h in hints or []:
        if h in cols:
            chosen.append(h)
        else:
            chosen.extend(c for c in cols if str(h) in str(c))
    seen = set(chosen)
    regs = [_py_re(n) for n in PERIOD_HEADER_PATTERNS]
    for c in cols:
        if c not in seen and any(r.match(str(c).strip()) for r in regs):
            chosen.append(c)
            seen.add(c)
    return chosen


def _common_value_type(df: DataFrame, cols: list[str]) -> T.DataType:
    types = {df.schema[c].dataType for c in cols}
    if len(types) == 1:
        return types.pop()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def wide_to_long(df: DataFrame, value_columns: list[str], var_name: str = "period",
                 value_name: str = "value", id_name: str = "id") -> DataFrame:
    """Melt ``value_columns``; every other column is an id. With no id column
    the row position becomes ``id``. ``_col`` records the melted column's position
    so (``_col``, ``_row``) reproduces the long order."""
    if not value_columns:
        return df
    ids = [c for c in df.columns if c not in value_columns]
    if not [c for c in ids if c not in LINEAGE]:
        df = df.withColumn(id_name, F.col("_row") if "_row" in df.columns else F.monotonically_increasing_id())
        ids = ids + [id_name]
    vt = _common_value_type(df, value_columns)
    pos = {c: i for i, c in enumerate(value_columns)}
    cells = F.explode(F.array(*[
        F.struct(F.lit(pos[c]).alias("_col"), F.lit(str(c)).alias(var_name),
                 F.col(f"`{c}`").cast(vt).alias(value_name)) for c in value_columns]))
    out = df.select(*[F.col(f"`{c}`") for c in ids], cells.alias("_cell"))
    return out.select(*[F.col(f"`{c}`") for c in ids], "_cell._col", f"_cell.{var_name}", f"_cell.{value_name}")


def melt_period_columns(df: DataFrame, hints: list[str] | None = None, guard_metrics: bool = False,
                        split: bool = True) -> DataFrame:
    """W2 + W1 (+ P1..P7 split): find period columns, melt them, split ``period``.
    ``guard_metrics`` is the W3 guard (category-2 tables): no melt when a candidate
    name is longer than 50 characters or reads like a metric."""
    cols = choose_period_columns(df.columns, hints)
    if not cols:
        return df
    if guard_metrics and any(len(str(c)) > 50 or re.search(METRIC_NAME_RE, str(c), re.I) for c in cols):
        return df
    long = wide_to_long(df, cols)
    if not split:
        return long
    # P1 sample in melt order = the first 20 melted names (bounded, no job)
    return periods.split_period(long, "period", sample=[str(c).strip() for c in cols[:20]])
