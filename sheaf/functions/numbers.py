"""Number parsing and coercion.

Column votes (is this column mostly numbers?) are one aggregate over all
candidate columns at once, never one job per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sheaf.functions.dates import parse_formats, try_number

# ---- fixed values ------------------------------------------------------------
# Cells that mean "no value" in a numeric column.
NUMERIC_PLACEHOLDERS = ["", "-", "--", "—", "–", "na", "n/a", "nan", "null", "none"]
# Dash-like cells treated as missing by the Indian-number parser.
DASH_TOKENS = ["", "-", "—", "–"]
# Lakh/crore grouping (1,23,45,678.90) or a plain decimal.
INDIAN_NUMBER_RE = r"^\d{1,2}(,\d{2})*(,\d{3})?(\.\d+)?$|^\d+(\.\d+)?$"
PLAIN_NUMBER_RE = r"^-?\d+\.?\d*$"
# ------------------------------------------------------------------------------


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def indian_number_vote(c: Column | str) -> tuple[Column, Column]:
    """(hits, non-blank count) for the N1 >= 50 % vote of one column."""
    s = F.trim(_c(c).cast("string"))
    nb = F.when(s != "", s)
    hit = nb.isNotNull() & (F.regexp_replace(nb, ",", "").rlike(PLAIN_NUMBER_RE) | nb.rlike(INDIAN_NUMBER_RE))
    return F.count(F.when(hit, 1)), F.count(nb)


def parse_indian_number(c: Column | str) -> Column:
    """N1 conversion: dash/blank -> NULL, commas removed, bad -> NULL."""
    s = F.trim(_c(c).cast("string"))
    return F.when(s.isin(DASH_TOKENS), F.lit(None).cast("double")).otherwise(
        try_number(F.regexp_replace(s, ",", "")))


def parse_indian_numbers(df: DataFrame, columns: list[str] | None = None,
                         decisions: dict | None = None) -> DataFrame:
    """N1 over a DataFrame: every string column with >= 50 % number-like
    non-blank cells becomes DOUBLE. ``decisions`` {col: bool} skips the vote."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    if decisions is None:
        aggs = []
        for i, c in enumerate(cols):
            h, n = indian_number_vote(F.col(f"`{c}`"))
            aggs += [h.alias(f"h{i}"), n.alias(f"n{i}")]
        r = df.agg(*aggs).first()
        decisions = {c: (r[f"n{i}"] > 0 and r[f"h{i}"] / r[f"n{i}"] >= 0.5) for i, c in enumerate(cols)}
    return df.select(*[parse_indian_number(F.col(f"`{c}`")).alias(c) if decisions.get(c) else F.col(f"`{c}`")
                       for c in df.columns])


def coerce_numeric(c: Column | str, target: str = "double") -> Column:
    """Write-time numeric coercion. Control characters -> space; ``, % $ ₹``
    removed; placeholder tokens -> NULL; unparseable and +-inf -> NULL.
    ``target`` 'double' (source behaviour) or an exact type ('bigint', 'decimal(38,10)')."""
    s = F.trim(_c(c).cast("string"))
    s = F.regexp_replace(s, r"[\r\n\t]+", " ")
    s = F.regexp_replace(s, r"[,%$]", "")
    s = F.regexp_replace(s, "₹", "")
    s = F.when(F.lower(s).isin(NUMERIC_PLACEHOLDERS), F.lit(None)).otherwise(s)
    d = try_number(s)
    d = F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)
    if target == "double":
        return d
    return F.when(d.isNotNull(), F.trim(s).try_cast(target))


# Day-first and month-first format lists for write-time date coercion.
DAYFIRST_FORMATS = ["dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy",
                    "dd.MM.yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                    "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
MONTHFIRST_FORMATS = ["MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "MM/dd/yyyy", "MM-dd-yyyy",
                      "MM.dd.yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                      "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def parse_timestamp(c: Column | str, dayfirst: bool) -> Column:
    s = F.trim(_c(c).cast("string"))
    fmts = DAYFIRST_FORMATS if dayfirst else MONTHFIRST_FORMATS
    return parse_formats(s, fmts)


def temporal_decision(df: DataFrame, columns: list[str], order_col: str | None = "_row") -> dict:
    """N3 vote, one aggregate for all columns: day-first unless the first value is
    ISO; when under half parse, the other order is kept if it parses more."""
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        first = (F.min_by(col.cast("string"), F.col(order_col)) if order_col and order_col in df.columns
                 else F.first(col.cast("string"), ignorenulls=True))
        aggs += [first.alias(f"f{i}"), F.count(col).alias(f"n{i}"),
                 F.count(parse_timestamp(col, True)).alias(f"d{i}"),
                 F.count(parse_timestamp(col, False)).alias(f"m{i}")]
    r = df.agg(*aggs).first()
    out = {}
    import re
    for i, c in enumerate(columns):
        first = r[f"f{i}"] or ""
        dayfirst = not re.match(r"^\d{4}-\d{2}-\d{2}", first)
        good = r[f"d{i}"] if dayfirst else r[f"m{i}"]
        other = r[f"m{i}"] if dayfirst else r[f"d{i}"]
        if r[f"n{i}"] and good < max(1, r[f"n{i}"] // 2) and other > good:
            dayfirst = not dayfirst
        out[c] = dayfirst
    return out


def format_temporal(c: Column | str, kind: str, dayfirst: bool) -> Column:
    """N3 output text: date -> ``yyyy-MM-dd``; timestamp at midnight -> date text,
    else ``yyyy-MM-dd HH:mm:ss``; unparseable -> NULL."""
    ts = parse_timestamp(c, dayfirst)
    if kind == "date":
        return F.date_format(ts, "yyyy-MM-dd")
    midnight = F.date_format(ts, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    return F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def coerce_temporal(df: DataFrame, column_kinds: dict[str, str], order_col: str | None = "_row",
                    decisions: dict | None = None) -> DataFrame:
    """N3 over a DataFrame: ``column_kinds`` {col: 'date'|'timestamp'}."""
    cols = [c for c in column_kinds if c in df.columns]
    if not cols:
        return df
    decisions = decisions or temporal_decision(df, cols, order_col)
    return df.select(*[format_temporal(F.col(f"`{c}`"), column_kinds[c], decisions[c]).alias(c)
                       if c in column_kinds else F.col(f"`{c}`") for c in df.columns])


def null_safe(c: Column | str) -> Column:
    """NaN -> NULL for floating columns (SQL NULL is the only missing marker)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def format_indian(c: Column | str, decimals: int = 2) -> Column:
    """Render a number with lakh/crore grouping: 12345678.9 -> ``1,23,45,678.90``
    (used to build dirty-number fixtures from real tables)."""
    x = _c(c).cast("decimal(38,10)")
    txt = F.format_number(F.abs(x), decimals)           # 12,345,678.90
    plain = F.regexp_replace(txt, ",", "")
    intpart = F.regexp_extract(plain, r"^(\d+)", 1)
    frac = F.regexp_extract(plain, r"(\.\d+)$", 1)
    last3 = F.substring(intpart, -3, 3)
    # group the head in pairs from the right: reverse, split every 2, reverse back
    head = F.when(F.length(intpart) > 3, F.substring(intpart, F.lit(1), F.length(intpart) - 3))
    rev = F.reverse(head)
    pairs = F.regexp_replace(rev, r"(\d{2})(?=\d)", "$1,")
    grouped = F.when(head.isNull(), last3).otherwise(F.concat(F.reverse(pairs), F.lit(","), last3))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNotNull(), F.concat(sign, grouped, frac))
