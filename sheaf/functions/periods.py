"""Period, date and fiscal-year functions.

Pattern *choice* (P1, P7, P8) is data-dependent: it is decided by one bounded
aggregate (at most 20 sample values, or one row of votes), returned as a plain
value, and then applied as a lazy Column plan. Callers (streams, tests) can pass
the decision in instead of computing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sheaf.functions.dates import parse_formats

# ---- fixed values ------------------------------------------------------------
MONTHS_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Month names (full and abbreviated, lower case) -> month number.
MONTH_MAP = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3,
    "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
_MON_ALT = (r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|"
            r"jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
FY_RE = r"(?i)^\s*(?:FY\s*)?(\d{4})\s*[–\-/]\s*(\d{2,4})\s*$"
MON_YEAR_RE = rf"(?i)^\s*({_MON_ALT})[\s.\-,/]+(\d{{4}})\s*$"
QUARTER_YEAR_RE = r"(?i)^\s*Q([1-4])[\s\-/]+(\d{4})\s*$"
PLAIN_YEAR_RE = r"^\s*(\d{4})\s*$"
DATE_RANGE_RE = (rf"(?i)^\s*({_MON_ALT})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\s*[-–]\s*"
                 rf"({_MON_ALT})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\s*$")
# Order in which the dominant pattern is tested.
PATTERN_ORDER = ["fiscal", "month_year", "quarter", "year", "date_range"]
PATTERN_RE = {"fiscal": FY_RE, "month_year": MON_YEAR_RE, "quarter": QUARTER_YEAR_RE,
              "year": PLAIN_YEAR_RE, "date_range": DATE_RANGE_RE}
# Substrings in a column name that mark it as a period column.
PERIOD_NAME_WORDS = ["year", "month", "quarter", "date", "period", "time", "fiscal"]
# Date formats tried (in order) when a period value is compared as a date.
PERIOD_DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM",
                       "MMM-yyyy", "MMM yyyy", "MMMM yyyy", "MMMM-yyyy", "MMM yy",
                       "MMM-yy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy"]
# ------------------------------------------------------------------------------

def _month_map_col() -> Column:
    return F.create_map(*[x for k, v in MONTH_MAP.items() for x in (F.lit(k), F.lit(v))])


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def month_number(name: Column | str) -> Column:
    """Month name (any case; first three letters decide) -> 1..12, else NULL."""
    return _month_map_col()[F.substring(F.lower(F.trim(_c(name))), 1, 3)]


def month_name_lookup(name: Column | str) -> Column:
    """Exact (trimmed, lower-cased) month-name lookup, like a dictionary map."""
    return _month_map_col()[F.lower(F.trim(_c(name)))]


# ---- P1: dominant pattern ----------------------------------------------------
def choose_period_pattern_py(values: list[str], threshold: float = 0.5) -> str | None:
    """P1 on a bounded sample (<= 20 distinct values): first pattern with >= 50 % hits."""
    import re
    vals = [str(v).strip() for v in values if v is not None][:20]
    if not vals:
        return None
    for name in PATTERN_ORDER:
        pat = PATTERN_RE[name].replace("(?i)", "")
        flags = re.I if PATTERN_RE[name].startswith("(?i)") else 0
        hits = sum(1 for v in vals if re.match(pat, v, flags))
        if hits / len(vals) >= threshold:
            return name
    return None


def period_sample(df: DataFrame, period_col: str = "period", order_col: str | None = "_row",
                  n: int = 20) -> list[str]:
    """First ``n`` distinct trimmed non-null values in row order: one bounded action."""
    v = F.trim(F.col(period_col).cast("string"))
    base = df.select(v.alias("v"), *( [F.col(order_col).alias("o")] if order_col else [] ))
    base = base.where(F.col("v").isNotNull())
    if order_col:
        rows = base.groupBy("v").agg(F.min("o").alias("o")).orderBy("o").limit(n).collect()
    else:
        rows = base.distinct().limit(n).collect()
    return [r["v"] for r in rows]


def _fy_parts(p: Column):
    start = F.regexp_extract(p, FY_RE, 1)
    end_raw = F.regexp_extract(p, FY_RE, 2)
    s = start.try_cast("int")
    e = end_raw.try_cast("int")
    e_full = F.when(F.length(end_raw) == 2, (s / 100).cast("int") * 100 + e).otherwise(e)
    # century wrap: 1999-00 -> 2000, not 1900
    e_full = F.when((F.length(end_raw) == 2) & (e_full < s), e_full + 100).otherwise(e_full)
    ok = p.rlike(FY_RE)
    return ok, s, e_full, start, end_raw


def fiscal_decision_py(values: list[str]) -> bool:
    """P2 vs P3 on the sample: True when every parsed value has end == start + 1."""
    import re
    pat = FY_RE.replace("(?i)", "")
    for v in values:
        m = re.match(pat, str(v).strip(), re.I)
        if not m:
            continue
        s, er = int(m.group(1)), m.group(2)
        e = int(er)
        if len(er) == 2:
            e = (s // 100) * 100 + e
            if e < s:
                e += 100
        if e != s + 1:
            return False
    return True


def fiscal_year_label(p: Column | str) -> Column:
    """``2020-2021`` / ``FY 2020-21`` -> ``2020-21``; unmatched values unchanged."""
    p = F.trim(_c(p).cast("string"))
    ok, s, e, start, end_raw = _fy_parts(p)
    end2 = F.when(F.length(end_raw) == 4, F.substring(end_raw, 3, 2)).otherwise(end_raw)
    return F.when(ok, F.concat(start, F.lit("-"), end2)).otherwise(p)


def year_range(p: Column | str) -> tuple[Column, Column]:
    """from_year, to_year (2-digit end takes the start's century)."""
    p = F.trim(_c(p).cast("string"))
    ok, s, e, _, _ = _fy_parts(p)
    return F.when(ok, s), F.when(ok, e)


def month_year(p: Column | str) -> tuple[Column, Column]:
    """Year, month from ``Jan-2024`` / ``January 2024``."""
    p = F.trim(_c(p).cast("string"))
    ok = p.rlike(MON_YEAR_RE)
    return (F.when(ok, F.regexp_extract(p, MON_YEAR_RE, 2).try_cast("int")),
            F.when(ok, month_number(F.regexp_extract(p, MON_YEAR_RE, 1))))


def quarter_year(p: Column | str) -> tuple[Column, Column]:
    """P5: year, quarter from ``Q1-2024``."""
    p = F.trim(_c(p).cast("string"))
    ok = p.rlike(QUARTER_YEAR_RE)
    return (F.when(ok, F.regexp_extract(p, QUARTER_YEAR_RE, 2).try_cast("int")),
            F.when(ok, F.regexp_extract(p, QUARTER_YEAR_RE, 1).try_cast("int")))


def plain_year(p: Column | str) -> Column:
    """Year from ``2024`` (anything else -> NULL)."""
    return F.trim(_c(p).cast("string")).try_cast("int")


def date_range_parts(p: Column | str):
    """P7 parts: (from_month, from_year, to_month, to_year) of
    ``April 01, 2018 - May 31, 2018``; NULLs when unmatched."""
    p = F.trim(_c(p).cast("string"))
    ok = p.rlike(DATE_RANGE_RE)
    g = lambda i: F.regexp_extract(p, DATE_RANGE_RE, i)
    return (F.when(ok, month_number(g(1))), F.when(ok, g(3).try_cast("int")),
            F.when(ok, month_number(g(4))), F.when(ok, g(6).try_cast("int")))


def date_range_decision(df: DataFrame, period_col: str = "period") -> str:
    """P7 branch over *all* rows (one aggregate): 'single_month', 'fiscal' or 'span'."""
    fm, fy, tm, ty = date_range_parts(period_col)
    valid = fm.isNotNull()
    same = F.coalesce(valid & (fm == tm) & (fy == ty), F.lit(False))
    isfy = F.coalesce(valid & (fm == 4) & (tm == 3) & (ty == fy + 1), F.lit(False))
    r = df.agg(F.bool_and(same).alias("s"), F.bool_and(isfy).alias("f")).first()
    if r["s"]:
        return "single_month"
    if r["f"]:
        return "fiscal"
    return "span"


def split_period(df: DataFrame, period_col: str = "period", pattern: str | None = None,
                 fiscal: bool | None = None, range_kind: str | None = None,
                 sample: list[str] | None = None, order_col: str | None = "_row") -> DataFrame:
    """Replace a period text column by structured columns.

    ``pattern``/``fiscal``/``range_kind`` may be passed in (frozen plan); otherwise
    they are decided from a bounded sample / one aggregate."""
    if period_col not in df.columns:
        return df
    if pattern is None:
        if sample is None:
            sample = period_sample(df, period_col, order_col if order_col in df.columns else None)
        pattern = choose_period_pattern_py(sample)
    if pattern is None:
        return df
    p = F.col(period_col)
    if pattern == "fiscal":
        if fiscal is None:
            fiscal = fiscal_decision_py(sample if sample is not None else
                                        period_sample(df, period_col, order_col if order_col in df.columns else None))
        if fiscal:
            out = df.withColumn("fiscal_year", fiscal_year_label(p))
        else:
            fy, ty = year_range(p)
            out = df.withColumn("from_year", fy).withColumn("to_year", ty)
    elif pattern == "month_year":
        y, m = month_year(p)
        out = df.withColumn("year", y).withColumn("month", m)
    elif pattern == "quarter":
        y, q = quarter_year(p)
        out = df.withColumn("year", y).withColumn("quarter", q)
    elif pattern == "year":
        out = df.withColumn("year", plain_year(p))
    else:
        if range_kind is None:
            range_kind = date_range_decision(df, period_col)
        fm, fy, tm, ty = date_range_parts(p)
        if range_kind == "single_month":
            out = df.withColumn("month", tm).withColumn("year", ty)
        elif range_kind == "fiscal":
            out = df.withColumn("fiscal_year", F.format_string("%d-%02d", fy, ty % 100))
        else:
            out = (df.withColumn("from_month", fm).withColumn("from_year", fy)
                   .withColumn("to_month", tm).withColumn("to_year", ty))
    return out.drop(period_col)


# ---- P8: month_numeric ------------------------------------------------------------
def _lower_map(cols):
    return {c.lower(): c for c in cols}


def add_month_numeric(df: DataFrame) -> DataFrame:
    """Add ``month_numeric`` (1..12) when derivable; all votes in one aggregate."""
    lm = _lower_map(df.columns)
    if "month_numeric" in lm:
        return df
    aggs = []
    if "month" in lm:
        m = F.col(f"`{lm['month']}`")
        num = m.cast("string").try_cast("double")
        mapped = month_name_lookup(m.cast("string"))
        aggs += [F.count(num).alias("num_n"),
                 F.coalesce(F.bool_and(F.when(num.isNotNull(), num.between(1, 12))), F.lit(True)).alias("num_ok"),
                 F.count(mapped).alias("txt_hit"), F.count(m).alias("txt_n")]
    if "period" in lm:
        p = F.col(f"`{lm['period']}`").cast("string")
        aggs += [F.count(parse_period_date(p)).alias("p_date"), F.count(F.lit(1)).alias("p_rows"),
                 F.count(month_name_lookup(F.regexp_extract(F.lower(F.trim(p)), r"^([a-z]+)", 1))).alias("p_lead")]
    if "month_name" in lm and "month" not in lm:
        aggs += [F.count(month_name_lookup(F.col(f"`{lm['month_name']}`").cast("string"))).alias("mn_hit")]
    if not aggs:
        return df
    r = df.agg(*aggs).first().asDict()
    return apply_month_numeric(df, r)


def apply_month_numeric(df: DataFrame, votes: dict) -> DataFrame:
    lm = _lower_map(df.columns)
    if "month" in lm:
        m = F.col(f"`{lm['month']}`")
        if votes["num_n"] > 0 and votes["num_ok"]:
            return df.withColumn("month_numeric", m.cast("string").try_cast("double").cast("int"))
        if votes["txt_hit"] > 0 and votes["txt_hit"] / max(votes["txt_n"], 1) > 0.5:
            return df.withColumn("month_numeric", month_name_lookup(m.cast("string")))
    if "period" in lm:
        p = F.col(f"`{lm['period']}`").cast("string")
        rows = max(votes["p_rows"], 1)
        if votes["p_date"] / rows > 0.5:
            return df.withColumn("month_numeric", F.month(parse_period_date(p)))
        if votes["p_lead"] / rows > 0.5:
            return df.withColumn("month_numeric",
                                 month_name_lookup(F.regexp_extract(F.lower(F.trim(p)), r"^([a-z]+)", 1)))
    if "month_name" in lm and "month" not in lm and votes.get("mn_hit", 0) > 0:
        return df.withColumn("month_numeric",
                             month_name_lookup(F.col(f"`{lm['month_name']}`").cast("string")))
    return df


def parse_period_date(c: Column | str) -> Column:
    """Lenient date parse over a fixed format list (first format that parses wins)."""
    s = F.trim(_c(c).cast("string"))
    return parse_formats(s, PERIOD_DATE_FORMATS).cast("date")


# ---- P9 / P10 --------------------------------------------------------------------
def _first_month_substring(low: Column) -> Column:
    # first of jan..dec (in calendar order) found anywhere in the text
    return F.coalesce(*[F.when(F.instr(low, m.lower()) > 0, F.lit(i + 1))
                        for i, m in enumerate(MONTHS_ABBR)])


def _abbr(m: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTHS_ABBR]), m)


def normalize_mmm_yyyy(c: Column | str) -> Column:
    """``12-2025``, ``2025-12``, ``December 2025`` -> ``Dec 2025``; else unchanged."""
    v = F.trim(_c(c).cast("string"))
    a_m = F.regexp_extract(v, r"^(\d{1,2})-(\d{4})$", 1).try_cast("int")
    a_y = F.regexp_extract(v, r"^(\d{1,2})-(\d{4})$", 2)
    b_y = F.regexp_extract(v, r"^(\d{4})-(\d{1,2})$", 1)
    b_m = F.regexp_extract(v, r"^(\d{4})-(\d{1,2})$", 2).try_cast("int")
    year = F.regexp_extract(v, r"\b(20\d{2})\b", 1)
    mon = _first_month_substring(F.lower(v))
    fmt = lambda m, y: F.when(m.between(1, 12), F.concat(_abbr(m), F.lit(" "), y)).otherwise(v)
    return (F.when(v.isNull() | (v == ""), _c(c))
            .when(v.rlike(r"^\d{1,2}-\d{4}$"), fmt(a_m, a_y))
            .when(v.rlike(r"^\d{4}-\d{1,2}$"), fmt(b_m, b_y))
            .when((year != "") & mon.isNotNull(), F.concat(_abbr(mon), F.lit(" "), year))
            .otherwise(v))


def derive_fy(c: Column | str) -> Column:
    """P10: Indian fiscal year (April-March) label ``FY2024-2025``; needs a 20xx year."""
    v = F.trim(_c(c).cast("string"))
    y = F.regexp_extract(v, r"\b(20\d{2})\b", 1).try_cast("int")
    mon = _first_month_substring(F.lower(v))
    start = F.when(mon.isNull() | (mon >= 4), y).otherwise(y - 1)
    return F.when(y.isNotNull(), F.concat(F.lit("FY"), start.cast("string"), F.lit("-"),
                                          (start + 1).cast("string")))


# ---- P12-P15 ---------------------------------------------------------------------
def compare_period(a: Column | str, b: Column | str) -> Column:
    """struct(gt, method): date order if both parse as dates, else numeric,
    else string order."""
    a, b = _c(a).cast("string"), _c(b).cast("string")
    da, db = parse_period_date(a), parse_period_date(b)
    na, nb = F.trim(a).try_cast("double"), F.trim(b).try_cast("double")
    both_d = da.isNotNull() & db.isNotNull()
    both_n = na.isNotNull() & nb.isNotNull()
    gt = F.when(both_d, da > db).when(both_n, na > nb).otherwise(a > b)
    method = F.when(both_d, F.lit("date")).when(both_n, F.lit("numeric")).otherwise(F.lit("string"))
    return F.struct(gt.alias("gt"), method.alias("method"))


def period_sort_key(c: Column | str) -> Column:
    """Typed sort key for period text: dates first by date, then numbers, then text."""
    s = _c(c).cast("string")
    d, n = parse_period_date(s), F.trim(s).try_cast("double")
    return F.struct(F.when(d.isNotNull(), 0).when(n.isNotNull(), 1).otherwise(2).alias("k"),
                    d.alias("d"), n.alias("n"), s.alias("s"))


STANDARD_COLUMNS = ["refresh_date", "data_period", "ingested_at"]


def detect_period_column_py(columns: list[str]) -> str | None:
    """First column whose lower-cased name contains a period word. Standard
    columns (``refresh_date`` ...) are skipped (they would always match)."""
    for c in columns:
        lc = str(c).lower()
        if lc in STANDARD_COLUMNS:
            continue
        if any(w in lc for w in PERIOD_NAME_WORDS):
            return c
    return None


def period_bounds(df: DataFrame, period_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """(first_value, last_value) ordered on the typed period key; one row, or
    one row per group (a map-side partial aggregate). The key is made once per period."""
    k = period_sort_key(period_col)
    src = df.where(F.col(period_col).isNotNull()).select(*(group_cols or []), period_col).distinct()
    if group_cols:
        return src.groupBy(*group_cols).agg(
            F.min_by(F.col(period_col).cast("string"), k).alias("first_value"),
            F.max_by(F.col(period_col).cast("string"), k).alias("last_value"))
    return src.agg(
        F.min_by(F.col(period_col).cast("string"), k).alias("first_value"),
        F.max_by(F.col(period_col).cast("string"), k).alias("last_value"))


def period_sql(table_name: str, period_col: str) -> tuple[str, str]:
    """min/max period query text (run through ``spark.sql`` on a view)."""
    return (f"SELECT MIN(`{period_col}`) AS min_period FROM `{table_name}`",
            f"SELECT MAX(`{period_col}`) AS max_period FROM `{table_name}`")
