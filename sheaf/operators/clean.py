"""Column and row cleaning (C1-C5, C11), unit columns (H6), duplicate-name
coalescing (H7), rename/drop maps (H10) and redundant-column detection (H11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import names as N
from sheaf.operators import LINEAGE, data_columns

# ---- fixed values ------------------------------------------------------------
# Footer/footnote first-cell pattern (checked on the first non-blank cell).
FOOTER_RE = (r"(?i)^\s*(notes?\s*:|source\s*:|\*|@|#|†|‡|§|\d+\.\s+[A-Z]|"
             r"p\s*[-–:]\s*provisional|re\s*[-–:]\s*revised|be\s*[-–:]\s*budget)")
FOOTER_LONG_TEXT = 60
# Keywords that are qualifiers, not units.
NON_UNIT_KEYWORDS = ["adjusted", "unadjusted", "total", "net", "gross", "actual",
                     "estimated", "provisional", "revised", "final", "preliminary"]
# ------------------------------------------------------------------------------


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _is_str(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _text(df: DataFrame, c: str) -> Column:
    return _q(c) if _is_str(df, c) else _q(c).cast("string")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are all NULL or all blank strings (one aggregate).
    A column mixing NULL and blanks is kept (source behaviour)."""
    cols = data_columns(df)
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(_q(c)).alias(f"n{i}"))
        if _is_str(df, c):
            aggs.append(F.bool_and(F.coalesce(F.trim(_q(c)) == "", F.lit(False))).alias(f"b{i}"))
    r = df.agg(*aggs).first()
    drop = [c for i, c in enumerate(cols)
            if r[f"n{i}"] == 0 or (_is_str(df, c) and r[f"b{i}"])]
    return df.drop(*drop) if drop else df


def trim_and_nullify(df: DataFrame) -> DataFrame:
    """Trim string cells; ``''`` and ``'nan'`` become NULL."""
    out = []
    for c in df.columns:
        if c in LINEAGE or not _is_str(df, c):
            out.append(_q(c))
        else:
            t = F.trim(_q(c))
            out.append(F.when(~t.isin("", "nan"), t).alias(c))
    return df.select(*out)


def non_null_count(df: DataFrame, cols: list[str] | None = None) -> Column:
    cols = cols if cols is not None else data_columns(df)
    return sum((F.when(_q(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))


def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """C3 + C4: drop all-NULL rows; with >= 3 columns keep rows that have at
    least max(int(0.2 * n), 1) non-NULL cells."""
    cols = data_columns(df)
    if not cols:
        return df
    nn = non_null_count(df, cols)
    out = df.where(nn > 0)
    if len(cols) >= 3:
        out = out.where(nn >= max(int(len(cols) * 0.2), 1))
    return out


def footerish(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Row test of C5: blank, footer pattern on the first non-blank cell, or at
    most 2 filled cells whose first text is longer than 60 characters."""
    cols = cols if cols is not None else data_columns(df)
    texts = [F.when(F.trim(_text(df, c)) != "", F.trim(_text(df, c))) for c in cols]
    filled = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in texts), F.lit(0))
    first = F.coalesce(*texts) if texts else F.lit(None)
    return ((filled == 0) | first.rlike(FOOTER_RE)
            | ((filled <= 2) & (F.length(first) > FOOTER_LONG_TEXT)))


def trim_footer(df: DataFrame, file_col: str = "_file", order_col: str = "_row") -> DataFrame:
    """Remove footer rows from the bottom of every file.

    last data row = max(_row) of non-footer rows per file: a map-side partial
    aggregate, then a join of one row per file (broadcast by its measured bytes, or a
    shuffle join that AQE splits when one file dominates)."""
    flag = footerish(df)
    if file_col not in df.columns:
        df = df.withColumn(file_col, F.lit(""))
    last = (df.where(~flag).groupBy(file_col).agg(F.max(order_col).alias("_last_data_row")))
    return (df.join(last, file_col, "inner").where(F.col(order_col) <= F.col("_last_data_row"))
            .drop("_last_data_row"))


def clean_data(df: DataFrame, rename: bool = True, footer: bool = True) -> DataFrame:
    """C1-C5 then H4 names (the category-1 clean step)."""
    out = drop_empty_columns(df)
    out = trim_and_nullify(out)
    out = drop_sparse_rows(out)
    if footer and "_row" in out.columns:
        out = trim_footer(out)
    if rename:
        out = rename_columns(out, dict(zip(data_columns(out), N.clean_names(data_columns(out)))))
    return out


def standardize_labels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C11: trim; strip trailing ``*``, then ``@#†‡§`` markers, then ``(digits)``."""
    cols = cols if cols is not None else [c for c in data_columns(df) if _is_str(df, c)]
    def std(c):
        s = F.trim(_q(c))
        s = F.regexp_replace(s, r"\s*\*+\s*$", "")
        s = F.regexp_replace(s, r"\s*[@#†‡§]+\s*$", "")
        s = F.regexp_replace(s, r"\s*\(\d+\)\s*$", "")
        return s.alias(c)
    return df.select(*[std(c) if c in cols else _q(c) for c in df.columns])


def header_unit(raw: Column | str) -> Column:
    """H6: the last ``(...)`` text of a header that is neither a formula nor a qualifier."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inside = F.transform(F.regexp_extract_all(raw, F.lit(r"\(([^)]+)\)"), 1), lambda u: F.trim(u))
    units = F.filter(inside, lambda u: ~u.rlike(r"^[\d+\-*/().]+$") & ~F.lower(u).isin(*NON_UNIT_KEYWORDS))
    return F.try_element_at(units, F.lit(-1))


def add_unit_columns(df: DataFrame, raw_names: list[str]) -> DataFrame:
    """H6: constant sibling ``<col>_unit`` columns."""
    units = N.over_names(raw_names, lambda a: F.transform(a, header_unit))
    for col, unit in {c: u for c, u in zip(N.clean_names(raw_names), units) if u is not None}.items():
        if col in df.columns and f"{col}_unit" not in df.columns:
            df = df.withColumn(f"{col}_unit", F.lit(unit))
    return df


def coalesce_duplicate_names(df: DataFrame, logical_names: list[str]) -> DataFrame:
    """H7: ``df`` has positional physical columns; ``logical_names`` (same length,
    may repeat) are their names. Repeated names collapse into one column at the
    first position holding the first non-blank value left to right."""
    phys = df.columns
    assert len(phys) == len(logical_names)
    order, groups = [], {}
    for p, n in zip(phys, logical_names):
        if n not in groups:
            groups[n] = []
            order.append(n)
        groups[n].append(p)
    out = []
    for n in order:
        ps = groups[n]
        if len(ps) == 1:
            out.append(_q(ps[0]).alias(n))
            continue
        str_any = any(not _is_str(df, p) for p in ps) and any(_is_str(df, p) for p in ps)
        vals = []
        for p in ps:
            v = _q(p).cast("string") if str_any else _q(p)
            if _is_str(df, p) or str_any:
                v = F.when(F.trim(v.cast("string")) != "", v)
            vals.append(v)
        out.append(F.coalesce(*vals).alias(n))
    return df.select(*out)


def rename_decisions(df: DataFrame, mapping: dict[str, str], drop: list[str] | None = None,
                     protect: bool = False) -> DataFrame:
    """One row per column of ``df``: pos, column, action (``keep``, ``rename``,
    ``drop`` or ``protected``) and the final name (null when dropped)."""
    guarded = {c for c in df.columns if c in LINEAGE or (protect and c.lower() in N.PROTECTED_COLUMNS)}
    gone = {c for c in drop or [] if c not in guarded}
    kept = [c for c in df.columns if c not in gone]
    final = dict(zip(kept, N.unique_name_list([c if c in guarded else mapping.get(c, c) for c in kept])))
    asked = set(drop or []) | set(mapping)
    rows = [(i, c, "drop" if c in gone else "protected" if c in guarded & asked else "rename" if final[c] != c else "keep",
             final.get(c)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, action string, final_name string")


def rename_columns(df: DataFrame, mapping: dict[str, str], drop: list[str] | None = None,
                   protect: bool = False) -> DataFrame:
    """Drop then rename; with ``protect`` the protected names (period and
    standard columns) are neither dropped nor renamed. Collisions are resolved by
    H8 (``_1``, ``_2`` ...)."""
    prot = set(N.PROTECTED_COLUMNS) if protect else set()
    drop = [c for c in (drop or []) if c.lower() not in prot and c in df.columns]
    kept = [c for c in df.columns if c not in drop]
    target = [mapping.get(c, c) if (c not in LINEAGE and c.lower() not in prot) else c for c in kept]
    target = N.unique_name_list(target)
    return df.select(*[_q(c).alias(t) for c, t in zip(kept, target)])


def redundant_columns(df: DataFrame, order_col: str = "_row") -> list[str]:
    """Columns identical to an earlier column in every row.

    Pass 1 (one aggregate): a per-column fingerprint ``bit_xor(xxhash64(row, value))``
    + null count. Pass 2 (one aggregate): confirm candidate pairs with equal
    fingerprints by ``bool_and(a <=> b)``. Returns the later column of each pair."""
    cols = data_columns(df)
    key = F.col(order_col) if order_col in df.columns else F.monotonically_increasing_id()
    if len(cols) < 2:
        return []
    fp = df.agg(*[F.bit_xor(F.xxhash64(key, _q(c).cast("string"))).alias(f"h{i}")
                  for i, c in enumerate(cols)]).first()
    cand = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
            if i < j and fp[f"h{i}"] == fp[f"h{j}"]]
    if not cand:
        return []
    ok = df.agg(*[F.bool_and(_q(a).cast("string").eqNullSafe(_q(b).cast("string"))).alias(f"p{k}")
                  for k, (a, b) in enumerate(cand)]).first()
    out = []
    for k, (a, b) in enumerate(cand):
        if ok[f"p{k}"] and b not in out and a not in out:
            out.append(b)
    return out
