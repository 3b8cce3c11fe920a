"""Wide statistical reports built from the driver tables.

Statistical files arrive wide: one column per period (``Jan-1996``, ``2020-21``,
``Q1-2024`` ...). These builders produce exactly that shape from the fact tables
with a pivot whose column list is derived from a one-row min/max aggregate (no
distinct job), so every reshape operator runs on data that grows with the input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.periods import MONTHS_ABBR


def money(c: Column) -> Column:
    """Exact cents: round in DECIMAL so sums are order independent."""
    return F.round(c.cast("decimal(18,2)"), 2)


def revenue(li: DataFrame) -> Column:
    return F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                   * (F.lit(1) - F.col("l_discount").cast("decimal(18,2)")), 2)


def _month_span(df: DataFrame, ts_col: str) -> tuple[dt.date, dt.date]:
    r = df.agg(F.min(ts_col).alias("a"), F.max(ts_col).alias("b")).first()
    return r["a"].date(), r["b"].date()


def month_labels(start: dt.date, end: dt.date, fmt: str = "{mon}-{year}") -> list[str]:
    out, y, m = [], start.year, start.month
    while (y, m) <= (end.year, end.month):
        out.append(fmt.format(mon=MONTHS_ABBR[m - 1], year=y, m=m))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def wide_pivot(df: DataFrame, row_key: str, label: Column, measure: Column, labels: list[str]) -> DataFrame:
    """One wide row per ``row_key``; one column per label (partial aggregation map-side,
    then a small pivot)."""
    return (df.select(F.col(row_key), label.alias("_label"), measure.alias("_m"))
            .groupBy(row_key).pivot("_label", labels).agg(F.sum("_m")))


def monthly_revenue_report(li: DataFrame) -> DataFrame:
    """lineitem -> ``l_returnflag | Jan-1995 | Feb-1995 | ...`` (revenue per ship month)."""
    a, b = _month_span(li, "l_shipdate")
    labels = month_labels(a, b)
    label = F.date_format("l_shipdate", "MMM-yyyy")
    return wide_pivot(li, "l_returnflag", label, revenue(li), labels)


def fiscal_label(ts: Column) -> Column:
    """April-March fiscal label ``2020-21`` of a timestamp."""
    y = F.year(ts) - F.when(F.month(ts) < 4, 1).otherwise(0)
    return F.format_string("%d-%02d", y, (y + 1) % 100)


def fiscal_order_report(orders: DataFrame) -> DataFrame:
    """orders -> ``o_orderstatus | 1994-95 | 1995-96 | ...`` (order value per fiscal year)."""
    r = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    fy = lambda d: d.year - (1 if d.month < 4 else 0)
    labels = [f"{y}-{(y + 1) % 100:02d}" for y in range(fy(r["a"]), fy(r["b"]) + 1)]
    return wide_pivot(orders, "o_orderstatus", fiscal_label(F.col("o_orderdate")),
                      money(F.col("o_totalprice")), labels)


def quarterly_order_report(orders: DataFrame) -> DataFrame:
    """orders -> ``o_orderpriority | Q1-1995 | Q2-1995 | ...``."""
    r = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    labels = [f"Q{q}-{y}" for y in range(r["a"].year, r["b"].year + 1) for q in range(1, 5)]
    label = F.format_string("Q%d-%d", F.quarter("o_orderdate"), F.year("o_orderdate"))
    return wide_pivot(orders, "o_orderpriority", label, money(F.col("o_totalprice")), labels)


def yearly_order_report(orders: DataFrame) -> DataFrame:
    """orders -> ``o_orderstatus | 1995 | 1996 | ...``."""
    r = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    labels = [str(y) for y in range(r["a"].year, r["b"].year + 1)]
    return wide_pivot(orders, "o_orderstatus", F.year("o_orderdate").cast("string"),
                      money(F.col("o_totalprice")), labels)


def triennial_order_report(orders: DataFrame) -> DataFrame:
    """orders -> ``o_orderstatus | 1995-1997 | 1998-2000 | ...`` (three-year spans,
    so the labels are year ranges, not fiscal years)."""
    r = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    y0 = r["a"].year - (r["a"].year % 3)
    labels = [f"{y}-{y + 2}" for y in range(y0, r["b"].year + 1, 3)]
    start = F.year("o_orderdate") - F.pmod(F.year("o_orderdate"), F.lit(3))
    label = F.format_string("%d-%d", start, start + 2)
    return wide_pivot(orders, "o_orderstatus", label, money(F.col("o_totalprice")), labels)


_FULL_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
                "September", "October", "November", "December"]


def range_label(start: Column, end: Column) -> Column:
    """``April 01, 2018 - May 31, 2018`` style label."""
    return F.concat(F.date_format(start, "MMMM dd, yyyy"), F.lit(" - "), F.date_format(end, "MMMM dd, yyyy"))


def monthly_range_report(li: DataFrame) -> DataFrame:
    """lineitem -> one column per ship month written as a date range
    (``January 01, 1995 - January 31, 1995``)."""
    a, b = _month_span(li, "l_shipdate")
    labels = []
    y, m = a.year, a.month
    while (y, m) <= (b.year, b.month):
        first = dt.date(y, m, 1)
        nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
        last = nxt - dt.timedelta(days=1)
        labels.append(f"{_FULL_MONTHS[m - 1]} {first:%d}, {y} - {_FULL_MONTHS[m - 1]} {last:%d}, {y}")
        y, m = nxt.year, nxt.month
    ms = F.trunc("l_shipdate", "month")
    label = range_label(ms, F.last_day(ms))
    return wide_pivot(li, "l_linestatus", label, revenue(li), labels)


def fiscal_range_report(orders: DataFrame) -> DataFrame:
    """orders -> one column per fiscal year written as ``April 01, 1995 - March 31, 1996``."""
    r = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    fy = lambda d: d.year - (1 if d.month < 4 else 0)
    labels = [f"April 01, {y} - March 31, {y + 1}" for y in range(fy(r["a"]), fy(r["b"]) + 1)]
    y = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 4, 1).otherwise(0)
    start = F.make_date(y, F.lit(4), F.lit(1))
    end = F.make_date(y + 1, F.lit(3), F.lit(31))
    return wide_pivot(orders, "o_orderpriority", range_label(start, end), money(F.col("o_totalprice")), labels)
