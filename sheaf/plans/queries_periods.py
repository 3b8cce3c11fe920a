"""Reshape + period queries (W1-W3, P1-P10, H4 on the result, P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import periods
from sheaf.operators import clean, reshape
from sheaf.plans import preprocess, reports
from sheaf.plans.registry import FY_START_SQL, OVAL_SQL, REV_SQL, register
from sheaf.session import table


def _long(wide, hints=None):
    """Shared tail: melt period columns (with split), drop the empty cells that a
    pivot adds, C2-C4, H4 names."""
    long = reshape.melt_period_columns(wide, hints=hints)
    long = long.where(F.col("value").isNotNull()).drop("_col")
    long = clean.trim_and_nullify(long)
    long = clean.drop_sparse_rows(long)
    return long.withColumn("value", F.col("value").cast("double"))


def flagship(spark, sf_dir):
    """Monthly revenue report (wide, one column per ``Mon-YYYY``) -> clean long table
    with year / month / month_numeric."""
    li = table(spark, sf_dir, "lineitem")
    wide = reports.monthly_revenue_report(li)
    long = preprocess.monthly_long(wide, "l_returnflag")
    return long.select("l_returnflag", "year", "month", F.col("month_numeric").cast("int").alias("month_numeric"),
                       F.col("value").cast("double").alias("value"))


register("w1_monthly_long", f"""
SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
       CAST(month(l_shipdate) AS INTEGER) AS month_numeric, CAST(SUM({REV_SQL}) AS DOUBLE) AS value
FROM lineitem GROUP BY ALL""")(flagship)


@register("p2_fiscal_year_long", f"""
SELECT o_orderstatus, printf('%d-%02d', {FY_START_SQL}, ({FY_START_SQL} + 1) % 100) AS fiscal_year,
       CAST(SUM({OVAL_SQL}) AS DOUBLE) AS value
FROM orders GROUP BY ALL""")
def q_fiscal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _long(reports.fiscal_order_report(o)).select("o_orderstatus", "fiscal_year", "value")


@register("p5_quarter_long", f"""
SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       CAST(SUM({OVAL_SQL}) AS DOUBLE) AS value
FROM orders GROUP BY ALL""")
def q_quarter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _long(reports.quarterly_order_report(o)).select("o_orderpriority", "year", "quarter", "value")


@register("p6_year_long", f"""
SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(SUM({OVAL_SQL}) AS DOUBLE) AS value
FROM orders GROUP BY ALL""")
def q_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _long(reports.yearly_order_report(o)).select("o_orderstatus", "year", "value")


@register("p3_year_range_long", f"""
SELECT o_orderstatus, CAST(year(o_orderdate) - year(o_orderdate) % 3 AS INTEGER) AS from_year,
       CAST(year(o_orderdate) - year(o_orderdate) % 3 + 2 AS INTEGER) AS to_year,
       CAST(SUM({OVAL_SQL}) AS DOUBLE) AS value
FROM orders GROUP BY ALL""")
def q_year_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _long(reports.triennial_order_report(o)).select("o_orderstatus", "from_year", "to_year", "value")


@register("p7_month_range_long", f"""
SELECT l_linestatus, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year,
       CAST(SUM({REV_SQL}) AS DOUBLE) AS value
FROM lineitem GROUP BY ALL""")
def q_month_range(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return _long(reports.monthly_range_report(li)).select("l_linestatus", "month", "year", "value")


@register("p7_fiscal_range_long", f"""
SELECT o_orderpriority, printf('%d-%02d', {FY_START_SQL}, ({FY_START_SQL} + 1) % 100) AS fiscal_year,
       CAST(SUM({OVAL_SQL}) AS DOUBLE) AS value
FROM orders GROUP BY ALL""")
def q_fiscal_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _long(reports.fiscal_range_report(o)).select("o_orderpriority", "fiscal_year", "value")


_MON = "CASE month(ts) " + " ".join(
    f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(periods.MONTHS_ABBR)) + " END"
_EV_FY = "(year(ts) - CASE WHEN month(ts) < 4 THEN 1 ELSE 0 END)"


@register("p9_p10_period_labels", f"""
SELECT event_id, {_MON} || ' ' || CAST(year(ts) AS VARCHAR) AS data_period,
       'FY' || CAST({_EV_FY} AS VARCHAR) || '-' || CAST({_EV_FY} + 1 AS VARCHAR) AS fy
FROM events""")
def q_labels(spark, sf_dir):
    """P9 + P10 over event dates written three ways (``MM-YYYY``, ``YYYY-M``,
    ``Month YYYY``): all normalise to ``Mmm YYYY``; the April-March fiscal year
    is derived from that label (P10 reads month *names*, so it follows P9)."""
    ev = table(spark, sf_dir, "events")
    k = F.pmod(F.col("event_id"), F.lit(3))
    text = (F.when(k == 0, F.date_format("ts", "MM-yyyy"))
            .when(k == 1, F.date_format("ts", "yyyy-M"))
            .otherwise(F.date_format("ts", "MMMM yyyy")))
    dp = periods.normalize_mmm_yyyy(text)
    return ev.select("event_id", dp.alias("data_period"), periods.derive_fy(dp).alias("fy"))


@register("p8_month_numeric_events", """
SELECT event_type, CAST(month(ts) AS INTEGER) AS month_numeric, COUNT(*) AS n
FROM events GROUP BY ALL""")
def q_month_numeric(spark, sf_dir):
    """P8 from a text ``month`` column (``January`` ...) over every event."""
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_type", F.date_format("ts", "MMMM").alias("month"))
    df = periods.add_month_numeric(df)
    return df.groupBy("event_type", F.col("month_numeric").cast("int").alias("month_numeric")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("p14_period_bounds", """
SELECT l_returnflag, strftime(min(l_shipdate), '%Y-%m-%d') AS first_value,
       strftime(max(l_shipdate), '%Y-%m-%d') AS last_value
FROM lineitem GROUP BY 1""")
def q_bounds(spark, sf_dir):
    """First / last period per table (return flag), ordered on the typed
    period key of ``yyyy-MM-dd`` text, not on the raw string."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("period"))
    return periods.period_bounds(df, "period", ["l_returnflag"])
