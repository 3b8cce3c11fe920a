"""Workbook-layout queries (X1-X17, S5) over a statistical workbook rendered as
cells from orders: one sheet per order status, a title and unit line, then two
stacked sub-tables ("Constant Prices": order value, "Current Prices": order
count), each with a header row, a column-number row and one row per month, then
a source footnote. The layout walk must find both sub-tables, their labels and
headers; the stacked result is compared with SQL over orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import sheets as X
from sheaf.plans.registry import register
from sheaf.session import cut_lineage, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def order_workbook(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.agg(F.min("o_orderdate").alias("a")).first()
    y0, m0 = r["a"].year, r["a"].month
    midx = (F.year("o_orderdate") - y0) * 12 + F.month("o_orderdate") - m0
    pidx = F.substring("o_orderpriority", 1, 1).cast("int")          # 1..5 -> column 2..6
    cell = lambda f, row, col, val, kind: f.select(
        F.lit("orders.xlsx").alias("_file"), F.col("o_orderstatus").alias("sheet"), row.cast("int").alias("row"),
        col.cast("int").alias("col"), val.cast("string").alias("value"), F.lit(kind).alias("kind"))
    # each sheet lists the months of its own span: rows start right under the header
    span = o.groupBy("o_orderstatus").agg(F.min(midx).alias("lo"), F.max(midx).alias("hi")) \
        .withColumn("s1", F.lit(7)).withColumn("s2", F.lit(11) + F.col("hi") - F.col("lo") + 1)
    parts = [cell(span, F.lit(1), F.lit(1), F.lit("Order value and count by priority"), "s"),
             cell(span, F.lit(2), F.lit(1), F.lit("(₹ Crores)"), "s")]
    for s0, banner in (("s1", "Constant Prices"), ("s2", "Current Prices")):
        parts.append(cell(span, F.col(s0) - 3, F.lit(1), F.lit(banner), "s"))
        parts.append(cell(span, F.col(s0) - 2, F.lit(1), F.lit("Month"), "s"))
        for i, p in enumerate(PRIORITIES):
            parts.append(cell(span, F.col(s0) - 2, F.lit(i + 2), F.lit(p), "s"))
        for i in range(6):
            parts.append(cell(span, F.col(s0) - 1, F.lit(i + 1), F.lit(i + 1), "n"))
    months = span.select("o_orderstatus", "lo", "s1", "s2", F.explode(F.sequence("lo", "hi")).alias("mi"))
    label = F.date_format(F.add_months(F.make_date(F.lit(y0), F.lit(m0), F.lit(1)), F.col("mi")), "MMM-yyyy")
    for s0 in ("s1", "s2"):
        parts.append(cell(months, F.col(s0) + F.col("mi") - F.col("lo"), F.lit(1), label, "s"))
    agg = (o.groupBy("o_orderstatus", midx.alias("mi"), pidx.alias("pi"))
           .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n"))
           .join(span, "o_orderstatus"))
    parts.append(cell(agg, F.col("s1") + F.col("mi") - F.col("lo"), F.col("pi") + 1, F.col("v"), "n"))
    parts.append(cell(agg, F.col("s2") + F.col("mi") - F.col("lo"), F.col("pi") + 1, F.col("n"), "n"))
    parts.append(cell(span, F.col("s2") + F.col("hi") - F.col("lo") + 2, F.lit(1),
                      F.lit("Source: order ledger, compiled monthly"), "s"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("x_stacked_subtables", """
SELECT o_orderstatus AS sheet, 'Constant Prices' AS price_type, strftime(o_orderdate, '%b-%Y') AS month,
       o_orderpriority AS priority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders GROUP BY ALL
UNION ALL
SELECT o_orderstatus, 'Current Prices', strftime(o_orderdate, '%b-%Y'), o_orderpriority, CAST(count(*) AS DOUBLE)
FROM orders GROUP BY ALL""")
def q_stacked(spark, sf_dir):
    """X2-X11 layout walk, X14 mergeable, S5 range read, X15 stacked concat with
    the price label; priority columns melted to long."""
    cells = cut_lineage(order_workbook(spark, sf_dir))      # read by the walk and by the range read
    subs = cut_lineage(X.analyze_sheets(cells))              # small; used by four steps
    if not subs.join(X.mergeable(subs), "_file").first()["mergeable"]:
        raise AssertionError("stacked sub-tables should be mergeable")
    names = X.header_names(subs).where(F.col("sub_ord") == 1).first()["names"]
    st = X.stacked_table(cells, subs, names)
    long = st.select("sheet", F.col("price_type"), F.col("Month").alias("month"),
                     F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(f"`{p}`").alias("v"))
                                         for p in PRIORITIES])).alias("x"))
    return long.where(F.col("x.v").isNotNull()).select(
        "sheet", "price_type", "month", "x.priority", F.col("x.v").cast("double").alias("value"))


@register("x_subtable_layout", """
WITH m AS (SELECT o_orderstatus AS sheet, (year(o_orderdate) - 1900) * 12 + month(o_orderdate) AS mi FROM orders),
s AS (SELECT sheet, max(mi) - min(mi) + 1 AS n FROM m GROUP BY 1)
SELECT sheet, 1 AS sub_ord, 'Constant Prices' AS label, 6 AS col_number_row, 7 AS data_start_row,
       CAST(6 + n AS INTEGER) AS data_end_row, 1 AS min_col, 6 AS max_col,
       'Order value and count by priority' AS title, '₹ Crores' AS sheet_unit FROM s
UNION ALL
SELECT sheet, 2, 'Current Prices', CAST(10 + n AS INTEGER), CAST(11 + n AS INTEGER), CAST(10 + 2 * n AS INTEGER), 1, 6,
       'Order value and count by priority', '₹ Crores' FROM s""")
def q_layout(spark, sf_dir):
    """Sub-table records found by the per-sheet layout walk."""
    subs = X.analyze_sheets(order_workbook(spark, sf_dir))
    return subs.select("sheet", "sub_ord", "label", "col_number_row", "data_start_row", "data_end_row",
                       "min_col", "max_col", "title", "sheet_unit")


_LONG_NOTE = "Figures of the last month are provisional and may be revised without notice"


def mixed_books(spark, sf_dir):
    """Cells of many books whose layouts differ. Of each five, three have a sheet with two
    stacked sub-tables of other columns (orders; orders counted by priority), and two have
    a sheet of two columns with footers below (customer, order value)."""
    o = table(spark, sf_dir, "orders")
    n = 200 * (1 + o.count() // 1_000_000)
    o = o.select((F.col("o_custkey") % n).alias("b"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
                 F.col("o_totalprice").cast("decimal(18,2)").alias("p"), F.col("o_orderpriority").alias("q"))
    two = F.col("b") % 5 < 3
    cell = lambda f, row, col, val, kind: f.select(
        F.concat(F.lit("book"), F.col("b").cast("string")).alias("_file"), F.lit("Sheet").alias("sheet"), row.cast("int").alias("row"),
        F.lit(col).alias("col"), val.cast("string").alias("value"), F.lit(kind).alias("kind"))
    orders = o.where(two).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("k")))
    size = orders.groupBy("b").agg(F.count("*").alias("n"))
    by = o.where(two).groupBy("b", "q").agg(F.count("*").alias("m"), F.sum("p").alias("p")).withColumn(
        "r", F.row_number().over(Window.partitionBy("b").orderBy("q"))).join(size, "b")
    value = o.where(~two).groupBy("b", "c").agg(F.sum("p").alias("p")).withColumn(
        "r", F.row_number().over(Window.partitionBy("b").orderBy("c")))
    foot = value.groupBy("b").agg(F.max("r").alias("n"))
    parts = [cell(size, F.lit(1), k + 1, F.lit(x), "s") for k, x in enumerate(["Order", "Price", "Customer", "Class"])]
    parts += [cell(orders, F.col("r") + 1, k + 1, F.col(x), kind) for k, (x, kind) in enumerate([("k", "n"), ("p", "n"), ("c", "n"), ("q", "s")])]
    parts += [cell(size, F.col("n") + 3, k + 1, F.lit(x), "s") for k, x in enumerate(["Priority", "How many", "Worth"])]
    parts += [cell(by, F.col("n") + 3 + F.col("r"), k + 1, F.col(x), kind) for k, (x, kind) in enumerate([("q", "s"), ("m", "n"), ("p", "n")])]
    parts += [cell(foot, F.lit(1), k + 1, F.lit(x), "s") for k, x in enumerate(["Buyer", "Worth"])]
    parts += [cell(value, F.col("r") + 1, k + 1, F.col(x), "n") for k, x in enumerate(["c", "p"])]
    parts += [cell(foot, F.col("n") + 2, 1, F.lit(_LONG_NOTE), "s"), cell(foot, F.col("n") + 4, 1, F.lit("Source: order ledger"), "s")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("x17_sub_tables", """
WITH n AS (SELECT 200 * (1 + count(*) // 1000000) AS n FROM orders),
o AS (SELECT o_custkey % n AS b, o_custkey AS c, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderpriority AS q FROM orders, n)
SELECT 'book' || b AS file, 1 AS sub_ord, true AS is_primary, 'Order/Price/Customer/Class' AS names, count(*) AS n_rows,
       sum(k)::DOUBLE AS first_sum, sum(p)::DOUBLE AS worth FROM o WHERE b % 5 < 3 GROUP BY b
UNION ALL
SELECT 'book' || b, 2, false, 'Priority/How many/Worth', count(DISTINCT q), NULL, sum(p)::DOUBLE FROM o WHERE b % 5 < 3 GROUP BY b
UNION ALL
SELECT 'book' || b, 1, true, 'Buyer/Worth', count(DISTINCT c), sum(DISTINCT c)::DOUBLE, sum(p)::DOUBLE FROM o WHERE b % 5 >= 3 GROUP BY b""")
def q_sub_tables(spark, sf_dir):
    """Books whose sub-tables cannot be merged give their first sub-table and
    the others as tables of their own; books without sub-tables are read as one table down
    to the footers. All in one plan; a row per table."""
    cells = cut_lineage(mixed_books(spark, sf_dir))
    tables, rows = X.workbook_tables(cells, cut_lineage(X.analyze_sheets(cells)))
    v = F.col("values")
    worth = F.coalesce(v["Price"], v["Worth"]).cast("decimal(18,2)")
    told = rows.groupBy("table_key").agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(v["Order"], v["Buyer"]).cast("double")).alias("first_sum"),
                                         F.sum(worth).cast("double").alias("worth"))
    return tables.join(told, "table_key").select(F.col("_file").alias("file"), "sub_ord", "is_primary", F.array_join("names", "/").alias("names"),
                                                 "n_rows", "first_sum", "worth")
