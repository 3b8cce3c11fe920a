"""Hierarchy queries (C6-C10, C12) over an indented statement built from orders:
one sheet per order status; priority sections (``A``, ``B`` ...), year
sub-sections (``I``, ``II`` ...), order rows, and a total after each section."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import hierarchy as H
from sheaf.plans.registry import register
from sheaf.session import table

ROW_SCALE = 10 ** 11


def roman(n: int) -> str:
    out, vals = "", [(10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    for v, s in vals:
        while n >= v:
            out, n = out + s, n - v
    return out


def statement(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p_idx = F.substring("o_orderpriority", 1, 1).cast("int") - 1        # '1-URGENT' -> 0
    y0 = o.agg(F.min(F.year("o_orderdate"))).first()[0]
    yi = F.year("o_orderdate") - F.lit(y0) + 1
    # 50 and 100 are single letters, which name sections: from 40 on years are numbered in decimals
    romans = F.array(*[F.lit(roman(i)) for i in range(1, 40)])
    year_mark = lambda p, n: F.coalesce(F.get(romans, n - 1), F.concat_ws(".", p + 1, n))
    pos = lambda p, y, kind, key: ((p * 10_000 + y) * 4 + kind) * F.lit(ROW_SCALE) + key
    data = o.select(F.col("o_orderstatus").alias("_file"),
                    pos(p_idx, yi, F.lit(2), F.col("o_orderkey")).alias("_row"),
                    F.col("o_orderkey").cast("string").alias("sr"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("particulars"),
                    F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"))
    sect = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    p2 = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    heads0 = sect.select(F.col("o_orderstatus").alias("_file"), pos(p2, F.lit(0), F.lit(0), F.lit(0)).alias("_row"),
                         F.element_at(F.array(*[F.lit(c) for c in "ABEFGH"]), p2 + 1).alias("sr"),
                         F.col("o_orderpriority").alias("particulars"), F.lit(None).cast("string").alias("amount"))
    totals = sect.select(F.col("o_orderstatus").alias("_file"), pos(p2, F.lit(9_999), F.lit(3), F.lit(0)).alias("_row"),
                         F.lit(None).cast("string").alias("sr"),
                         F.concat(F.lit("Total "), F.col("o_orderpriority")).alias("particulars"),
                         F.col("t").cast("string").alias("amount"))
    yrs = o.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y")).distinct()
    p3 = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    heads1 = yrs.select(F.col("o_orderstatus").alias("_file"),
                        pos(p3, F.col("y") - F.lit(y0) + 1, F.lit(1), F.lit(0)).alias("_row"),
                        year_mark(p3, F.col("y") - F.lit(y0) + 1).alias("sr"),
                        F.concat(F.lit("Year "), F.col("y").cast("string")).alias("particulars"),
                        F.lit(None).cast("string").alias("amount"))
    return data.unionByName(heads0).unionByName(heads1).unionByName(totals)


@register("c6_c10_flatten_hierarchy", """
SELECT o_orderstatus AS _file, 'Order ' || CAST(o_orderkey AS VARCHAR) AS particulars,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       o_orderpriority AS level_0, 'Year ' || CAST(year(o_orderdate) AS VARCHAR) AS level_1
FROM orders""")
def q_flatten(spark, sf_dir):
    """C7 (index/label columns found by vote), C6 roles, C8 hierarchy (carried
    over range slices), C9 data rows, C10 index dropped; amounts parsed as numbers."""
    st = statement(spark, sf_dir)
    idx, label = H.structural_columns(st)
    assert (idx, label) == ("sr", "particulars"), (idx, label)
    flat = H.flatten(st, levels=2, index_col=idx, label_col=label)
    return flat.select("_file", "particulars", F.col("amount").try_cast("double").alias("amount"),
                       "level_0", "level_1")


@register("c6_c12_roles_category", """
WITH d AS (SELECT o_orderstatus AS _file, 'data' AS role, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT o_orderstatus AS _file, 'group_header' AS role,
             count(DISTINCT o_orderpriority) + count(DISTINCT (o_orderpriority, year(o_orderdate))) AS n
      FROM orders GROUP BY 1),
s AS (SELECT o_orderstatus AS _file, 'subtotal' AS role, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
SELECT _file, role, CAST(n AS BIGINT) AS n, 2 AS category FROM (SELECT * FROM d UNION ALL SELECT * FROM g UNION ALL SELECT * FROM s)""")
def q_roles(spark, sf_dir):
    """C6 role counts per sheet and the C12 category (2: mixed rows)."""
    st = statement(spark, sf_dir)
    roles = H.classify_rows(st, "sr", "particulars")
    cat = H.table_category(roles)
    cnt = roles.groupBy("_file", F.col("_role").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return cnt.join(cat.select("_file", "category"), "_file")
