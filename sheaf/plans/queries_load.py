"""Load-merge queries (L3-L7, L11): pure merge plans over split driver tables.

Base and delta are cut by *date* (a data attribute): every row of the table takes
part, and the overlap window produces updates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sheaf.operators import upsert as U
from sheaf.plans import load as L
from sheaf.plans.registry import register
from sheaf.session import table

TS = dt.datetime(2026, 1, 1)
TS_SQL = "TIMESTAMP '2026-01-01 00:00:00'"


def _split_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.where(F.col("o_orderdate") < "1999-01-01")
    delta = (o.where(F.col("o_orderdate") >= "1998-07-01")
             .withColumn("o_totalprice", F.round(F.col("o_totalprice").cast("decimal(18,2)")
                                                 * F.lit(1.1).cast("decimal(2,1)"), 2).cast("double"))
             .withColumn("o_note", F.lit("revised")))
    return base, delta


@register("l3_upsert_merge", f"""
WITH base AS (SELECT * FROM orders WHERE o_orderdate < '1999-01-01'),
delta AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                 CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.1 AS DECIMAL(2,1)), 2) AS DOUBLE) AS o_totalprice,
                 o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= '1998-07-01')
SELECT coalesce(d.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_custkey ELSE b.o_custkey END AS o_custkey,
       CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
       CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_orderdate ELSE b.o_orderdate END AS o_orderdate,
       CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority,
       CASE WHEN d.o_orderkey IS NOT NULL THEN {TS_SQL} END AS ingested_at
FROM base b FULL JOIN delta d ON b.o_orderkey = d.o_orderkey""")
def q_upsert(spark, sf_dir):
    """L3 + L5 + L7: key match overwrites every non-key column and stamps
    ``ingested_at``; new keys insert; the extra ``o_note`` column is not in the
    table and is dropped by alignment."""
    base, delta = _split_orders(spark, sf_dir)
    existing = base.withColumn(U.AUDIT_COLUMN, F.lit(None).cast("timestamp"))
    res = U.upsert_merge(existing, delta, ["o_orderkey"], ts=TS, order=None)
    return res.merged


@register("l3_upsert_counts", """
SELECT CAST(count(*) FILTER (WHERE o_orderdate >= '1999-01-01') AS BIGINT) AS inserted,
       CAST(count(*) FILTER (WHERE o_orderdate >= '1998-07-01' AND o_orderdate < '1999-01-01') AS BIGINT) AS updated,
       CAST(count(*) FILTER (WHERE o_orderdate < '1998-07-01') AS BIGINT) AS unchanged,
       CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS null_keys
FROM orders""")
def q_upsert_counts(spark, sf_dir):
    """L3 audit counts (exact, from the presence flags of the same merge)."""
    base, delta = _split_orders(spark, sf_dir)
    return U.upsert_merge(base, delta, ["o_orderkey"], ts=TS, order=None).counts


LI_ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@register("l3_upsert_repeated_keys", f"""
WITH early AS (SELECT * FROM lineitem WHERE l_shipdate < '1998-01-01'),
late AS (SELECT * FROM lineitem WHERE l_shipdate >= '1997-07-01'),
e1 AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {', '.join(c + ' DESC' for c in LI_ORDER.split(', '))}) AS r FROM early) WHERE r = 1),
l1 AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {', '.join(c + ' DESC' for c in LI_ORDER.split(', '))}) AS r FROM late) WHERE r = 1)
SELECT coalesce(l.l_orderkey, e.l_orderkey) AS l_orderkey, coalesce(l.l_linenumber, e.l_linenumber) AS l_linenumber,
       CASE WHEN l.l_orderkey IS NOT NULL THEN l.l_partkey ELSE e.l_partkey END AS l_partkey,
       CASE WHEN l.l_orderkey IS NOT NULL THEN l.l_extendedprice ELSE e.l_extendedprice END AS l_extendedprice,
       CASE WHEN l.l_orderkey IS NOT NULL THEN l.l_shipdate ELSE e.l_shipdate END AS l_shipdate
FROM e1 e FULL JOIN l1 l ON e.l_orderkey = l.l_orderkey AND e.l_linenumber = l.l_linenumber""")
def q_upsert_repeated(spark, sf_dir):
    """L3 with in-batch repeated keys: (l_orderkey, l_linenumber) is not unique,
    so within each batch the last row (by a full content order) wins; the early
    batch is the table, the late batch the increment."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct(*[F.col(c) for c in LI_ORDER.split(", ")])
    keys = ["l_orderkey", "l_linenumber"]
    early = U.dedupe_last(li.where(F.col("l_shipdate") < "1998-01-01"), keys, order)
    late = li.where(F.col("l_shipdate") >= "1997-07-01").withColumn("_o", order)
    res = U.upsert_merge(early, late, keys, order="_o")
    return res.merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")


REVISED_SQL = "CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.1 AS DECIMAL(2,1)), 2) AS DOUBLE)"


@register("l4_insert_ignore", f"""
SELECT * FROM orders WHERE o_orderdate < '1999-01-01'
UNION ALL SELECT * REPLACE ({REVISED_SQL} AS o_totalprice) FROM orders WHERE o_orderdate >= '1999-01-01'""")
def q_insert_ignore(spark, sf_dir):
    """L4: only keys absent from the table are appended, with the increment's revised
    prices; rows that are there already keep their own, also where the increment has them."""
    base, delta = _split_orders(spark, sf_dir)
    _, after = U.insert_ignore(base, delta, ["o_orderkey"], order=None)
    return after


@register("l5_l6_align_evolve", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST(NULL AS VARCHAR) AS o_note
FROM orders WHERE o_orderdate < '1999-01-01'
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, {REVISED_SQL}, o_orderdate, o_orderpriority, 'revised'
FROM orders WHERE o_orderdate >= '1998-07-01'""")
def q_evolve(spark, sf_dir):
    """L6 + L5 + L2 in append mode: the table gains the increment's new column (nullable);
    the price comes as text in the increment, which changes no type: it is read into the
    table's. Both sides are aligned to the evolved schema and appended."""
    base, delta = _split_orders(spark, sf_dir)
    delta = delta.withColumn("O_TotalPrice ", F.col("o_totalprice").cast("string")).drop("o_totalprice")
    ev = U.evolve_schema(base.schema, delta.schema)
    assert ev.columns_added == ["o_note"] and not ev.schema_changes and not ev.warnings
    return U.align(base, ev.schema).unionByName(U.align(delta, ev.schema))


@register("l11_coalesce_merge", """
WITH st AS (SELECT o_orderstatus AS table_name, CAST(count(*) AS BIGINT) AS rows_count,
                   CAST(min(o_orderdate) AS VARCHAR) AS first_available_value FROM orders
            WHERE o_orderdate < '1999-01-01' GROUP BY 1),
nw AS (SELECT o_orderstatus AS table_name, CAST(count(*) AS BIGINT) AS rows_count,
              CAST(max(o_orderdate) AS VARCHAR) AS last_available_value FROM orders
       WHERE o_orderdate >= '1999-01-01' GROUP BY 1)
SELECT coalesce(n.table_name, s.table_name) AS table_name, coalesce(n.rows_count, s.rows_count) AS rows_count,
       s.first_available_value, n.last_available_value
FROM st s FULL JOIN nw n USING (table_name)""")
def q_coalesce(spark, sf_dir):
    """Operational rows (one per status 'table') merged field by field with
    COALESCE(new, old)."""
    o = table(spark, sf_dir, "orders")
    st = (o.where(F.col("o_orderdate") < "1999-01-01").groupBy(F.col("o_orderstatus").alias("table_name"))
          .agg(F.count(F.lit(1)).alias("rows_count"),
               F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("first_available_value"),
               F.lit(None).cast("string").alias("last_available_value")))
    nw = (o.where(F.col("o_orderdate") >= "1999-01-01").groupBy(F.col("o_orderstatus").alias("table_name"))
          .agg(F.count(F.lit(1)).alias("rows_count"),
               F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("last_available_value")))
    return L.coalesce_merge(st, nw, ["table_name"])
