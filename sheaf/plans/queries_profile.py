"""Profile queries (Q1, Q2, Q4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import profile as P
from sheaf.plans.registry import register
from sheaf.session import table

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
          "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("q1_preview", f"""
SELECT * FROM lineitem ORDER BY {', '.join(LI_KEY)} LIMIT 5""")
def q_preview(spark, sf_dir):
    """Q1: the first five rows in a full row order (the limit is the feature)."""
    li = table(spark, sf_dir, "lineitem")
    return P.preview(li.withColumn("_row", F.struct(*LI_KEY))).drop("_row")


#: Every column of the driver tables: (order of the rows, whole-number and text columns, others).
PROFILE_COLUMNS = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"], []),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], []),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ["c_acctbal"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey"], ["s_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], ["p_retailprice"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_orderdate"]),
    "lineitem": (", ".join(LI_KEY), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
                 ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]),
    "events": ("event_id", ["event_id", "user_id", "event_type", "props"], ["ts", "value"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"], []),
    "embeddings": ("vec_id", ["vec_id", "label"], ["embedding"]),
    "pages": ("page_id", ["page_id", "url", "html"], []), "benchmark": ("item_id", ["item_id", "text"], []),
    "labels": ("doc_id", ["doc_id", "quality", "toxic"], []),
    "conversations": ("conv_id, turn", ["conv_id", "turn", "role", "text"], []),
}


def _profile_sql():
    parts = []
    for t, (order, plain, other) in PROFILE_COLUMNS.items():
        for c in plain + other:
            shown = (f"CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS max_length, md5(coalesce((SELECT string_agg(v, '|' ORDER BY k) "
                     f"FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {order}) AS k FROM {t} "
                     f"WHERE {c} IS NOT NULL) WHERE k <= 10), '')) AS samples_md5" if c in plain else
                     "CAST(NULL AS INTEGER) AS max_length, CAST(NULL AS VARCHAR) AS samples_md5")
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) "
                         f"AS null_count, CAST(count(*) AS BIGINT) AS total_count, {shown} FROM {t}")
    body = " UNION ALL ".join(parts)
    return f"SELECT * REPLACE (coalesce(max_length, -1) AS max_length, coalesce(samples_md5, '') AS samples_md5) FROM ({body})"


@register("q2_column_profile", _profile_sql())
def q_profile(spark, sf_dir):
    """Q2 over every column of every table: NULL and total counts, and for whole numbers
    and texts the longest value and the first ten values (other types print differently
    in the two engines)."""
    out = None
    for t, (order, plain, other) in PROFILE_COLUMNS.items():
        df = table(spark, sf_dir, t)
        keys = F.struct(*order.split(", "))
        r = P.column_profile(df.select(keys.alias("_row"), *plain, *other), table_name=t)
        shown = F.col("column_name").isin(*plain)
        r = r.select("table_name", "column_name", F.col("null_count").cast("long"), F.col("total_count").cast("long"),
                     F.when(shown, F.coalesce(F.col("max_length"), F.lit(-1))).otherwise(-1).cast("int").alias("max_length"),
                     F.when(shown, F.md5(F.array_join("samples", "|"))).otherwise("").alias("samples_md5"))
        out = r if out is None else out.unionByName(r)
    return out
