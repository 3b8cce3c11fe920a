"""Load queries through real tables (L1-L3, L6-L12, L15, T7, T8): each loads batches cut
from orders by date into a fresh database under the checkpoint folder and returns what is
read back from its tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from sheaf.plans import load as L
from sheaf.plans.queries_load import REVISED_SQL, _split_orders
from sheaf.plans.registry import register
from sheaf.session import ensure_checkpoint_dir, table
from sheaf.sources.store import TableStore

T0, T1, T2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1)
#: Beyond what a double holds exactly.
BIG = 9007199254740992


def _new_store(spark) -> TableStore:
    name = f"sheaf_{uuid.uuid4().hex}"
    return TableStore(spark, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")


def _loaded(spark, sf_dir) -> TableStore:
    """A one-time load and two increments: the first adds a column and revised prices, the
    second comes untyped (keys and customers as text, customers beyond 2^53)."""
    store = _new_store(spark)
    base, first = _split_orders(spark, sf_dir)
    second = (table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= "1999-06-01")
              .withColumn("o_custkey", (F.col("o_custkey") + F.lit(BIG)).cast("string"))
              .withColumn("o_orderkey", F.col("o_orderkey").cast("string")))
    L.one_time_load(store, "orders_hist", base, key_columns=["o_orderkey"], now=T0)
    L.incremental_load(store, "orders_hist", first, batch_id=1, now=T1)
    L.incremental_load(store, "orders_hist", second, batch_id=2, now=T2)
    return store


@register("l9_incremental_loads", f"""
SELECT o_orderkey, CASE WHEN o_orderdate >= '1999-06-01' THEN o_custkey + {BIG} ELSE o_custkey END AS o_custkey, o_orderstatus,
       CASE WHEN o_orderdate >= '1998-07-01' AND o_orderdate < '1999-06-01' THEN {REVISED_SQL} ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority,
       CASE WHEN o_orderdate >= '1998-07-01' AND o_orderdate < '1999-06-01' THEN 'revised' ELSE '' END AS o_note,
       CASE WHEN o_orderdate >= '1999-06-01' THEN 2 WHEN o_orderdate >= '1998-07-01' THEN 1 ELSE 0 END AS batch
FROM orders""")
def q_loads(spark, sf_dir):
    """The table after a one-time load and two increments in a row. A
    column that the second increment lacks is overwritten with NULL, as the source does."""
    rows = _loaded(spark, sf_dir).read("orders_hist")
    batch = F.when(F.col("ingested_at") == F.lit(T2), 2).when(F.col("ingested_at") == F.lit(T1), 1).otherwise(0)
    return rows.withColumn("o_note", F.coalesce("o_note", F.lit(""))).withColumn("batch", batch).drop("ingested_at")


@register("l9_l12_audit", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate < '1999-01-01') AS base,
                  count(*) FILTER (WHERE o_orderdate >= '1999-01-01') AS ins,
                  count(*) FILTER (WHERE o_orderdate >= '1998-07-01' AND o_orderdate < '1999-01-01') AS upd,
                  count(*) FILTER (WHERE o_orderdate >= '1999-06-01') AS upd2 FROM orders)
SELECT 'orders_hist' AS table_name, CAST(1 AS BIGINT) AS batch_id, base AS rows_before, ins AS rows_inserted, upd AS rows_updated,
       n AS rows_after, 'o_note' AS columns_added, 'o_orderkey' AS keys, n AS rows_count, 'o_orderkey' AS catalog_keys FROM n
UNION ALL SELECT 'orders_hist', 2, n, 0, upd2, n, '', 'o_orderkey', n, 'o_orderkey' FROM n""")
def q_audit(spark, sf_dir):
    """The audit rows of both increments with the operational row count and the
    key columns of the catalog."""
    store = _loaded(spark, sf_dir)
    keys = store.key_columns().groupBy("table_name").agg(F.array_join(F.collect_list("column_name"), ",").alias("catalog_keys"))
    return (store.read("load_audit").join(store.read("operational_metadata").select("table_name", "rows_count"), "table_name")
            .join(keys, "table_name")
            .select("table_name", "batch_id", "rows_before", "rows_inserted", "rows_updated", "rows_after",
                    F.array_join("columns_added", ",").alias("columns_added"), F.array_join("keys", ",").alias("keys"),
                    "rows_count", "catalog_keys"))


@register("t7_t8_widening", """
SELECT o_orderkey AS k, CASE WHEN o_orderdate >= '1998-07-01' THEN o_orderkey + 3000000000 ELSE o_custkey % 1000 END AS i,
       CASE WHEN o_orderdate >= '1998-07-01' THEN o_orderpriority ELSE o_orderstatus END AS s,
       'bigint' AS type_i, 'text' AS type_s FROM orders""")
def q_widening(spark, sf_dir):
    """T7 + T8: an integer and a VARCHAR(6) column meet longer values (as text) in the second
    batch; both are widened before the write and nothing is lost."""
    store, o = _new_store(spark), table(spark, sf_dir, "orders")
    store.create_table("w", {"k": "bigint", "i": "integer", "s": "VARCHAR(6)"}, ["k"])
    late = F.col("o_orderdate") >= "1998-07-01"
    first = o.where(~late).select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 1000).cast("int").alias("i"), F.col("o_orderstatus").alias("s"))
    second = o.where(late).select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") + F.lit(3_000_000_000)).cast("string").alias("i"),
                                  F.col("o_orderpriority").alias("s"))
    L.incremental_load(store, "w", first, batch_id=1, now=T0)
    L.incremental_load(store, "w", second, batch_id=2, now=T1)
    types = store.column_types("w")
    return store.read("w").select("k", "i", "s", F.lit(types["i"]).alias("type_i"), F.lit(types["s"]).alias("type_s"))
