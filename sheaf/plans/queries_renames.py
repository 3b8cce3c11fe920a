"""Rename reconciliation (M3, M1, M5, M6): later releases of the driver tables under other
column names against the catalog's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import renames as R
from sheaf.operators import schema as SC
from sheaf.plans.registry import register
from sheaf.session import cut_lineage, table

#: Columns of the releases, by the table's own; columns that are not listed keep their name.
RELEASED = {
    "customer": {"c_custkey": "customer_key", "c_name": "client_label", "c_acctbal": "account_balance", "c_mktsegment": "segment_of_market"},
    "supplier": {"s_suppkey": "vendor_no", "s_name": "vendor", "s_acctbal": "balance_of_account"},
    "part": {"p_partkey": "article_no", "p_brand": "brand_name", "p_type": "kind_of_article", "p_retailprice": "price_in_retail", "p_size": "dimension"},
    "orders": {"o_orderkey": "order_no", "o_custkey": "customer_no", "o_totalprice": "amount_due", "o_orderdate": "ordered_on", "o_orderpriority": "urgency"},
    "lineitem": {"l_orderkey": "order_no", "l_quantity": "pieces", "l_extendedprice": "worth", "l_shipdate": "sent_on", "l_returnflag": "return_state"},
    "events": {"event_id": "id_of_event", "ts": "happened_at", "event_type": "what", "value": "measure"},
    "documents": {"text": "body", "lang": "language_code", "n_chars": "length"},
    "pages": {"url": "address", "html": "markup"},
    "conversations": {"conv_id": "dialogue", "role": "speaker", "text": "utterance"},
}


def _pairs_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'new_{t}' AS new_id, '{t}' AS table_id, '{old}' AS existing, '{new}' AS new, count(*) AS n_rows FROM {t}"
        for t, names in RELEASED.items() for old, new in names.items())


def releases(spark, sf_dir) -> dict:
    """The driver tables as later releases: columns under other names and in other order,
    and one new column."""
    out = {}
    for t, names in RELEASED.items():
        df = table(spark, sf_dir, t).withColumnsRenamed(names)
        out[f"new_{t}"] = df.select(*reversed(df.columns), F.lit("2026").alias("release"))
    return out


@register("m3_rename_proposals", _pairs_sql())
def q_renames(spark, sf_dir):
    """M3: columns that a table misses are paired with columns that its release has besides,
    by sketches of their values and grams of their names, one to one."""
    tables = {t: table(spark, sf_dir, t) for t in RELEASED}
    new = cut_lineage(R.sketches_of(releases(spark, sf_dir)))
    old = cut_lineage(R.sketches_of(tables))
    pairs = spark.createDataFrame([(f"new_{t}", t) for t in RELEASED], "new_id string, table_id string")
    counts = None
    for t, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_id"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return R.reconcile(pairs, new, old).join(counts, "table_id").select("new_id", "table_id", "existing", "new", "n_rows")


def _increment_sql() -> str:
    """Counts that follow from the mapping: every renamed column is found again, and the
    release has one column more."""
    rows = []
    for t, names in RELEASED.items():
        rows.append(f"SELECT 'new_{t}' AS new_id, '{t}' AS table_id, count(*) AS n_columns, {len(names)} AS n_reconciled "
                    f"FROM information_schema.columns WHERE table_name = '{t}'")
    return ("WITH c AS (" + " UNION ALL ".join(rows) + ") SELECT new_id, table_id, false AS is_compatible, true AS is_additive, '' AS missing, "
            "'release' AS extra, 100.0::DOUBLE AS match_pct, (n_columns - n_reconciled)::INTEGER AS n_matching FROM c")


@register("m6_increment_validation", _increment_sql())
def q_validate(spark, sf_dir):
    """M6 over M1-M5 and M3: each release against the columns that the catalog lists for its
    table; renames are reconciled first, so a release only adds a column."""
    new = cut_lineage(R.sketches_of(releases(spark, sf_dir)))
    tables = {t: table(spark, sf_dir, t) for t in RELEASED}
    pairs = spark.createDataFrame([(f"new_{t}", t) for t in RELEASED], "new_id string, table_id string")
    catalog = spark.createDataFrame([(t, df.columns) for t, df in tables.items()], "table_name string, columns array<string>")
    found = R.reconcile(pairs, new, cut_lineage(R.sketches_of(tables)))
    told = SC.validate_increment(pairs, new.select("set_id", "col"), catalog, reconciled=found)
    return told.select("new_id", "table_id", "is_compatible", "is_additive", F.array_join("missing", ",").alias("missing"),
                       F.array_join("extra", ",").alias("extra"), "match_pct", F.size("matching").alias("n_matching"))
