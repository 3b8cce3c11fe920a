"""Cleaning, number, name and type queries.

Dirty inputs are *rendered* from the real tables (every row, whole tables): the
oracle reads the clean source values, so parser and renderer mistakes show."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import names as N
from sheaf.functions import numbers as NUM
from sheaf.functions import types as TY
from sheaf.operators import clean
from sheaf.plans.registry import register
from sheaf.session import TABLES, table

MONEY = "CAST(ROUND(CAST({c} AS DECIMAL(18,2)), 2) AS DOUBLE)"


@register("n1_indian_numbers", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {MONEY.format(c='o_totalprice')} END AS o_totalprice
FROM orders""")
def q_indian(spark, sf_dir):
    """Order values written with lakh grouping (``1,12,946.26``), ``-`` for pending
    orders -> N1 vote + parse."""
    o = table(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("-")).otherwise(NUM.format_indian("o_totalprice"))
    dirty = o.select("o_orderkey", txt.alias("o_totalprice"))
    return NUM.parse_indian_numbers(dirty, ["o_totalprice"])


@register("n2_numeric_coercion", f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE {MONEY.format(c='c_acctbal')} END AS c_acctbal
FROM customer""")
def q_coerce_numeric(spark, sf_dir):
    """Balances written as ``₹ 1,863.84``, ``1863.84%``, ``$1,863.84``, `` 1863.84\\t``
    and ``n/a`` (by market segment) -> N2 write coercion to DOUBLE."""
    c = table(spark, sf_dir, "customer")
    num = F.format_number(F.col("c_acctbal").cast("decimal(18,2)"), 2)
    plain = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    seg = F.col("c_mktsegment")
    txt = (F.when(seg == "HOUSEHOLD", F.concat(F.lit("₹ "), num))
           .when(seg == "MACHINERY", F.concat(plain, F.lit("%")))
           .when(seg == "FURNITURE", F.concat(F.lit("$"), num))
           .when(seg == "BUILDING", F.lit("n/a"))
           .otherwise(F.concat(F.lit(" "), plain, F.lit("\t"))))
    return c.select("c_custkey", NUM.coerce_numeric(txt).alias("c_acctbal"))


@register("n3_temporal_coercion", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate, '%Y-%m-%d') AS order_ts
FROM orders""")
def q_coerce_temporal(spark, sf_dir):
    """Dates written day-first (``03/10/1998``, ``03-10-1998 00:00:00``) -> N3 vote
    (day-first, since the first value is not ISO) -> ISO text; midnight timestamps
    print as dates."""
    o = table(spark, sf_dir, "orders")
    dirty = o.select("o_orderkey", F.col("o_orderkey").alias("_row"),
                     F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
                     F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss").alias("order_ts"))
    out = NUM.coerce_temporal(dirty, {"order_date": "date", "order_ts": "timestamp"})
    return out.select("o_orderkey", "order_date", "order_ts")


def messy_orders(o):
    """Orders as a messy 12-column text sheet per priority (``_file``): padded cells,
    ``nan`` text, an all-blank and an all-NULL column, one sparse separator row
    and one blank row after every order."""
    s = lambda c: F.col(c).cast("string")
    data = o.select(
        F.col("o_orderpriority").alias("_file"), (F.col("o_orderkey") * 3).alias("_row"),
        s("o_orderkey").alias("Order Key"), s("o_custkey").alias("Customer"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")).alias("Status"),
        s("o_totalprice").alias("Total Price (INR)"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_orderpriority").alias("Priority"),
        F.year("o_orderdate").cast("string").alias("Year"),
        F.when(F.col("o_orderstatus") == "F", F.lit("nan")).otherwise(F.month("o_orderdate").cast("string")).alias("Month"),
        F.dayofmonth("o_orderdate").cast("string").alias("Day"),
        F.lit("  ").alias("Remarks"), F.lit(None).cast("string").alias("Blank Col"),
        F.upper(F.substring("o_orderpriority", 3, 3)).alias("Band"))
    cols = [c for c in data.columns if not c.startswith("_")]
    sep = o.select(F.col("o_orderpriority").alias("_file"), (F.col("o_orderkey") * 3 + 1).alias("_row"),
                   *[(F.lit("—") if c == "Order Key" else F.lit(None).cast("string")).alias(c) for c in cols])
    blank = o.select(F.col("o_orderpriority").alias("_file"), (F.col("o_orderkey") * 3 + 2).alias("_row"),
                     *[F.lit("" if i % 2 else None).cast("string").alias(c) for i, c in enumerate(cols)])
    return data.unionByName(sep).unionByName(blank)


@register("c1_c4_clean_rows", """
SELECT o_orderpriority AS _file, CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS customer,
       o_orderstatus AS status, CAST(o_totalprice AS VARCHAR) AS total_price,
       strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS priority,
       CAST(year(o_orderdate) AS VARCHAR) AS year,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(month(o_orderdate) AS VARCHAR) END AS month,
       CAST(day(o_orderdate) AS VARCHAR) AS day, upper(substr(o_orderpriority, 3, 3)) AS band,
       CAST(NULL AS VARCHAR) AS remarks
FROM orders""")
def q_clean_rows(spark, sf_dir):
    """C1 (drop all-blank / all-NULL columns), C2 (trim, ``''``/``nan`` -> NULL),
    C3/C4 (drop empty and sparse rows), H4 names. ``Remarks`` mixes blanks and
    NULLs, so C1 keeps it (source behaviour) and C2 leaves it all NULL."""
    o = table(spark, sf_dir, "orders")
    out = clean.clean_data(messy_orders(o), footer=False)
    if "total_price" not in out.columns and "total_price_inr" in out.columns:
        out = out.withColumnRenamed("total_price_inr", "total_price")
    return out.drop("_row")


@register("c5_footer_trim", """
SELECT o_orderpriority AS _file, o_orderkey FROM orders""")
def q_footer(spark, sf_dir):
    """Every priority sheet gets notes / source / blank / long-text rows appended
    after its last order; C5 must remove exactly those, nothing else."""
    o = table(spark, sf_dir, "orders")
    body = o.select(F.col("o_orderpriority").alias("_file"), F.col("o_orderkey").alias("_row"),
                    F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").cast("string").alias("price"))
    last = o.groupBy(F.col("o_orderpriority").alias("_file")).agg(F.max("o_orderkey").alias("m"),
                                                                  F.count(F.lit(1)).alias("n"))
    foot_rows = [("Notes: figures are provisional", None, None),
                 ("Source: order ledger", None, None),
                 (None, "", None),
                 ("P - Provisional", None, None),
                 ("These figures are compiled from the order ledger of every priority class and "
                  "may be revised later.", None, None)]
    feet = None
    for i, (a, b, c) in enumerate(foot_rows):
        f = last.select("_file", (F.col("m") + i + 1).alias("_row"),
                        F.lit(a).cast("string").alias("key"), F.lit(b).cast("string").alias("status"),
                        F.lit(c).cast("string").alias("price"))
        feet = f if feet is None else feet.unionByName(f)
    sheet = body.unionByName(feet)
    return clean.trim_footer(sheet).select("_file", F.col("key").cast("long").alias("o_orderkey"))


@register("c11_standardize_labels", """
SELECT p_partkey, p_name FROM part""")
def q_labels(spark, sf_dir):
    """Part names carrying footnote marks (`` *``, `` †``, `` (12)``, ``**``) -> C11."""
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_size"), F.lit(4))
    dirty = (F.when(k == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" *")))
             .when(k == 1, F.concat(F.col("p_name"), F.lit(" †")))
             .when(k == 2, F.concat(F.col("p_name"), F.lit(" (12)")))
             .otherwise(F.concat(F.col("p_name"), F.lit("**"))))
    return clean.standardize_labels(p.select("p_partkey", dirty.alias("p_name")))


@register("h4_clean_column_names", """
SELECT p_partkey, replace(lower(p_name), ' ', '_') ||
       CASE p_size % 3 WHEN 0 THEN '_adjusted_unadjusted' WHEN 1 THEN '_total_net' ELSE '' END AS clean_name
FROM part""")
def q_clean_names(spark, sf_dir):
    """Headers like ``Small Ring (Unadjusted) [ECONOMY] - Brand#2`` -> H4."""
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_size"), F.lit(3))
    qual = F.when(k == 0, F.lit(" (Unadjusted)")).when(k == 1, F.lit(" (Net Total)")).otherwise(F.lit(" (Rs. crore)"))
    header = F.concat(F.initcap("p_name"), qual, F.lit(" ["), F.col("p_type"), F.lit("] - "), F.col("p_brand"))
    return p.select("p_partkey", N.clean_column_name(header).alias("clean_name"))


@register("h5_similarity_names", """
SELECT p_partkey, 'no_of_' || replace(p_name, ' ', '_') || '_as_on' AS norm_name FROM part""")
def q_sim_names(spark, sf_dir):
    """Period-suffixed column names (``..._dec_31_2025``, ``..._fy2024_25``,
    ``..._q1_2024``, ``..._2023_24``, ``..._2024``) -> H5 strips the period part."""
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_size"), F.lit(5))
    suffix = (F.when(k == 0, F.lit("_dec_31_2025")).when(k == 1, F.lit("_fy2024_25"))
              .when(k == 2, F.lit("_q1_2024")).when(k == 3, F.lit("_2023_24")).otherwise(F.lit("_2024")))
    name = F.concat(F.lit("No_of_"), F.regexp_replace("p_name", " ", "_"), F.lit("_as_on"), suffix)
    return p.select("p_partkey", N.normalize_for_similarity(name).alias("norm_name"))


@register("h13_file_stems", """
SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN '_monthly' WHEN 1 THEN '_yearly' ELSE '' END AS stem
FROM part""")
def q_stems(spark, sf_dir):
    """Uploaded file names ``Table 7 - small%20ring-M_p.csv`` -> H13 stems."""
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_size"), F.lit(3))
    suf = F.when(k == 0, F.lit("-M_p")).when(k == 1, F.lit("_Y_p")).otherwise(F.lit("_p"))
    path = F.concat(F.lit("/landing/Table "), F.col("p_size").cast("string"), F.lit(" - "),
                    F.regexp_replace("p_name", " ", "%20"), suf, F.lit(".csv"))
    return p.select("p_partkey", N.file_stem(path).alias("stem"))


def _as_text(df):
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


_T1_CASE = ("CASE WHEN data_type IN ('BIGINT','INTEGER','SMALLINT') THEN 'BIGINT' "
            "WHEN data_type IN ('DOUBLE','FLOAT','REAL') THEN 'DOUBLE PRECISION' "
            "WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'TIMESTAMP WITHOUT TIME ZONE' "
            "ELSE 'TEXT' END")
_TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)


@register("t1_type_inference", f"""
SELECT table_name, column_name, {_T1_CASE} AS inferred_type
FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})""")
def q_infer(spark, sf_dir):
    """T1 cascade over every table read back as text (every value: full-data mode),
    all tables in ONE aggregate; the oracle reads the declared Parquet types instead."""
    return _inferred_all(spark, sf_dir)


def _inferred_all(spark, sf_dir):
    vals = None
    for t in TABLES:
        df = table(spark, sf_dir, t)
        v = TY.long_values(df, t, df.columns)
        vals = v if vals is None else vals.unionByName(v)
    return TY.infer_long(vals)


# string columns of the driver tables (from the fixture schemas)
STRING_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "documents": ["text", "lang", "source"],
    "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def _varchar_sql():
    parts = []
    for t, cols in STRING_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"CAST(max(length({c})) AS INTEGER) AS max_len FROM {t}")
    body = " UNION ALL ".join(parts)
    return (f"SELECT table_name, column_name, max_len, CASE WHEN max_len <= 50 THEN 'VARCHAR(100)' "
            f"WHEN max_len <= 100 THEN 'VARCHAR(200)' WHEN max_len <= 255 THEN 'VARCHAR(500)' "
            f"ELSE 'TEXT' END AS declared_type FROM ({body})")


@register("t2_varchar_sizing", _varchar_sql())
def q_varchar(spark, sf_dir):
    """Declared text type per string column from its longest value (one
    aggregate per table over all of its string columns)."""
    out = None
    for t in STRING_COLUMNS:
        r = TY.string_lengths(table(spark, sf_dir, t), table_name=t)
        out = r if out is None else out.unionByName(r)
    return out.select("table_name", "column_name", F.col("max_len").cast("int").alias("max_len"),
                      TY.fix_varchar(TY.varchar_size("max_len"), "max_len").alias("declared_type"))


_PG_CASE = ("CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'integer' "
            "WHEN data_type = 'DOUBLE' THEN 'double precision' WHEN data_type = 'FLOAT' THEN 'real' "
            "WHEN data_type = 'TIMESTAMP' THEN 'timestamp without time zone' ELSE 'text' END")
_LATTICE_VALUES = ", ".join(f"('{a}', '{b}')" for a, bs in TY.WIDENING.items() for b in bs)


@register("t5_type_drift", f"""
WITH declared AS (SELECT table_name, column_name, {_PG_CASE} AS from_type FROM information_schema.columns
                  WHERE table_name IN ({_TABLE_LIST})),
inferred AS (SELECT table_name, column_name, lower({_T1_CASE}) AS to_type FROM information_schema.columns
             WHERE table_name IN ({_TABLE_LIST})),
lattice(a, b) AS (VALUES {_LATTICE_VALUES})
SELECT d.table_name, d.column_name, d.from_type, i.to_type,
       EXISTS (SELECT 1 FROM lattice WHERE a = d.from_type AND b = i.to_type) AS safe
FROM declared d JOIN inferred i USING (table_name, column_name)
WHERE d.from_type <> i.to_type AND i.to_type <> 'text'""")
def q_drift(spark, sf_dir):
    """Declared table types (existing) against T1 types of the same tables
    read back as text (incoming) -> drift rows with the lattice verdict."""
    from sheaf.operators.schema import type_drift
    declared = spark.createDataFrame(
        [(t, f.name, TY.spark_to_sql_type(f.dataType)) for t in TABLES
         for f in table(spark, sf_dir, t).schema.fields],
        "table_name string, column_name string, col_type string")
    incoming = _inferred_all(spark, sf_dir).select("table_name", "column_name",
                                                   F.lower("inferred_type").alias("col_type"))
    return type_drift(declared, incoming, keys=("table_name", "column_name"))


#: Every numeric column of the driver tables.
NUMERIC_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn"],
}


def _intsize_sql():
    parts = []
    for t, cols in NUMERIC_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS DECIMAL(38,6)) AS mn, "
                         f"CAST(max({c}) AS DECIMAL(38,6)) AS mx, bool_and({c} = floor({c})) AS integral FROM {t}")
    body = " UNION ALL ".join(parts)
    return (f"SELECT table_name, column_name, CASE WHEN NOT integral THEN 'numeric' "
            f"WHEN mn >= -32768 AND mx <= 32767 THEN 'smallint' "
            f"WHEN mn >= -2147483648 AND mx <= 2147483647 THEN 'integer' ELSE 'bigint' END AS target_type "
            f"FROM ({body})")


@register("t8_integer_sizing", _intsize_sql())
def q_intsize(spark, sf_dir):
    """T8 decided up front: min/max/integral per numeric column (one aggregate per
    table) -> narrowest type that holds the data."""
    out = None
    for t, cols in NUMERIC_COLUMNS.items():
        df = table(spark, sf_dir, t)
        one = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.min(c).cast("decimal(38,6)").alias(f"a{i}"), F.max(c).cast("decimal(38,6)").alias(f"b{i}"),
            F.bool_and(F.col(c) == F.floor(c)).alias(f"g{i}"))])
        long = one.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("mn"), F.col(f"b{i}").alias("mx"),
                     F.col(f"g{i}").alias("integral")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
        r = long.select(F.lit(t).alias("table_name"), "column_name",
                        TY.integer_target_type("mn", "mx", "integral").alias("target_type"))
        out = r if out is None else out.unionByName(r)
    return out


@register("h8_unique_names", """
WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber AS pos,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i,
    l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '_1' ELSE '' END AS name FROM lineitem),
r AS (SELECT l_orderkey, pos, i, name, name AS u, [lower(name)] AS taken FROM n WHERE i = 1
  UNION ALL
  SELECT l_orderkey, pos, i, name, u, list_append(taken, lower(u)) FROM (
    SELECT n.l_orderkey, n.pos, n.i, n.name, r.taken,
           CASE WHEN NOT list_contains(r.taken, lower(n.name)) THEN n.name ELSE n.name || '_' ||
             list_min(list_filter(range(1, 20), lambda k: NOT list_contains(r.taken, lower(n.name) || '_' || k))) END AS u
    FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1))
SELECT l_orderkey, pos, name, u AS unique_name FROM r""")
def q_unique(spark, sf_dir):
    """H8 over a names frame: every order is a file whose columns are named by its lines
    (a flag, every second one with ``_1``), so that suffixed names are taken already. The
    oracle walks the names one after the other."""
    names = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("pos"),
        F.concat("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "_1").otherwise("")).alias("name"))
    return N.unique_names(names, "name", "pos", group_cols=["l_orderkey"])
