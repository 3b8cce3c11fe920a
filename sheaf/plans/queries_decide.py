"""Decision, naming and label queries (D1-D3, D5, D7, H14, Q4) over files, tables and
candidates derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import names as N
from sheaf.operators import decide as D
from sheaf.operators import profile as P
from sheaf.plans.registry import register
from sheaf.session import table

_LADDER_SQL = """
li AS (SELECT l_orderkey AS f, l_linenumber AS ln, l_suppkey AS s, CAST(l_quantity AS INTEGER) AS q, l_shipdate AS d, l_linestatus AS st,
         ['column', 'vector', 'peer', 'exact'][1 + l_linenumber % 4] AS source, 1 + l_linenumber % 3 AS rank,
         2.0 * CAST(l_quantity AS INTEGER) AS match_pct, 'supplier_' || (l_suppkey % 5) || '_sales' AS table_name,
         'supplier_' || (l_orderkey % 5) || '_sales' AS file_table FROM lineitem),
c AS (SELECT f, table_name, file_table, source, min(rank) AS rank, max(match_pct) AS match_pct, max(ln / 10.0) AS score FROM li GROUP BY ALL),
dec AS (SELECT f, table_name, max(q) % 3 = 0 AS is_related, 0.5 + (max(q) % 5) / 10.0 AS confidence FROM li GROUP BY ALL HAVING max(q) % 2 = 0),
j AS (SELECT c.*, CASE source WHEN 'exact' THEN 1 WHEN 'vector' THEN 2 WHEN 'column' THEN 3 ELSE 4 END AS priority, is_related, coalesce(confidence, 1.0) AS confidence,
        CASE WHEN table_name = file_table THEN 1.0 ELSE 0.5 END AS name_sim
      FROM c LEFT JOIN dec USING (f, table_name)
      WHERE (source <> 'vector' OR rank = 1) AND (source NOT IN ('vector', 'column') OR match_pct >= 60)),
ok AS (SELECT * FROM j WHERE coalesce(is_related, true)
         OR (match_pct >= 85 AND confidence < 0.85 AND name_sim >= 0.5) OR (match_pct >= 95 AND confidence < 0.85)),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY f ORDER BY priority, rank, table_name) = 1)"""


def _candidates(spark, sf_dir):
    """Every line of an order is a candidate for the order's file: the supplier's table, by
    one of the four sources."""
    li = table(spark, sf_dir, "lineitem")
    sales = lambda c: F.concat(F.lit("supplier_"), (F.col(c) % 5).cast("string"), F.lit("_sales"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("column", "vector", "peer", "exact")]), (1 + F.col("l_linenumber") % 4).cast("int"))
    q = F.col("l_quantity").cast("int")
    rows = li.select(F.col("l_orderkey").alias("file_id"), sales("l_orderkey").alias("file_table"), sales("l_suppkey").alias("table_name"),
                     source.alias("source"), (1 + F.col("l_linenumber") % 3).alias("rank"), (F.col("l_linenumber") / 10).alias("score"),
                     (2.0 * q).alias("match_pct"), q.alias("q"))
    cand = rows.groupBy("file_id", "file_table", "table_name", "source").agg(
        F.min("rank").alias("rank"), F.max("score").alias("score"), F.max("match_pct").alias("match_pct"))
    dec = rows.groupBy("file_id", "table_name").agg(F.max("q").alias("q")).where("q % 2 = 0").select(
        "file_id", "table_name", (F.col("q") % 3 == 0).alias("is_related"), (0.5 + (F.col("q") % 5) / 10).alias("confidence"))
    return cand, dec


@register("d1_match_ladder", f"""
WITH {_LADDER_SQL}
SELECT f AS file_id, b.table_name AS target_table, b.source AS matched_by, round(b.match_pct, 3) AS match_pct, b.f IS NOT NULL AS is_incremental
FROM (SELECT DISTINCT f FROM li) LEFT JOIN best b USING (f)""")
def q_ladder(spark, sf_dir):
    """Candidates of four sources with decisions that reject, and structure that
    overrides them; the first survivor per file."""
    cand, dec = _candidates(spark, sf_dir)
    return D.match_ladder(cand, dec).select("file_id", "target_table", "matched_by", F.round("match_pct", 3).alias("match_pct"), "is_incremental")


@register("d5_d7_routing", f"""
WITH {_LADDER_SQL},
n AS (SELECT DISTINCT f FROM li),
m AS (SELECT f, CASE WHEN f % 7 = 0 THEN 'otl' WHEN f % 7 = 1 THEN 'inc' END AS mode,
        replace(lower('Supplier ' || (f % 9) || ' Sales'), ' ', '_') AS given FROM n),
r AS (SELECT m.f, mode, CASE WHEN mode = 'inc' THEN given WHEN mode IS NULL THEN best.table_name END AS target_table,
        CASE WHEN mode = 'otl' THEN false WHEN mode = 'inc' THEN true ELSE best.f IS NOT NULL END AS inc,
        CASE WHEN mode = 'inc' AND given NOT IN (SELECT table_name FROM li) THEN 'target table does not exist: ' || given END AS error
      FROM m LEFT JOIN best USING (f))
SELECT f AS file_id, target_table, inc AS is_incremental, error,
       CASE WHEN inc AND f % 4 = 0 AND f % 3 = 0 THEN 'duplicate_data_detected' WHEN inc THEN 'schema_mismatch' ELSE 'awaiting_approval' END AS status
FROM r""")
def q_routing(spark, sf_dir):
    """D5 and D7 after the ladder: files whose mode the user set bypass it, a named target
    must exist, and every file gets its status."""
    cand, dec = _candidates(spark, sf_dir)
    auto = D.match_ladder(cand, dec).select("file_id", F.col("target_table").alias("_auto"), F.col("is_incremental").alias("_inc"))
    f = F.col("file_id")
    files = auto.select("file_id", F.when(f % 7 == 0, "otl").when(f % 7 == 1, "inc").alias("sql_mode"),
                        F.concat(F.lit("Supplier "), (f % 9).cast("string"), F.lit(" Sales")).alias("table_name_override"))
    manual = D.manual_modes(files.where("sql_mode IS NOT NULL"), cand.select("table_name").distinct())
    both = auto.join(manual, "file_id", "left").select(
        "file_id", F.when(F.col("sql_mode").isNull(), F.col("_auto")).otherwise(F.col("target_table")).alias("target_table"),
        F.coalesce("is_incremental", "_inc").alias("is_incremental"), "error",
        F.when(f % 4 == 0, "DUPLICATE").otherwise("NEW_DATA").alias("dup_status"), (f % 3 == 0).alias("is_compatible"))
    return D.route(both).select("file_id", "target_table", "is_incremental", "error", "status")


#: Phrases of the naming dictionary: (phrase, segment, canonical).
PHRASES = [("furniture", "domain", "home"), ("building", "domain", "construction"), ("machinery", "domain", "machines"),
           ("household", "domain", "home"), ("account balance", "domain", "balances"),
           *[(f"nation {k}", "geo", f"n{k}") for k in range(1, 15)], ("nation", "geo", "country"),
           ("monthly", "time", "mth"), ("yearly", "time", "yr"),
           ("per customer", "grain", "customer"), ("customer", "grain", "client")]
_PHRASES_SQL = ", ".join(f"('{p}', '{s}', '{c}')" for p, s, c in PHRASES)


@register("h14_table_names", f"""
WITH d(phrase, segment, canonical) AS (VALUES {_PHRASES_SQL}),
f AS (SELECT c_custkey AS job_id, lower(c_mktsegment) AS m, lower(n_name) AS n, c_custkey % 3 AS t, c_custkey % 2 AS g
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, m || ' ' || n || CASE t WHEN 0 THEN ' monthly' WHEN 1 THEN ' yearly' ELSE '' END AS stem FROM f),
seg AS (SELECT job_id, stem, (SELECT canonical FROM d WHERE segment = 'domain' AND phrase = m) AS mk,
          coalesce((SELECT canonical FROM d WHERE segment = 'geo' AND phrase = replace(n, '_', ' ')), 'country') AS geo,
          CASE t WHEN 0 THEN 'mth' WHEN 1 THEN 'yr' END AS time, CASE g WHEN 0 THEN 'customer' END AS grain,
          CASE g WHEN 0 THEN 'balances' END AS long_domain FROM s),
named AS (SELECT job_id, coalesce(long_domain, mk) AS domain, geo, time, grain, concat_ws('_', coalesce(long_domain, mk, replace(stem, ' ', '_')), geo, time, grain) AS name
          FROM seg),
cl AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY job_id) AS k FROM named),
p AS (SELECT *, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS proposed FROM cl)
SELECT job_id, domain, geo, time, grain, CASE WHEN proposed IN ('construction_n1_yr', 'balances_n2_customer') THEN proposed || '_new_20260101' ELSE proposed END AS table_name
FROM p""")
def q_names(spark, sf_dir):
    """H14 end to end, over H13 and H4: a file per customer, named by market segment, nation
    and period, some with columns that tell more; segments by the longest phrase, then the
    final name, numbered where files share it and moved aside where the catalog has it."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    period = F.element_at(F.array(F.lit("_Monthly"), F.lit("_Yearly"), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))
    files = c.select(F.col("c_custkey").alias("job_id"),
                     F.concat(F.lit("/in/Table 7 - "), F.initcap("c_mktsegment"), F.lit("%20"), F.col("n_name"), period, F.lit(".csv")).alias("file_name"),
                     F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Account Balance"), F.lit("Total (per customer)"))).alias("columns"))
    dictionary = spark.createDataFrame(PHRASES, "phrase string, segment string, canonical string")
    catalog = spark.createDataFrame([("construction_n1_yr",), ("balances_n2_customer",)], "table_name string")
    return N.propose_table_names(files, dictionary, catalog, "20260101").select("job_id", "domain", "geo", "time", "grain", "table_name")


@register("q4_subdomain_terms", r"""
WITH t AS (SELECT lang, source, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS term FROM documents),
p AS (SELECT lang, source, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL),
g AS (SELECT lang, source, sum(n) AS gt FROM p GROUP BY ALL), d AS (SELECT lang, avg(gt) AS mt FROM g GROUP BY ALL),
w AS (SELECT lang, term, sum(n) AS tt FROM p GROUP BY ALL),
s AS (SELECT lang, source, term, round(n / gt * ln(1 + mt / tt), 9) AS score FROM p JOIN w USING (lang, term) JOIN g USING (lang, source) JOIN d USING (lang))
SELECT lang, source, term, round(score, 6) AS score, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, term)::INTEGER AS rank
FROM s QUALIFY rank <= 3""")
def q_subdomains(spark, sf_dir):
    """Q4, sub-domain: the three terms that set each source apart within its language."""
    d = table(spark, sf_dir, "documents")
    terms = d.select(F.col("lang").alias("domain"), F.col("source").alias("grp"),
                     F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("term")).where("term <> ''")
    counts = terms.groupBy("domain", "grp", "term").agg(F.count("*").alias("n"))
    return P.contrastive_terms(counts, 3).select(F.col("domain").alias("lang"), F.col("grp").alias("source"), "term",
                                                 F.round("score", 6).alias("score"), "rank")
