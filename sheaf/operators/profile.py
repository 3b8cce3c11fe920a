"""Profiles and labels (Q1-Q5).

Per-column facts come from ONE aggregate over all columns (never one job per
column); samples come from a bounded head of the data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators import data_columns

# ---- fixed values ------------------------------------------------------------
DOMAINS = ["CPI", "GDP", "IIP", "MSME", "GST", "agriculture_and_rural", "social_migration_and_households",
           "enterprise_surveys", "worker_surveys", "finance_and_industry"]
DEFAULT_DOMAIN = "IIP"
MAJOR_DOMAINS = [
    "Agriculture, Forestry and Rural Development", "Central Bank Assets",
    "Chemical, Mining and Natural Resources", "Commerce, Finance, Banking and Insurance",
    "Credit Statistics", "Demography", "Derivatives Statistics", "Digital payments",
    "Economy and Financial Indicators", "E-Governance", "Enterprise Establishment Surveys",
    "Environment", "Environment and Trade", "EPFO", "Exchange Rates", "FDI",
    "Financial Securities", "GDP", "Global Liquidity Indicators", "GST",
    "Healthcare", "Household Consumption Expenditure", "IIP", "Industry productivity",
    "Insurance", "International Banking", "Labour", "Logistics and Mobility",
    "Ministry of Corporate Affairs", "MSME", "Mutual Funds", "Prices & Inflation",
    "Rainfall", "Real Estate", "Renewable Resources", "Research and Development",
    "State Economic Survey", "Toll", "Trade", "Trade Policy Uncertainty",
    "Traffic", "Transportation", "UNIDO", "Youth Development"]
DEFAULT_MAJOR_DOMAIN = "Economy and Financial Indicators"
STOPWORDS = ["and", "of", "the", "&"]
PREVIEW_ROWS = 5
PREVIEW_SAMPLES = 3
PROFILE_SAMPLES = 10
# ------------------------------------------------------------------------------


def preview(df: DataFrame, order_col: str = "_row", n: int = PREVIEW_ROWS) -> DataFrame:
    """Q1 rows: the first ``n`` rows by ``order_col`` (a top-n, bounded)."""
    return df.orderBy(order_col).limit(n) if order_col in df.columns else df.limit(n)


def preview_block(df: DataFrame, types: dict[str, str] | None = None, order_col: str = "_row") -> DataFrame:
    """Q1 block: one row per column with its type (given, else the frame's), the first
    three non-null values and the total number of rows; the rows shown are ``preview``."""
    cols = [c for c in df.columns if not c.startswith("_")]
    given = {c: (types or {}).get(c, df.schema[c].dataType.simpleString()) for c in cols}
    name = F.create_map(*[x for c, t in given.items() for x in (F.lit(c), F.lit(t))])
    prof = column_profile(df, order_col, samples=PREVIEW_SAMPLES)
    return prof.select("column_name", name[F.col("column_name")].alias("type"), F.col("samples").alias("sample_values"),
                       F.col("total_count").alias("total_rows"))


def column_profile(df: DataFrame, order_col: str | None = "_row", table_name: str | None = None,
                   samples: int = PROFILE_SAMPLES) -> DataFrame:
    """Q2 (+ Q1 column part): long ``(column_name, data_type, null_count, total_count,
    max_length, samples)``; counts from one aggregate, samples = the first non-null
    values of the whole column, as text (a top-n per column: each task keeps its first
    values, and a column is read with the order alone)."""
    cols = data_columns(df)
    q = lambda c: F.col(f"`{c}`")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(q(c)).alias(f"c{i}"))
        aggs.append(F.max(F.length(q(c).cast("string"))).alias(f"l{i}"))
    one = df.agg(*aggs)
    order = F.col(order_col) if order_col and order_col in df.columns else F.monotonically_increasing_id()
    firsts = [df.select(order.alias("_o"), F.lit(c).alias("column_name"), q(c).cast("string").alias("v"))
              .where(F.col("v").isNotNull()).orderBy("_o").limit(samples) for c in cols]
    long_s = reduce(DataFrame.unionByName, firsts).groupBy("column_name").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_o", "v"))), lambda s: s["v"]).alias("samples"))
    long_c = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 (F.col("_n") - F.col(f"c{i}")).alias("null_count"), F.col("_n").alias("total_count"),
                 F.col(f"l{i}").alias("max_length")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    out = long_c.join(long_s, "column_name", "left").withColumn(
        "samples", F.coalesce("samples", F.expr("cast(array() as array<string>)")))
    if table_name is not None:
        out = out.select(F.lit(table_name).alias("table_name"), "*")
    return out


def mostly_empty_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Q3: columns whose NULL share exceeds ``share`` (one aggregate)."""
    cols = data_columns(df)
    one = df.agg(*[F.avg(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0)).alias(f"e{i}")
                   for i, c in enumerate(cols)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"e{i}").alias("null_share"))
                                          for i, c in enumerate(cols)])).alias("x")).select("x.*")
    return long.where(F.col("null_share") > share)


def _keywords(label: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", label.lower()) if t and t not in STOPWORDS]


def keyword_dictionary(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Label -> keyword rows derived by rule from the label text (bounded; broadcast)."""
    rows = [(i, lab, k) for i, lab in enumerate(labels) for k in dict.fromkeys(_keywords(lab))]
    return spark.createDataFrame(rows, "label_ord int, label string, keyword string")


def classify_labels(tokens: DataFrame, labels: list[str], default: str,
                    decisions: DataFrame | None = None) -> DataFrame:
    """Q4: ``tokens(table_name, token)`` (name and column-name tokens) joined with
    a keyword dictionary built from the valid labels; the label with the most
    keyword hits wins (ties: list order); no hit -> ``default``; a decisions row
    ``(table_name, label)`` overrides when its label is valid."""
    d = F.broadcast(keyword_dictionary(tokens.sparkSession, labels))
    hits = tokens.select("table_name", F.lower("token").alias("keyword")).distinct().join(d, "keyword")
    score = hits.groupBy("table_name", "label", "label_ord").agg(F.count(F.lit(1)).alias("hits"))
    best = score.groupBy("table_name").agg(
        F.max_by("label", F.struct(F.col("hits"), -F.col("label_ord"))).alias("rule_label"))
    out = tokens.select("table_name").distinct().join(best, "table_name", "left")
    if decisions is not None:
        valid = F.broadcast(tokens.sparkSession.createDataFrame([(x,) for x in labels], "label string")
                            .withColumn("_valid", F.lit(True)))
        dec = decisions.join(valid, "label", "left").where(F.col("_valid")).select(
            "table_name", F.col("label").alias("decided"))
        out = out.join(dec, "table_name", "left")
    else:
        out = out.withColumn("decided", F.lit(None).cast("string"))
    return out.select("table_name", F.coalesce("decided", "rule_label", F.lit(default)).alias("label"))


def contrastive_terms(counts: DataFrame, k: int = 1) -> DataFrame:
    """Q4, sub-domain: what a group is about among the groups of its domain.
    ``counts(domain, grp, term, n)`` -> ``(domain, grp, term, score, rank)``, the ``k`` best
    terms. A term's score is its share of the group's terms times ``ln(1 + mean size of a
    group / occurrences in the domain)``: terms that every group uses weigh little, terms
    that this group uses and the others do not weigh most. Ties go to the smaller term;
    scores are compared to nine places."""
    per = counts.groupBy("domain", "grp", "term").agg(F.sum("n").alias("n"))
    groups = per.groupBy("domain", "grp").agg(F.sum("n").alias("group_total"))
    domains = groups.groupBy("domain").agg(F.avg("group_total").alias("mean_total"))
    terms = per.groupBy("domain", "term").agg(F.sum("n").alias("term_total"))
    score = F.round(F.col("n") / F.col("group_total") * F.log(1 + F.col("mean_total") / F.col("term_total")), 9)
    told = (per.join(terms, ["domain", "term"]).join(groups, ["domain", "grp"]).join(domains, "domain")
            .select("domain", "grp", "term", score.alias("score")))
    # the limit on ranks is applied per task before groups meet
    best = Window.partitionBy("domain", "grp").orderBy(F.col("score").desc(), "term")
    return told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def name_tokens_frame(tables: DataFrame) -> DataFrame:
    """``tables(table_name, columns array<string>)`` -> ``(table_name, token)``."""
    toks = F.flatten(F.array(F.split(F.col("table_name"), r"[^A-Za-z0-9]+"),
                             F.flatten(F.transform("columns", lambda c: F.split(c, r"[^A-Za-z0-9]+")))))
    return tables.select("table_name", F.explode(toks).alias("token")).where(F.col("token") != "")


def describe(tables: DataFrame) -> DataFrame:
    """Q5: description text from profile facts:
    ``tables(table_name, rows_count, columns, period_col, first_value, last_value)``."""
    period = F.when(F.col("period_col").isNotNull(),
                    F.format_string(" Period column %s covers %s to %s.", F.col("period_col"),
                                    F.col("first_value"), F.col("last_value"))).otherwise(F.lit(""))
    return tables.select("table_name", F.concat(
        F.format_string("Table %s with %d rows and %d columns: %s.", F.col("table_name"), F.col("rows_count"),
                        F.size("columns"), F.array_join(F.slice("columns", 1, 10), ", ")), period).alias("description"))
