"""Operator 1, URL filters (native): a sort-merge range join.

A rule is (host, path, verdict). It fits its host and every subdomain when the url's
path starts with the rule's path. Written with reversed labels, a host and its
subdomains share a prefix, and so do a path and the paths below it, so each rule is an
interval of sorted keys. Urls and interval ends are sorted together and swept once: the
running count of open intervals is the height of the stack, and the interval on top of
it is the last one that was opened at that height.

Two sweeps are made, over hosts and then, under each rule host that fits, over paths.
Both run over distinct keys in range slices of bounded size; a hot host or url is one
key. All of it is DataFrame code.

Defined cases: a null url or one without ``://`` has empty host and path and fits no
rule; urls of any length are judged whole; no rule or an empty table gives the default verdict; of rules that fit, the longest
host wins, then the longest path; a rule listed twice with both verdicts blocks; repeated
rows are judged alike and all returned; a column named like an output (host, path, rule,
verdict) is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import carry_last, carry_sum, materialize, range_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUTS = ("host", "path", "rule", "verdict")


def with_url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return (df.withColumn("host", F.translate(
                F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER))
            .withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)))


def _host_key(host):
    """``www.example.com`` -> ``com.example.www.``; the closing dot ends a label, so that
    a prefix of a key is always a parent domain."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key).cast("binary")


def innermost(points: DataFrame, rules: DataFrame, group: list[str], key: str, out: str) -> DataFrame:
    """For distinct ``points`` (group columns, binary ``key``): the longest ``key`` among
    the distinct ``rules`` of the same group that is a prefix of the point's, as ``out``
    (null: none). An interval ends at its key with a byte 0xFF, which no UTF-8 has."""
    cols = [*group, key]
    events = (rules.select(*cols, F.lit(0).alias("_kind"), F.lit(1).alias("_step"))
              .unionByName(points.select(*cols, F.lit(1).alias("_kind"), F.lit(0).alias("_step")))
              .unionByName(rules.select(*group, F.concat(F.col(key), F.unhex(F.lit("FF"))).alias(key),
                                        F.lit(2).alias("_kind"), F.lit(-1).alias("_step"))))
    order = [*cols, "_kind"]
    swept = carry_sum(range_slices(events, order), order, F.col("_step"), "_height")
    swept = swept.where(F.col("_kind") < 2)
    opened = F.when(F.col("_kind") == 0, F.struct(*cols))
    top = carry_last(swept, order, opened, "_top", groups=["_height"])
    return (top.where(F.col("_kind") == 1)
            .select(*cols, F.when(F.col("_height") > 0, F.col(f"_top.{key}")).alias(out)))


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules`` has host, path, verdict."""
    urls = with_url_parts(df.drop(*[c for c in OUTPUTS if c != url_col]), url_col)
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("r_host"),
                          F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
             .where(F.col("r_host").isNotNull())
             .groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
             .withColumn("hk", _host_key(F.col("r_host")))
             .withColumn("pk", F.col("r_path").cast("binary")))
    keys = (urls.where(F.col("host") != "").select("host", "path").distinct()
            .withColumn("hk", _host_key(F.col("host"))).withColumn("pk", F.col("path").cast("binary")))

    # First sweep: the innermost rule host above each host; its own parents among the
    # rule hosts (the stack below it) follow from the rules alone.
    rule_hosts = rules.select("hk").distinct()
    hosts = innermost(keys.select("hk").distinct(), rule_hosts, [], "hk", "anchor")
    labels = F.reverse(F.split("r_host", r"\.", -1))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")).cast("binary"))
    chain = (rules.select(F.col("hk").alias("anchor"), F.explode(F.concat(
                F.array(F.lit("").cast("binary")), F.when(F.col("r_host") != "", parents)
                .otherwise(F.expr("array()").cast("array<binary>")))).alias("over")).distinct()
             .join(rule_hosts.withColumnRenamed("hk", "over"), "over", "left_semi"))
    # Second sweep: below each fitting rule host, the innermost rule path.
    under = hosts.where(F.col("anchor").isNotNull()).join(chain, "anchor").select("hk", "over")
    asked = keys.join(under, "hk").select("host", "path", "over", "pk")
    paths = innermost(asked.select("over", "pk").distinct(),
                      rules.select(F.col("hk").alias("over"), "pk"), ["over"], "pk", "rule_pk")
    best = (asked.join(paths.where(F.col("rule_pk").isNotNull()), ["over", "pk"])
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("over").alias("n"), "over", "rule_pk")).alias("b"))
            .select("host", "path", F.col("b.over").alias("hk"), F.col("b.rule_pk").alias("pk")))
    found = (best.join(rules, ["hk", "pk"])
             .select("host", "path", F.concat("r_host", "r_path").alias("rule"), "verdict"))
    # written out, so that both sides of the join are plain exchanges and a hot url is split;
    # urls without a host fit no rule and stay out of it
    judged = urls.where(F.col("host") != "").join(materialize(found), ["host", "path"], "left")
    bare = urls.where(F.col("host") == "").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return judged.unionByName(bare).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
