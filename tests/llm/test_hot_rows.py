"""A third of all rows alike: what meets in one task stays small, and results stay right."""
from pyspark.sql import functions as F

from sheaf.llm import line_dedup, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block")]


def test_urls_without_host_stay_out_of_the_join(spark):
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "http://example.com/en/hot")
    df = spark.range(n).select(F.col("id").alias("page_id"), F.coalesce(hot, F.when(F.col("id") % 3 == 2, F.concat(
        F.lit("http://h"), (F.col("id") % 977).cast("string"), F.lit(".net/es/x")))).alias("url"))
    got = url_filter.judge_urls(df, url_filter.rule_frame(spark, RULES))
    assert {tuple(r) for r in got.groupBy("rule", "verdict").count().collect()} == {
        (None, "allow", n // 3), ("example.com/en/", "block", n // 3), ("net/es/", "block", n // 3)}
    long = spark.createDataFrame([(1, "http://a.example.com/en/" + "p/" * 200_000 + "?q#f"), (2, "x" * 300_000)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge_urls(long, url_filter.rule_frame(spark, RULES)).collect()}
    assert rows[1].rule == "example.com/en/" and len(rows[1].path) == 400_004 and rows[2].verdict == "allow"


def test_repeated_rows_collapse_before_their_lines_meet(spark):
    run = "\n".join(" ".join(f"w{k}x{j}" for j in range(15)) for k in range(5))
    rows = [(7, f"own seven\n{run}")] * 3000 + [(None, run)] * 2000 + [(8, f"{run}\nown eight"), (9, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    lines = line_dedup.distinct_symbols(docs, "doc_id", "text")
    assert lines.count() == 6 + 5 + 6 + 1 and lines.groupBy("_d", "_h", "_pos").count().where("count > 1").count() == 0
    got = line_dedup.dedup_lines(docs, min_words=50).groupBy("doc_id", "text", "lines_removed").count().collect()
    assert {tuple(r) for r in got} == {(None, run, 0, 2000), (7, "own seven", 5, 3000), (8, "own eight", 5, 1), (9, "alone here", 0, 1)}
    long = "\n".join(f"line {k % 50_000} of a very long text with some more words in each line" for k in range(60_000))
    [r] = line_dedup.dedup_lines(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert r.lines_removed == 10_000 and r.text == "\n".join(long.split("\n")[:50_000])
