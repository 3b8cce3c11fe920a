"""Signature and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import signatures as SG
from sheaf.operators import vectors as VE
from sheaf.plans.registry import register
from sheaf.session import table


def label_centroids(emb):
    """Mean vector per label (element-wise), derived by Spark from the table."""
    pos = emb.select("label", F.posexplode("embedding").alias("i", "x"))
    c = pos.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")) \
        .select(F.col("label").cast("long").alias("qid"), F.transform("p", lambda s: s["x"]).alias("embedding"))


@register("j10_cosine_topk", """
WITH p AS (SELECT label, i, x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
                                    FROM embeddings)),
c AS (SELECT label, list(avg_x ORDER BY i) AS cv FROM (SELECT label, i, avg(x) AS avg_x FROM p GROUP BY ALL) GROUP BY label),
s AS (SELECT CAST(c.label AS BIGINT) AS qid, e.vec_id AS id,
             list_cosine_similarity(CAST(c.cv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
      FROM c JOIN embeddings e ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score >= 0.1""")
def q_cosine(spark, sf_dir):
    """For each label's mean vector (the query batch, derived from the table),
    the 5 most similar embeddings by cosine with score >= 0.1 (the test vectors are
    random, so the default 0.85 keeps nothing)."""
    emb = table(spark, sf_dir, "embeddings")
    r = SG.cosine_topk(emb, label_centroids(emb), k=5, threshold=0.1, corpus_id="vec_id")
    return r.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@register("j10_cells_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i = 1 + vec_id % 16 THEN 2 ELSE 0 END) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT qid, id, round(score, 6) AS score, rank, true AS under_quarter FROM r WHERE rank <= 5 AND score >= 0.5""")
def q_cells(spark, sf_dir):
    """J10 by cells: the embeddings, moved apart into sixteen groups, against every fiftieth
    of them; exact, and less than a quarter of the (query, cell) pairs are compared."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: x.cast("double") + F.when(
        i == F.col("vec_id") % 16, 2.0).otherwise(0.0)).alias("embedding"))
    found = SG.cosine_topk_cells(e, e.where("vec_id % 50 = 0"), k=5, threshold=0.5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    return found.result.select("qid", "id", F.round("score", 6).alias("score"), "rank",
                               F.lit(found.share_read() < 0.25).alias("under_quarter"))


@register("j9_signature_vectors", r"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents),
b AS (SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS bucket, count(*) AS tf FROM t WHERE word <> '' GROUP BY ALL),
f AS (SELECT bucket, count(*) AS df FROM b GROUP BY bucket), n AS (SELECT count(DISTINCT id) AS n FROM b),
r AS (SELECT id, bucket, tf * ln((n + 1.0) / df) AS w FROM b JOIN f USING (bucket), n),
v AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r),
p AS (SELECT a.id AS file_id, c.id, sum(a.w * c.w) AS score FROM v a JOIN v c ON a.bucket = c.bucket AND a.id <> c.id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM p WHERE score >= 0.85 - 1e-9)
SELECT file_id, id, round(score, 6) AS score, rank FROM k WHERE rank <= 5""")
def q_signature_vectors(spark, sf_dir):
    """J9 and J10 on sparse vectors: every document as a signature text against all others,
    the five nearest at 0.85 or more."""
    terms = VE.text_buckets(table(spark, sf_dir, "documents"), "doc_id", "text", packed=True)
    best = VE.cosine_best(terms, SG.SIMILARITY_THRESHOLD)
    return best.select("file_id", "id", F.round("score", 6).alias("score"), "rank")


#: Order of the rows of each driver table, by its key.
TABLE_ORDER = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
               "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "events": "event_id",
               "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
               "labels": "doc_id", "conversations": "conv_id, turn"}


def _signature_sql():
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{t}') "
        f"AS n_columns, count(*) AS row_count, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT "
        f"{order.split(', ')[0]} AS v FROM {t} ORDER BY {order} LIMIT 5)) AS first_keys, "
        f"'Total Rows: ' || count(*) AS last_line FROM {t}" for t, order in TABLE_ORDER.items())


@register("j7_signature_facts", _signature_sql())
def q_signatures(spark, sf_dir):
    """J7 + J8: a signature per driver table (columns, types, five JSON samples in key order,
    row count) and its text; compared are the row count, the samples' keys and the text's
    last line."""
    from sheaf.functions.types import spark_to_sql_type
    out = None
    for t, order in TABLE_ORDER.items():
        df = table(spark, sf_dir, t)
        types = {f.name: spark_to_sql_type(f.dataType) for f in df.schema.fields}
        s = SG.build_signature(df.withColumn("_row", F.struct(*order.split(", "))), t, types)
        s = s.join(SG.signature_text(s), "table_name").withColumn("keys", F.transform(
            "sample_rows", lambda r: F.get_json_object(r, f"$.{order.split(', ')[0]}")))  # noqa: B023
        out = s if out is None else out.unionByName(s)
    return out.select("table_name", F.size("columns").cast("int").alias("n_columns"), "row_count",
                      F.array_join("keys", ",").alias("first_keys"),
                      F.element_at(F.split("text", "\n"), -1).alias("last_line"))
