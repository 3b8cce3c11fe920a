"""Similarity and schema-comparison queries (J1-J3, J5, M1-M4) in the scale form:
documents are tables, their distinct word tokens are columns; benchmark passages
are the incoming files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import schema as SC
from sheaf.operators import similarity as S
from sheaf.plans.registry import register
from sheaf.session import keep, table

SPLIT = r"[^\p{L}\p{N}_]+"
TOKENS_SQL = f"""
dt AS (SELECT DISTINCT doc_id AS set_id, t AS col
       FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS t FROM documents) WHERE t <> ''),
bt AS (SELECT DISTINCT item_id AS set_id, t AS col
       FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS t FROM benchmark) WHERE t <> '')"""


def doc_sets(spark, sf_dir, packed=False):
    return S.text_column_sets(table(spark, sf_dir, "documents"), "doc_id", "text", packed)


def bench_sets(spark, sf_dir):
    return S.text_column_sets(table(spark, sf_dir, "benchmark"), "item_id", "text")


@register("j1_column_idf", f"""
WITH {TOKENS_SQL},
n AS (SELECT count(DISTINCT set_id) AS n FROM dt)
SELECT col, count(*) AS df, round(ln(max(n.n) * 1.0 / count(*)) + 1, 6) AS idf FROM dt, n GROUP BY col""")
def q_idf(spark, sf_dir):
    """Column IDF over every document (tokens as columns)."""
    idf = S.column_idf(doc_sets(spark, sf_dir))
    return idf.select("col", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


J2_SQL = f"""
WITH {TOKENS_SQL},
n AS (SELECT count(DISTINCT set_id) + 1.0 AS n FROM dt),
dfc AS (SELECT col, count(*) AS df FROM dt GROUP BY col),
pairs AS (SELECT q.set_id AS new_id, d.set_id AS table_id, count(*) AS matched
          FROM bt q JOIN dt d USING (col) GROUP BY ALL HAVING count(*) >= 3),
-- weights under each new file's own corpus (catalog + that file), summed directly
wq AS (SELECT q.set_id AS new_id, sum(ln(n.n / (coalesce(dfc.df, 0) + 1)) + 1) AS wq
       FROM bt q LEFT JOIN dfc USING (col), n GROUP BY ALL),
wb AS (SELECT p.new_id, p.table_id,
              sum(ln(n.n / (dfc.df + CASE WHEN q.col IS NULL THEN 0 ELSE 1 END)) + 1) AS wb,
              sum(CASE WHEN q.col IS NULL THEN 0 ELSE ln(n.n / (dfc.df + 1)) + 1 END) AS mw
       FROM pairs p JOIN dt d ON d.set_id = p.table_id JOIN dfc ON dfc.col = d.col
            LEFT JOIN bt q ON q.set_id = p.new_id AND q.col = d.col, n GROUP BY ALL),
scored AS (SELECT p.new_id, p.table_id, p.matched, 2 * wb.mw / (wq.wq + wb.wb) AS score
           FROM pairs p JOIN wb USING (new_id, table_id) JOIN wq USING (new_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, table_id) AS rank
           FROM scored WHERE score >= 0.55)"""


@register("j2_weighted_dice_topk", J2_SQL + """
SELECT new_id, table_id, matched, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def q_dice(spark, sf_dir):
    """For every benchmark passage (incoming file), the top-5 documents
    (catalog tables) by IDF-weighted Dice >= 0.55 with >= 3 shared columns."""
    r = S.weighted_dice_topk(keep(bench_sets(spark, sf_dir)), keep(doc_sets(spark, sf_dir)))     # read several times, tokenised once
    return r.select("new_id", "table_id", F.col("matched").cast("long").alias("matched"),
                    F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


J2ALL_SQL = f"""
WITH {TOKENS_SQL},
n AS (SELECT count(DISTINCT set_id) * 1.0 AS n FROM dt),
idf AS (SELECT col, ln(max(n.n) / count(*)) + 1 AS idf FROM dt, n GROUP BY col),
w AS (SELECT set_id, col, idf FROM dt JOIN idf USING (col)),
tot AS (SELECT set_id, sum(idf) AS W FROM w GROUP BY 1),
pair AS (SELECT a.set_id AS new_id, b.set_id AS table_id, count(*) AS matched, sum(a.idf) AS mw
         FROM w a JOIN dt b ON a.col = b.col AND a.set_id <> b.set_id GROUP BY ALL HAVING count(*) >= 3),
scored AS (SELECT new_id, table_id, matched, 2 * mw / (ta.W + tb.W) AS score
           FROM pair JOIN tot ta ON ta.set_id = new_id JOIN tot tb ON tb.set_id = table_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(score, 9) DESC, table_id) AS rank
           FROM scored WHERE score >= 0.55)
SELECT new_id, table_id, matched, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""


@register("j2_dice_topk_all_documents", J2ALL_SQL)
def q_dice_all(spark, sf_dir):
    """J2 batch form: every document against every other document (near copies
    find each other); exact via prefix filtering."""
    r = S.weighted_dice_self_topk(doc_sets(spark, sf_dir, packed=True))
    return r.select("new_id", "table_id", F.col("matched").cast("long").alias("matched"),
                    F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register("j3_peer_containment", f"""
WITH {TOKENS_SQL},
n AS (SELECT count(DISTINCT set_id) * 1.0 AS n FROM dt),
idf AS (SELECT col, ln(max(n.n) / count(*)) + 1 AS idf FROM dt, n GROUP BY col),
w AS (SELECT set_id, col, idf FROM dt JOIN idf USING (col)),
wp AS (SELECT set_id AS peer_id, sum(idf) AS wp FROM w GROUP BY 1),
pair AS (SELECT a.set_id, b.set_id AS peer_id, sum(b.idf) AS mw
         FROM dt a JOIN w b ON a.col = b.col AND a.set_id <> b.set_id GROUP BY ALL),
scored AS (SELECT set_id, peer_id, mw / wp AS score FROM pair JOIN wp USING (peer_id) WHERE mw / wp >= 0.55),
best AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 9) DESC, peer_id) AS r FROM scored)
SELECT set_id, peer_id, round(score, 6) AS score, score >= 0.9 AS auto_accept FROM best WHERE r = 1""")
def q_peer(spark, sf_dir):
    """J3 + D4 auto-accept: every document's best peer by IDF-weighted containment."""
    r = S.peer_containment(doc_sets(spark, sf_dir, packed=True))
    return r.select("set_id", "peer_id", F.round("score", 6).alias("score"), "auto_accept")


@register("j5_near_duplicate_pairs", f"""
WITH {TOKENS_SQL},
sz AS (SELECT set_id, count(*) AS n FROM dt GROUP BY 1),
inter AS (SELECT a.set_id AS a, b.set_id AS b, count(*) AS i FROM dt a JOIN dt b ON a.col = b.col AND a.set_id < b.set_id
          GROUP BY ALL)
SELECT a, b, round(i * 1.0 / (sa.n + sb.n - i), 6) AS jaccard
FROM inter JOIN sz sa ON sa.set_id = a JOIN sz sb ON sb.set_id = b WHERE i * 1.0 / (sa.n + sb.n - i) >= 0.9""")
def q_jaccard(spark, sf_dir):
    """J5 candidate edges: every document pair with token Jaccard >= 0.90. Pairs are found
    between different token sets and written out for all documents of a set at the end."""
    r = S.all_pairs(*S.jaccard_links(doc_sets(spark, sf_dir)))
    return r.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("j5_j6_greedy_groups", f"""
WITH RECURSIVE {TOKENS_SQL},
sz AS (SELECT set_id, count(*) AS n FROM dt GROUP BY 1),
inter AS (SELECT a.set_id AS a, b.set_id AS b, count(*) AS i FROM dt a JOIN dt b ON a.col = b.col AND a.set_id < b.set_id
          GROUP BY ALL),
e AS (SELECT a, b FROM inter JOIN sz sa ON sa.set_id = a JOIN sz sb ON sb.set_id = b
      WHERE i * 1.0 / (sa.n + sb.n - i) >= 0.9),
nodes AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k, lang || '_' || source AS t,
                 coalesce((SELECT list(a) FROM e WHERE e.b = doc_id), []) AS earlier FROM documents),
walk AS (SELECT k, id, t, CAST([id] AS BIGINT[]) AS anchors, id AS anchor FROM nodes WHERE k = 1
  UNION ALL
  SELECT k, id, t, CASE WHEN len(near) = 0 THEN list_append(anchors, id) ELSE anchors END,
         CASE WHEN len(near) = 0 THEN id ELSE list_min(near) END
  FROM (SELECT n.k, n.id, n.t, w.anchors, list_intersect(n.earlier, w.anchors) AS near
        FROM walk w JOIN nodes n ON n.k = w.k + 1))
SELECT w.id AS job_id, w.anchor AS anchor_id, CASE WHEN w.id = w.anchor THEN 'anchor' ELSE 'member' END AS group_role,
       w.id <> w.anchor AS is_incremental_load, CASE WHEN w.id <> w.anchor THEN a.t END AS matched_table_name
FROM walk w JOIN nodes a ON a.id = w.anchor""")
def q_groups(spark, sf_dir):
    """J5 + J6: oldest-first grouping of documents (ordered by id) at Jaccard >= 0.90, then
    the members become increments of their anchor's table. The oracle walks the documents
    one after the other."""
    docs = table(spark, sf_dir, "documents")
    classes, links = S.jaccard_links(doc_sets(spark, sf_dir))
    nodes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
    jobs = docs.select(F.col("doc_id").alias("job_id"), F.concat_ws("_", "lang", "source").alias("proposed_table_name"),
                       F.lit(False).alias("is_incremental_load"), F.lit(None).cast("string").alias("matched_table_name"))
    return S.regroup(jobs, S.greedy_class_groups(nodes, classes, links)).select(
        "job_id", "anchor_id", "group_role", "is_incremental_load", "matched_table_name")


@register("m1_m4_schema_diff", J2_SQL + """,
top AS (SELECT new_id, table_id FROM ranked WHERE rank = 1),
ex AS (SELECT top.new_id, top.table_id, count(*) AS n_existing FROM top JOIN dt ON dt.set_id = top.table_id GROUP BY ALL),
nw AS (SELECT top.new_id, count(*) AS n_new FROM top JOIN bt ON bt.set_id = top.new_id GROUP BY ALL),
mt AS (SELECT top.new_id, count(*) AS n_matching FROM top JOIN bt ON bt.set_id = top.new_id
       JOIN dt ON dt.set_id = top.table_id AND dt.col = bt.col GROUP BY ALL)
SELECT ex.new_id, ex.table_id, n_existing - n_matching AS n_missing, n_new - n_matching AS n_extra, n_matching,
       round(n_matching * 100.0 / n_existing, 2) AS match_pct,
       (n_existing = n_matching AND n_new = n_matching) AS is_compatible,
       (n_existing = n_matching) AS is_additive
FROM ex JOIN nw USING (new_id) JOIN mt USING (new_id)""")
def q_schema_diff(spark, sf_dir):
    """M1-M4 for every incoming passage against its best J2 match: missing /
    extra / matching column counts, match %, compatibility flags."""
    new, cat = keep(bench_sets(spark, sf_dir)), keep(doc_sets(spark, sf_dir))
    top = S.weighted_dice_topk(new, cat).where(F.col("rank") == 1).select("new_id", "table_id")
    d = SC.column_set_diff(top, new, cat)
    return d.select("new_id", "table_id", "n_missing", "n_extra", "n_matching", "match_pct",
                    "is_compatible", "is_additive")


@register("j4_name_similarity", "WITH j AS (" + J2ALL_SQL + """),
nm AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(trim(lang || '_' || source)), '_'),
                                                lambda t: t <> '')) AS toks FROM documents)
SELECT j.new_id, j.table_id,
       round(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0
                  ELSE len(list_intersect(a.toks, b.toks)) * 1.0 / len(list_distinct(list_concat(a.toks, b.toks)))
             END, 6) AS name_similarity
FROM j JOIN nm a ON a.doc_id = j.new_id JOIN nm b ON b.doc_id = j.table_id""")
def q_name_sim(spark, sf_dir):
    """Table-name Jaccard (``_`` tokens of ``<lang>_<source>``) for every J2
    document pair -- the evidence the structural override (D3) weighs."""
    from sheaf.functions.names import name_jaccard
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", "source").alias("nm"))
    pairs = S.weighted_dice_self_topk(doc_sets(spark, sf_dir, packed=True)).select("new_id", "table_id")
    j = (pairs.join(docs.select(F.col("doc_id").alias("new_id"), F.col("nm").alias("a")), "new_id")
         .join(docs.select(F.col("doc_id").alias("table_id"), F.col("nm").alias("b")), "table_id"))
    return j.select("new_id", "table_id", F.round(name_jaccard("a", "b"), 6).alias("name_similarity"))
