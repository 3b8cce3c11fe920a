"""The registered queries: each applies one operator, with production parameters, to its
whole table, and derives the result columns from the operator's own output."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, conversations, decontaminate, divergence, license_scan, line_dedup, quality, simhash, token_files, topk, toxicity, url_filter, warc
from sheaf.llm.common import read
from sheaf.llm.labelled import held_out
from sheaf.llm.registry import ORACLES, QUERIES, register  # noqa: F401
from sheaf.session import ensure_checkpoint_dir

#: The production url rules (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


@register("op1_url_filter", """
    WITH u AS (
      SELECT page_id,
             CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3),
                  '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3),
                  '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
      ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
    SELECT page_id, host, path,
           (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS rule,
           coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            ORDER BY length(h) DESC, length(p) DESC LIMIT 1), 'allow') AS verdict
    FROM u""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_frame(spark, URL_RULES)
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)


@register("op10_exact_topk", """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id)::INTEGER AS rank
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def token_digests(docs: DataFrame) -> DataFrame:
    both = bpe.round_trip(docs.select("doc_id", "text"), vocabulary())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))


@register("op3_line_dedup", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(len(string_split(text, chr(10))))) AS raw FROM documents),
    n AS (SELECT doc_id, raw, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l WHERE t <> ''),
    c AS (SELECT doc_id, raw, t, row_number() OVER w - 1 AS pos,
                 len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS words, sum(words) OVER w AS upto
          FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY raw)),
    p AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos <= b.pos
            AND b.upto - a.upto + a.words >= 50 AND b.pos - a.pos < 50),
    runs AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s
             UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
    told AS (SELECT r.doc_id, r.s, r.e, string_agg(c.t, chr(10) ORDER BY c.pos) AS content
             FROM runs r JOIN c ON r.doc_id = c.doc_id AND c.pos BETWEEN r.s AND r.e GROUP BY ALL),
    copies AS (SELECT doc_id, s, e FROM told QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
    gone AS (SELECT DISTINCT c.doc_id, c.pos, c.raw FROM copies k JOIN c ON k.doc_id = c.doc_id AND c.pos BETWEEN k.s AND k.e),
    spans AS (SELECT doc_id, min(raw) AS a, max(raw) AS b, count(*) AS lines
              FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone)
              GROUP BY doc_id, island),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY raw) AS text FROM l
             WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = l.doc_id AND l.raw BETWEEN s.a AND s.b)
             GROUP BY doc_id),
    tally AS (SELECT doc_id, sum(lines)::BIGINT AS lines_removed, count(*) AS spans_removed FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(lines_removed, 0) AS lines_removed, coalesce(spans_removed, 0) AS spans_removed,
           md5(coalesce(k.text, '')) AS text_md5
    FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN tally USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return edited.select("doc_id", "lines_removed", "spans_removed",
                         F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@register("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Scorer:
    return toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))


@register("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return (quality.score_quality(docs, model, threshold=0.7)
            .select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted"))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, sf_dir, docs)
    return (toxicity.score_toxicity(docs, model, threshold=0.5)
            .select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted"))


#: Notices that license scans look for (name, text).
LICENSE_NOTICES = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so"),
]


@register("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = spark.createDataFrame(LICENSE_NOTICES, "name string, text string")
    return license_scan.scan(read(spark, sf_dir, "documents"), notices)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records that follow from the pages: each page is a full response, every
    tenth is fetched again later with other content, and each is revisited later under a
    variant of its url, most with the page's own validators, some with others or none."""
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
                     F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    tag = lambda d: F.concat(F.lit('"'), F.substring(d, 1, 16), F.lit('"'))
    again = F.md5(F.concat("digest", F.lit("+")))

    def response(n: int, later: int, digest) -> Column:
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag(digest),
                               F.lit("Content-Length"), text(F.col("size")), F.lit("Date"), text(i + later))
        return F.struct((i * 3 + n).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"),
                        (i + later).alias("ts"), F.lit(200).alias("status"), headers.alias("headers"),
                        digest.alias("payload_digest"))

    own = F.when(i % 7 == 0, F.lit('"other"')).when(i % 3 == 0, F.concat(F.lit("W/"), tag(F.col("digest")))).otherwise(tag(F.col("digest")))
    seen = F.create_map(F.lit("etag"), F.when(i % 11 != 0, own), F.lit("Content-Length"), F.lit("0"),
                        F.lit("date"), text(i + 1000), F.lit("Cache-Control"), F.lit("max-age=60"))
    revisit = F.struct((i * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"),
                       (i + 1000).alias("ts"), F.lit(304).alias("status"), seen.alias("headers"),
                       F.lit(None).cast("string").alias("payload_digest"))
    made = F.array(response(0, 0, F.col("digest")), F.when(i % 10 == 0, response(1, 500, again)), revisit)
    return p.select(F.inline(F.filter(made, lambda r: r.isNotNull())))


@register("op6_warc_revisits", r"""
    WITH p AS (SELECT page_id AS i, url, md5(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS size FROM pages),
    r AS (SELECT i * 3 AS id, i AS ts, url, d, size FROM p
          UNION ALL SELECT i * 3 + 1, i + 500, url, md5(d || '+'), size FROM p WHERE i % 10 = 0),
    v AS (SELECT i * 3 + 2 AS id, i + 1000 AS ts, url, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN '"other"'
                 ELSE '"' || substr(d, 1, 16) || '"' END AS tag FROM p),
    cut AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
            FROM p),
    k AS (SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
                 || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
                 list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
                                       lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q FROM cut),
    c AS (SELECT url, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
    s AS (SELECT v.id, v.ts, c.url_key, v.tag,
                 (SELECT max_by({'id': r.id, 'ts': r.ts, 'd': r.d, 'size': r.size}, (r.ts, r.id))
                  FROM r JOIN c rc ON r.url = rc.url WHERE rc.url_key = c.url_key AND r.ts < v.ts) AS o
          FROM v JOIN c ON v.url = c.url),
    t AS (SELECT *, CASE WHEN o IS NULL THEN 'no_response' WHEN tag IS NULL THEN 'no_validator'
                         WHEN tag = '"' || substr(o.d, 1, 16) || '"' THEN 'resolved' ELSE 'mismatch' END AS outcome FROM s)
    SELECT id AS record_id, url_key, ts, outcome,
           CASE WHEN outcome = 'resolved' THEN o.id::VARCHAR END AS refers_to,
           CASE WHEN outcome = 'resolved' THEN o.ts::VARCHAR END AS refers_to_ts,
           CASE WHEN outcome = 'resolved' THEN o.d END AS payload_digest,
           CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || o.size || chr(10)
             || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: '
             || CASE WHEN ((id - 2) // 3) % 3 = 0 THEN 'W/' ELSE '' END || tag END AS headers
    FROM t""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(captures(read(spark, sf_dir, "pages")))
    return (resolved.withColumn("headers", warc.header_text(F.col("headers")))
            .withColumn("refers_to", F.col("refers_to").cast("string"))
            .withColumn("refers_to_ts", F.col("refers_to_ts").cast("string")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that follow from a checksum of conversation and turn;
    ``copies`` says how often a row stands there (0: it was dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


@register("op11_conversation_repair", r"""
    WITH RECURSIVE
    bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    keyed AS (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                       lambda x: ord(x)::BIGINT) AS b FROM conversations),
    kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d
              FROM keyed, bits),
    rows_ AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
    numbered AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows_),
    faults AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS x,
                 CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    -- o, s, u, a: cheapest way to the state in which nothing, a system, user or assistant turn stands last
    -- (u, a: insertions after the row included)
    walk AS (
      SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'e': '', 't': ''} AS o, NULL::STRUCT(c INTEGER, e VARCHAR, t VARCHAR) AS s,
             {'c': 3, 'e': 'I', 't': chr(10) || 'user:'} AS u, {'c': 6, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i, o, s, u, list_min([a, {'c': u.c + 3, 'e': u.e || 'I', 't': u.t || chr(10) || 'assistant:'}])
      FROM (SELECT conv_id, i, o, s, a, list_min([u, CASE WHEN o.c IS NOT NULL THEN {'c': o.c + 3, 'e': o.e || 'I', 't': o.t || chr(10) || 'user:'} END,
                CASE WHEN s.c IS NOT NULL THEN {'c': s.c + 3, 'e': s.e || 'I', 't': s.t || chr(10) || 'user:'} END,
                CASE WHEN a.c IS NOT NULL THEN {'c': a.c + 3, 'e': a.e || 'I', 't': a.t || chr(10) || 'user:'} END]) AS u
        FROM (SELECT w.conv_id, r.i,
            {'c': w.o.c + 4, 'e': w.o.e || 'D', 't': w.o.t} AS o,
            list_min([CASE WHEN w.s.c IS NOT NULL THEN {'c': w.s.c + 4, 'e': w.s.e || 'D', 't': w.s.t} END,
                      CASE WHEN f NOT IN ('b', 'd') AND x = 's' THEN {'c': w.o.c + k, 'e': w.o.e || 'K', 't': w.o.t || chr(10) || role || ':' || text} END]) AS s,
            list_min(list_concat([{'c': w.u.c + 4, 'e': w.u.e || 'D', 't': w.u.t}],
              CASE WHEN f IN ('b', 'd') THEN [] ELSE flatten(list_transform(list_filter([w.o, w.s, w.a], lambda p: p.c IS NOT NULL), lambda p:
                [{'c': p.c + k + 3, 'e': p.e || 'R', 't': p.t || chr(10) || 'user:' || text},
                 CASE WHEN x = 'u' THEN {'c': p.c + k, 'e': p.e || 'K', 't': p.t || chr(10) || role || ':' || text} END])) END)) AS u,
            list_min(list_concat([{'c': w.a.c + 4, 'e': w.a.e || 'D', 't': w.a.t}],
              CASE WHEN f IN ('b', 'd') THEN [] ELSE
                [{'c': w.u.c + k + 3, 'e': w.u.e || 'R', 't': w.u.t || chr(10) || 'assistant:' || text},
                 CASE WHEN x = 'a' THEN {'c': w.u.c + k, 'e': w.u.e || 'K', 't': w.u.t || chr(10) || role || ':' || text} END] END)) AS a
          FROM walk w JOIN (SELECT *, CASE f WHEN 't' THEN 3 ELSE 0 END AS k FROM faults) r
            ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
    ends AS (SELECT conv_id, list_min([o, a]) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.e AS audit,
           sha256(substr(best.t, 2)) AS repaired_sha256
    FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    done = conversations.repair(rows, F.col("copies"))
    told = done.digests().select(F.col("conv_id").alias("_c"), F.col("sha256").alias("repaired_sha256"))
    return done.audit.join(told, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


@register("op13_source_divergence", r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT row, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
    n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
            1 + (1000000000 * (coalesce(c.c, 0) + 5)::HUGEINT) // (n.n + 5 * v.v) AS p,
            1 + (1000000000 * (k.c + 5)::HUGEINT) // (v.n + 5 * v.v) AS q
          FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
              LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL)
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT,
           row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER AS rank
    FROM p WHERE c > 0 AND p > q QUALIFY rank <= 50""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@register("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheaf-tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, word_tokenizer(), end_id=1)
    return token_files.read_tokens(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
