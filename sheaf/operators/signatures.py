"""Table signatures and vector search.

* J7/J8: a signature (columns, types, first rows, row count) and its text form.
* J9: the text is vectorised locally (no remote model): hashed token counts,
  IDF-weighted, L2-normalised -- or vectors supplied by the user.
* J10: exact cosine top-k >= threshold for a *batch* of query vectors: query blocks and
  corpus shards of bounded size meet in groups (one matrix product each), which keep a
  local top-k that is merged per query. For large corpora, the same rows by k-means cells
  that an exact bound rules out.
* J11/J12: the signature store is a store table; backfill = left-anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.names import normalize_for_similarity
from sheaf.session import cut_lineage

# ---- fixed values ------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.85
SIMILARITY_TOP_K = 5
SAMPLE_ROWS = 5
SAMPLE_FIELDS = 5
MONTH_SUFFIX_RE = r"_(?:dec|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov)\d*_?\d*$"
# ------------------------------------------------------------------------------

SIGNATURE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("column_types", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sample_rows", T.ArrayType(T.StringType())), T.StructField("row_count", T.LongType())])


def build_signature(df: DataFrame, table_name: str, column_types: dict[str, str],
                    order_col: str | None = "_row") -> DataFrame:
    """One-row signature. Samples are the first 5 rows (by ``order_col``) as JSON
    (bounded: a top-5), the count is one aggregate."""
    cols = [c for c in df.columns if not c.startswith("_")]
    ordered = df.orderBy(order_col) if order_col and order_col in df.columns else df
    head = ordered.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]),
                                    options={"ignoreNullFields": "false"}).alias("j")).limit(SAMPLE_ROWS)
    samples = head.agg(F.collect_list("j").alias("sample_rows"))
    cnt = df.agg(F.count(F.lit(1)).alias("row_count"))
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(column_types.get(c, "UNKNOWN")))])
    both = samples.select("sample_rows", F.lit(None).cast("long").alias("row_count")).unionByName(
        cnt.select(F.lit(None).cast("array<string>").alias("sample_rows"), F.col("row_count").cast("long")))
    return (both
            .agg(F.first("sample_rows", ignorenulls=True).alias("sample_rows"),
                 F.first("row_count", ignorenulls=True).alias("row_count"))
            .select(F.lit(table_name).alias("table_name"), F.array(*[F.lit(c) for c in cols]).alias("columns"),
                    types.alias("column_types"), "sample_rows", F.col("row_count").cast("long")))


def signature_text(signatures: DataFrame) -> DataFrame:
    """``(table_name, text)`` of signature rows: base name without month suffix, the
    H5 names with their types, the first fields of each sample row, the row count."""
    base = F.regexp_replace(F.lower("table_name"), MONTH_SUFFIX_RE, "")
    base = F.when(base == "", F.col("table_name")).otherwise(base)
    names = F.transform("columns", lambda c: F.concat(
        F.lit("  - "), normalize_for_similarity(c), F.lit(": "), F.coalesce(F.col("column_types")[c], F.lit("UNKNOWN"))))
    fields = lambda r: F.slice(F.map_entries(F.from_json(r, "map<string,string>")), 1, SAMPLE_FIELDS)
    pairs = lambda r: F.array_join(F.transform(fields(r), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ", ")
    rows = F.transform("sample_rows", lambda r, i: F.concat(
        F.lit("  Row "), (i + 1).cast("string"), F.lit(": "), pairs(r)))
    text = F.array_join(F.concat(
        F.array(F.concat(F.lit("Table: "), base), F.format_string("Columns (%d):", F.size("columns"))), names,
        F.array(F.format_string("Sample Data (%d rows):", F.size("sample_rows"))), rows,
        F.array(F.format_string("Total Rows: %d", "row_count"))), "\n")
    return signatures.select("table_name", text.alias("text"))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """J9 (local): tokens -> ``xxhash64 % dim`` buckets, counts weighted by IDF over
    the documents, L2-normalised dense ``array<float>``. All joins and aggregates."""
    toks = (docs.select(F.col(id_col).alias("id"),
                        F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+")).alias("t"))
            .where(F.col("t") != ""))
    tf = toks.groupBy("id", "t").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    dfs = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    w = (tf.join(dfs, "t").withColumn("h", F.pmod(F.xxhash64("t"), F.lit(dim)).cast("int"))
         .withColumn("w", F.col("tf") * (F.log(F.lit(float(n)) / F.col("df")) + 1)))
    cell = w.groupBy("id", "h").agg(F.sum("w").alias("w"))
    vec = cell.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("m"))
    dense = vec.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                         lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return dense.select(F.col("id").alias(id_col),
                        F.transform("v", lambda x: (x / norm).cast("float")).alias("embedding"))


SHARD_ROWS = 8192       # corpus vectors compared in one group
BLOCK_ROWS = 4096       # query vectors compared in one group


def _best_of_shard(corpus: pd.DataFrame, queries: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """Cosine of one query block with one corpus shard; the best k per query."""
    out = pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(corpus) or not len(queries):
        return out
    corpus = corpus.sort_values("id")
    unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (
        np.array(f.tolist(), np.float64) for f in (queries["q_v"], corpus["v"]))]
    qid, ids = queries["qid"].to_numpy(np.int64), corpus["id"].to_numpy(np.int64)
    score = unit[0] @ unit[1].T
    if exclude_self:
        score[qid[:, None] == ids[None, :]] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(score, top, axis=1)
    ok = np.isfinite(best)
    return pd.DataFrame({"qid": np.repeat(qid, top.shape[1]).reshape(top.shape)[ok], "id": ids[top][ok], "score": best[ok]})


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = SIMILARITY_TOP_K,
                threshold: float | None = SIMILARITY_THRESHOLD, corpus_id: str = "id",
                query_id: str = "qid", vec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k (then >= threshold), descending, per query. Query blocks
    meet corpus shards in groups of bounded size, and the best k of each group are merged;
    neither side passes through the driver."""
    shards = max(1, -(-corpus.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(vec_col).alias("v")).select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "id", "v")
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vec_col).alias("q_v")).select(
        every(shards).alias("q_shard"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("q_block"), "qid", "q_v")
    near = c.groupBy("shard", "block").cogroup(q.groupBy("q_shard", "q_block")).applyInPandas(
        lambda a, b: _best_of_shard(a, b, k, exclude_self), "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    out = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.select("qid", "id", "score", F.col("rank").cast("int"))


MAX_CELLS = 4096        # centroids are compared with every query, so their number is bounded
CELL_SAMPLE = 100_000   # vectors that the cells are fitted on; all vectors are assigned
_SLACK = 1e-9           # rounding of cosines


@dataclass
class CellSearch:
    """``result`` as of ``cosine_topk``. ``probes``: (qid, cell, round) that were compared.
    ``cells``: (cell, n, centroid, angle) of the corpus."""

    result: DataFrame
    probes: DataFrame
    cells: DataFrame

    def share_read(self) -> float:
        """Share of all (query, cell) pairs that were compared."""
        every = self.cells.count() * self.probes.select("qid").distinct().count()
        return self.probes.count() / every if every else 0.0


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_topk_cells(corpus: DataFrame, queries: DataFrame, k: int = SIMILARITY_TOP_K, threshold: float | None = SIMILARITY_THRESHOLD,
                      corpus_id: str = "id", query_id: str = "qid", vec_col: str = "embedding", exclude_self: bool = False,
                      seed: int = 7) -> CellSearch:
    """J10 for large corpora: the same rows as ``cosine_topk``, without comparing every
    query with every vector. Vectors are grouped into cells by k-means (fitted on a bounded
    sample, all vectors assigned); a cell knows its centroid and the widest angle of a
    member to it. No member of a cell can be nearer to a query than the angle to the
    centroid less that angle, so after a first round over the cells that look best (those
    that hold at least k vectors) every cell whose bound is below the k-th score of the
    query is skipped, and the rest are compared in a second round. Crowded cells are cut
    into shards, and queries of a cell into blocks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    c = cut_lineage(corpus.select(F.col(corpus_id).cast("long").alias("id"), _unit(F.col(vec_col)).alias("v")).where("v IS NOT NULL"))
    q = cut_lineage(queries.select(F.col(query_id).cast("long").alias("qid"), _unit(F.col(vec_col)).alias("q_v")).where("q_v IS NOT NULL"))
    total = c.count()
    if not total:
        none = spark.createDataFrame([], "qid long, id long, score double, rank int")
        return CellSearch(none, spark.createDataFrame([], "qid long, cell int, round int"),
                          spark.createDataFrame([], "cell int, n long, centroid array<double>, angle double"))
    n_cells = max(2, min(MAX_CELLS, round(total ** 0.5)))
    as_vector = array_to_vector("v").alias("features")
    sample = c.orderBy(F.xxhash64("id", "v")).limit(CELL_SAMPLE) if total > CELL_SAMPLE else c
    low, high = sample.agg(F.min("v"), F.max("v")).first()
    if low == high:     # k-means needs two different vectors
        centers, assigned = [list(low)], c.withColumn("cell", F.lit(0))
    else:
        model = KMeans(k=n_cells, seed=seed, maxIter=8).fit(sample.select(as_vector))
        centers = [[float(x) / max(float(np.linalg.norm(m)), 1e-300) for x in m] for m in model.clusterCenters()]
        assigned = model.transform(c.select("id", "v", as_vector)).select("id", "v", F.col("prediction").alias("cell"))
    shared = spark.sparkContext.broadcast(np.array(centers))     # at most MAX_CELLS rows
    known = spark.createDataFrame(list(enumerate(centers)), "cell int, centroid array<double>")
    angle = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b))))
    c = cut_lineage(assigned)
    cells = cut_lineage(c.join(F.broadcast(known), "cell").groupBy("cell").agg(
        F.count("*").alias("n"), F.first("centroid").alias("centroid"), F.max(angle(F.col("v"), F.col("centroid"))).alias("angle")))
    facts = {r.cell: (r.n, r.angle) for r in cells.select("cell", "n", "angle").collect()}     # at most MAX_CELLS rows

    def bounds(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and the best cosine that each could hold, per query."""
        ids = np.array(sorted(facts))
        far = np.arccos(np.clip(vectors @ shared.value[ids].T, -1, 1))
        return ids, np.cos(np.maximum(0.0, far - np.array([facts[i][1] for i in ids])[None, :])) + _SLACK

    def first_round(batches):
        """Per query the cells of the best bounds, until they hold k vectors besides the query."""
        for b in (x for x in batches if len(x)):
            ids, best = bounds(np.array(b["q_v"].tolist()))
            held = np.array([facts[i][0] for i in ids])
            order = np.argsort(-best, axis=1, kind="stable")
            need = (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1) + 1
            take = np.arange(len(ids))[None, :] < need[:, None]
            yield pd.DataFrame({"qid": np.repeat(b["qid"].to_numpy(), take.sum(axis=1)), "cell": ids[order[take]]})

    def second_round(batches):
        """Per query the cells that may hold a vector at or above its k-th score."""
        for b in (x for x in batches if len(x)):
            ids, best = bounds(np.array(b["q_v"].tolist()))
            rows, cols = np.nonzero(best >= b["kth"].fillna(-2.0).to_numpy()[:, None])
            yield pd.DataFrame({"qid": b["qid"].to_numpy()[rows], "cell": ids[cols]})

    def compare(probes: DataFrame) -> DataFrame:
        shards = (F.col("n") / SHARD_ROWS).cast("int") + 1
        sized = cells.select("cell", shards.alias("_shards"))
        side = (c.join(F.broadcast(sized), "cell").select(
            "cell", F.pmod(F.xxhash64("id"), F.col("_shards")).cast("int").alias("shard"), "id", "v"))
        asked = probes.groupBy("cell").agg(((F.count("*") / BLOCK_ROWS).cast("int") + 1).alias("_blocks"))     # at most MAX_CELLS rows
        side = side.join(F.broadcast(asked), "cell").select(
            "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), "id", "v")
        ask = (probes.join(q, "qid").join(F.broadcast(sized), "cell").join(F.broadcast(asked), "cell").select(
            F.col("cell").alias("q_cell"), F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("q_shard"),
            F.pmod(F.xxhash64("qid"), F.col("_blocks")).cast("int").alias("q_block"), "qid", "q_v"))
        near = side.groupBy("cell", "shard", "block").cogroup(ask.groupBy("q_cell", "q_shard", "q_block")).applyInPandas(
            lambda a, b: _best_of_shard(a, b, k, exclude_self), "qid long, id long, score double")
        w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    one = cut_lineage(q.mapInPandas(first_round, "qid long, cell int"))
    best = cut_lineage(compare(one))
    kth = best.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    two = cut_lineage(q.join(kth, "qid", "left").mapInPandas(second_round, "qid long, cell int")
                      .join(one, ["qid", "cell"], "left_anti"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    out = best.drop("rank").unionByName(compare(two).drop("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    probes = one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    return CellSearch(out.select("qid", "id", "score", F.col("rank").cast("int")), probes, cells)


def backfill_candidates(catalog_tables: DataFrame, signatures: DataFrame,
                        exclude=("tables_metadata", "operational_metadata", "load_audit", "signatures")) -> DataFrame:
    """Catalog tables that have no signature yet (left-anti), catalog tables
    themselves excluded."""
    return (catalog_tables.where(~F.col("table_name").isin(*exclude))
            .join(signatures.select("table_name"), "table_name", "left_anti"))
