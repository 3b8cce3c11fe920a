"""Operator 10, exact top-k inner products by Fagin's threshold algorithm.

The corpus is cut into shards of about ``SHARD`` vectors by a hash of the id. A shard
keeps one list per dimension, sorted by that component. For a query the lists are read
side by side, from the high end where the query's component is positive and from the low
end where it is negative. Each vector met is scored in full at once (random access). The
components last read bound the score of all vectors not met yet, so reading stops when
that bound is below the k-th score. The best k of each shard are merged per query.

Queries are cut into blocks of at most ``QUERIES``; a group is one shard with one block,
whatever the size of either table.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors are compared with those of the same length; rows that repeat an id count once
(the smallest vector in array order stays); ties go to the smaller id, so reading goes on
while the bound equals the k-th score; components and scores are exact integers, and any beyond
64 bits are held at its ends; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.common import materialize

SHARD = 8192
QUERIES = 16384
STEP = 32           # list positions read in the first round; doubled each round


class Shard:
    """Sorted per-dimension lists of one shard, and its vectors for random access."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is zero: the smallest ids win
            ids = self.ids[self.ids != own][:k]
            return ids, np.zeros(len(ids), self.vectors.dtype)
        up = query[dims] > 0
        q = query[dims]
        met = np.zeros(n, bool)
        at = int(np.searchsorted(self.ids, own))
        if at < n and self.ids[at] == own:
            met[at] = True
        best_ids = np.zeros(0, np.int64)
        best = np.zeros(0, self.vectors.dtype)
        depth, step = 0, STEP
        while depth < n:
            new_depth = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.lists[dims[~up], depth:new_depth].ravel()] = True
            fresh[self.lists[dims[up], n - new_depth:n - depth].ravel()] = True
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            scores = self.vectors[rows] @ query
            if len(best) == k:
                keep = scores >= best[-1]
                rows, scores = rows[keep], scores[keep]
            ids = np.concatenate([best_ids, self.ids[rows]])
            scores = np.concatenate([best, scores])
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            depth, step = new_depth, step * 2
            edge = np.where(up, self.values[dims, n - depth], self.values[dims, depth - 1])
            if len(best) == k and edge @ q < best[-1]:
                break
        return best_ids, best


def _exact(corpus: np.ndarray, queries: np.ndarray) -> type:
    """The smallest type whose sums of products of these whole numbers are exact."""
    most = [int(max(-int(m.min(initial=0)), int(m.max(initial=0)))) for m in (corpus, queries)]
    bound = most[0] * most[1] * max(1, corpus.shape[1])
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object


def search_group(corpus: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(corpus) or not len(queries):
        return out
    vectors, asked = (np.array(p["vector"].tolist(), np.int64).reshape(len(p), -1) for p in
                      (corpus, queries.rename(columns={"asked": "vector"})))
    kind = _exact(vectors, asked)
    shard = Shard(corpus["vec_id"].to_numpy(np.int64), vectors.astype(kind))
    found = []
    for own, query in zip(queries["query_id"].to_numpy(np.int64), asked.astype(kind)):
        ids, scores = shard.top(query, own, k)
        low, high = -2 ** 63, 2 ** 63 - 1
        found.append(pd.DataFrame({"query_id": np.full(len(ids), own), "vec_id": ids,
                                   "score": np.array([min(high, max(low, int(s))) for s in scores], np.int64)}))
    return pd.concat(found) if found else out


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k``
    other rows of highest inner product between vectors floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("_q"),
                    F.transform(x, lambda e: F.floor(e * scale)).alias("vector"))
            .groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("_q").alias("_q")))
    rows = materialize(rows.withColumn("size", F.size("vector")))
    sizes = rows.groupBy("size").agg(F.ceil(F.count("*") / SHARD).alias("shards"),
                                     F.ceil(F.greatest(F.count_if("_q"), F.lit(1)) / QUERIES).alias("blocks"))
    rows = rows.join(sizes, "size")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    corpus = (rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))
              .select("size", "shard", every("blocks").alias("block"), "vec_id", "vector"))
    queries = (rows.where("_q").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks"))
               .select(F.col("size").alias("q_size"), every("shards").alias("q_shard"), F.col("block").alias("q_block"),
                       F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")))
    local = (corpus.groupBy("size", "shard", "block").cogroup(queries.groupBy("q_size", "q_shard", "q_block"))
             .applyInPandas(lambda c, q: search_group(c, q, k), "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
