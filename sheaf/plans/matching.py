"""Which table an incoming file belongs to (J2, J3, J9, J10 -> D1-D3): the candidates of the
match ladder, made by the library from the files and the catalog alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.names import sanitize_identifier
from sheaf.operators import decide as D
from sheaf.operators import schema as SC
from sheaf.operators import similarity as S
from sheaf.operators.vectors import VectorCatalog
from sheaf.session import cut_lineage


def match_candidates(files: DataFrame, columns: DataFrame, catalog: VectorCatalog, catalog_columns: DataFrame) -> DataFrame:
    """``files (file_id, file_table, text)`` and their ``columns (file_id, col)`` against the
    catalog's vectors and ``catalog_columns (table_name, col)``. Candidates ``(file_id,
    file_table, table_name, source, rank, score, match_pct)``: the table of the same name
    (exact), the nearest signature vectors (vector), the tables with the most alike columns
    (column), and the earlier file (by id) whose columns hold this one's best (peer, under
    the table that file proposes)."""
    new = S.name_column_sets(columns, "file_id", "col")
    old = S.name_column_sets(catalog_columns, "table_name", "col")
    new, old = cut_lineage(new), cut_lineage(old)
    names = catalog_columns.select("table_name").distinct()
    exact = (files.select("file_id", sanitize_identifier("file_table").alias("table_name")).join(names, "table_name")
             .select("file_id", "table_name", F.lit("exact").alias("source"), F.lit(1).alias("rank"), F.lit(1.0).alias("score")))
    vector = catalog.candidates(files.select("file_id", "text")).join(names, "table_name", "left_semi").select(
        "file_id", "table_name", F.lit("vector").alias("source"), "rank", "score")
    column = S.weighted_dice_topk(new, old).select(
        F.col("new_id").alias("file_id"), F.col("table_id").alias("table_name"), F.lit("column").alias("source"), "rank", "score")
    of_catalog = exact.unionByName(vector).unionByName(column)
    pct = SC.column_set_diff(of_catalog.select(F.col("file_id").alias("new_id"), F.col("table_name").alias("table_id")).distinct(), new, old).select(
        F.col("new_id").alias("file_id"), F.col("table_id").alias("table_name"), "match_pct")
    peers = S.peer_containment(new).where(F.col("peer_id") < F.col("set_id")).select(F.col("set_id").alias("file_id"), "peer_id", "score")
    proposed = files.select(F.col("file_id").alias("peer_id"), sanitize_identifier("file_table").alias("table_name"))
    peer = peers.join(proposed, "peer_id").select("file_id", "table_name", F.lit("peer").alias("source"), F.lit(1).alias("rank"), "score",
                                                  F.round(F.col("score") * 100, 2).alias("match_pct"))
    both = of_catalog.join(pct, ["file_id", "table_name"], "left").unionByName(peer)
    return both.join(files.select("file_id", "file_table"), "file_id").withColumn("match_pct", F.coalesce("match_pct", F.lit(0.0)))


def match_files(files: DataFrame, columns: DataFrame, catalog: VectorCatalog, catalog_columns: DataFrame,
                decisions: DataFrame | None = None) -> DataFrame:
    """Every file with its target table (null: a new table) and the rung that found it."""
    found = D.match_ladder(match_candidates(files, columns, catalog, catalog_columns), decisions)
    rest = ["target_table", "matched_by", "score", "match_pct"]
    return files.select("file_id").join(found.select("file_id", *rest), "file_id", "left").withColumn(
        "is_incremental", F.col("target_table").isNotNull())
