"""Signature vectors (J9) and their search, as sparse rows.

A signature text is a row per distinct word bucket (``bucket``, ``tf``). Buckets are the
first 32 bits of the word's MD5, so that any engine can make them again; at that width two
words of a catalog practically never share one. The weight of a bucket is ``tf * ln((N + 1)
/ df)`` over the catalog's tables, and vectors have length 1.

``VectorCatalog`` keeps the rows and the document frequencies as tables beside the
signatures. A load changes only the rows of its tables and, by the difference of old and
new buckets, the frequencies of the buckets concerned; nothing is counted again.

Search is exact without comparing all pairs: with buckets in one order for all (rarest
first), two vectors whose cosine reaches the threshold share a bucket in the head of both,
the head being the buckets up to where the length of the rest falls below the threshold.
Frequent buckets come last and stay out of the heads."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.blocks import best_pairs
from sheaf.operators.signatures import SIMILARITY_THRESHOLD, SIMILARITY_TOP_K
from sheaf.session import cut_lineage
from sheaf.sources.store import TableStore

WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, words)`` to ``(id, buckets, tf)``: a word is hashed once in a batch."""
    for b in batches:
        words = b.column("words")
        lens, coded = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().dictionary_encode()
        hashed = [int.from_bytes(md5(w.as_py().encode(), usedforsecurity=False).digest()[:4], "big") for w in coded.dictionary]
        bucket, place = np.unique(np.array(hashed, np.int64), return_inverse=True)
        rows = np.repeat(np.arange(b.num_rows), lens)
        key, tf = np.unique(rows * max(len(bucket), 1) + place[coded.indices.to_numpy()], return_counts=True)
        ptr = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * max(len(bucket), 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ptr, pa.array(v)) for v in (bucket[key % max(len(bucket), 1)], tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([b.column("id"), *lists], ["id", "buckets", "tf"])


def text_buckets(docs: DataFrame, id_col: str, text_col: str, packed: bool = False) -> DataFrame:
    """``(id, bucket, tf)`` of whole texts; texts without words have no row. ``packed``: a row
    per text with ``buckets`` and ``tf`` as lists, counted text by text."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition("id")     # words are not moved again
    if packed:
        kind = texts.schema["id"].dataType.simpleString()
        split = F.flatten(F.transform("_texts", lambda t: F.filter(F.split(F.lower(t), WORD_SPLIT), lambda w: w != "")))
        words = texts.groupBy("id").agg(F.collect_list("_text").alias("_texts")).select("id", split.alias("words")).where(F.size("words") > 0)
        return words.mapInArrow(_count_buckets, f"id {kind}, buckets array<long>, tf array<int>")
    words = texts.select("id", F.explode(F.split(F.lower(F.col("_text")), WORD_SPLIT)).alias("word")).where("word <> ''")
    bucket = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long")
    # words are counted before they are hashed
    return (words.groupBy("id", "word").agg(F.count("*").alias("tf")).select("id", bucket.alias("bucket"), "tf")
            .groupBy("id", "bucket").agg(F.sum("tf").alias("tf")))


def weighted(terms: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """``(id, bucket, w, df)`` with vectors of length 1. Buckets that no table of the catalog
    has count as one table's; buckets that all have weigh next to nothing."""
    raw = terms.join(frequencies, "bucket", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    raw = raw.withColumn("_w", F.col("tf") * F.log((F.lit(float(n)) + 1) / F.col("df")))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, "id").where("_norm > 0").select("id", "bucket", (F.col("_w") / F.col("_norm")).alias("w"), "df")


def heads(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(id, bucket)``: the buckets before which the rest of the vector is at least as long
    as the threshold."""
    rest = Window.partitionBy("id").orderBy(F.col("df").desc(), F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (vectors.withColumn("_rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)))
            .where(F.col("_rest") >= threshold - 1e-9).select("id", "bucket"))


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, exclude_self: bool = False) -> DataFrame:
    """``(file_id, id, score)``: all pairs of ``weighted`` vectors at or above the threshold."""
    hl, hr = heads(left, threshold).withColumnRenamed("id", "file_id"), heads(right, threshold)
    pairs = hl.join(hr, "bucket").select("file_id", "id").distinct()
    pairs = cut_lineage(pairs.where("file_id <> id") if exclude_self else pairs)
    mine = left.select(F.col("id").alias("file_id"), "bucket", F.col("w").alias("_wl"))
    return (pairs.join(mine, "file_id").join(right.select("id", "bucket", "w"), ["id", "bucket"])
            .groupBy("file_id", "id").agg(F.sum(F.col("_wl") * F.col("w")).alias("score")).where(F.col("score") >= threshold - 1e-9))


def cosine_best(terms: DataFrame, threshold: float, k: int = SIMILARITY_TOP_K) -> DataFrame:
    """``(file_id, id, score, rank)``: every text of ``terms`` against all others, weighted by
    their own frequencies; the ``k`` best as ``best_matches`` of all ``cosine_pairs``. Blocks
    of texts are compared in memory, so no pair below the threshold is written. ``terms`` may
    be packed."""
    if "buckets" in terms.columns:
        packed = terms.select(F.col("id").alias("set_id"), F.col("buckets").alias("items"), "tf")
    else:
        packed = terms.groupBy("id").agg(F.collect_list(F.struct("bucket", F.col("tf").cast("int").alias("tf"))).alias("t"))
        packed = packed.select(F.col("id").alias("set_id"), F.col("t.bucket").alias("items"), F.col("t.tf").alias("tf"))
    best = best_pairs(packed, "cosine", threshold, k)
    return best.select(F.col("set_id").alias("file_id"), F.col("other_id").alias("id"), "score", "rank")


def best_matches(pairs: DataFrame, k: int = SIMILARITY_TOP_K) -> DataFrame:
    """The ``k`` best per file; scores are compared to nine places, ties go to the smaller id."""
    order = Window.partitionBy("file_id").orderBy(F.round("score", 9).desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class VectorCatalog:
    """Signature vectors of a store's tables: ``signature_terms (table_name, bucket, tf)`` and
    ``signature_frequencies (bucket, df)``."""

    TERMS, FREQUENCIES = "signature_terms", "signature_frequencies"

    def __init__(self, store: TableStore):
        self.store = store
        store.create_table(self.TERMS, {"table_name": "TEXT", "bucket": "BIGINT", "tf": "BIGINT"}, ["table_name", "bucket"])
        store.create_table(self.FREQUENCIES, {"bucket": "BIGINT", "df": "BIGINT"}, ["bucket"])

    def terms(self) -> DataFrame:
        return self.store.read(self.TERMS).select(F.col("table_name").alias("id"), "bucket", "tf")

    def frequencies(self) -> DataFrame:
        return self.store.read(self.FREQUENCIES).select("bucket", "df").where("df > 0")

    def tables(self) -> int:
        return self.store.read(self.TERMS).select("table_name").distinct().count()

    def update(self, texts: DataFrame) -> None:
        """Take the signature ``texts (table_name, text)`` of one load's tables in place of
        those they had. Run again with the same texts it changes nothing."""
        new = cut_lineage(text_buckets(texts, "table_name", "text"))
        held = cut_lineage(self.terms().join(texts.select(F.col("table_name").alias("id")).distinct(), "id", "left_semi"))
        gone = held.join(new, ["id", "bucket"], "left_anti").select("id", "bucket")
        come = new.join(held, ["id", "bucket"], "left_anti").select("id", "bucket")
        change = (come.withColumn("_d", F.lit(1)).unionByName(gone.withColumn("_d", F.lit(-1)))
                  .groupBy("bucket").agg(F.sum("_d").alias("_d")))
        known = self.store.read(self.FREQUENCIES).select("bucket", "df")
        after = cut_lineage(change.join(known, "bucket", "left").select("bucket", (F.coalesce("df", F.lit(0)) + F.col("_d")).alias("df")))
        # the terms go last: until they are written, a load that failed starts from the same difference
        if not after.isEmpty():
            self.store.upsert(self.FREQUENCIES, after, ["bucket"])
        if not gone.isEmpty():
            self.store.delete(self.TERMS, cut_lineage(gone.select(F.col("id").alias("table_name"), "bucket")))
        if not new.isEmpty():
            self.store.upsert(self.TERMS, new.select(F.col("id").alias("table_name"), "bucket", "tf"), ["table_name", "bucket"])

    def candidates(self, files: DataFrame, threshold: float = SIMILARITY_THRESHOLD, k: int = SIMILARITY_TOP_K) -> DataFrame:
        """``files (file_id, text)`` -> ``(file_id, table_name, score, rank)``, the vector rung."""
        n, frequencies = self.tables(), cut_lineage(self.frequencies())
        mine = cut_lineage(weighted(text_buckets(files, "file_id", "text"), frequencies, n))
        theirs = cut_lineage(weighted(self.terms(), frequencies, n))
        return best_matches(cosine_pairs(mine, theirs, threshold), k).select("file_id", F.col("id").alias("table_name"), "score", "rank")
