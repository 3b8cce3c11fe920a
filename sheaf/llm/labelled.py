"""A bounded, repeatable sample of labelled texts for fitting the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 4096      # labelled rows per class that a fit may use at most
SAMPLE_CHARS = 1 << 25  # characters of their texts together


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the checksum of the id has this remainder. A null id has no checksum and is
    not held out (nor learned from: it can have no label)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id",
           text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[pd.DataFrame, dict[int, float], float]:
    """Up to ``rows`` labelled texts of each class, in the order of a hash of the id, as
    (text, label); what each row of a class stands for: its share among all usable labels
    over its share in the sample; and the share of class 1 among all usable labels (0.5
    without any). An id with two different labels counts as the
    larger one; of texts that repeat an id the smallest stays."""
    known = (labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * rows ids: a bounded side; lengths first, then only the texts that fit
    def held(ids: DataFrame) -> DataFrame:
        return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
                .join(F.broadcast(ids), "_id").where("text IS NOT NULL")
                .groupBy("_id").agg(F.min("label").alias("label"), F.min("text").alias("text")))

    lengths = held(chosen).select("_id", "label", F.xxhash64("_id").alias("_at"), F.length("text").alias("_n")).collect()
    ids = _fitting(sorted(lengths, key=lambda r: (r["_at"], r["_id"])), chars)
    fit = docs.sparkSession.createDataFrame(ids, chosen.schema)
    kept = held(fit).orderBy(F.xxhash64("_id"), "_id").select("text", "label")
    got = pd.DataFrame([tuple(r) for r in kept.toLocalIterator()], columns=["text", "label"])
    total = sum(sizes.values())
    weight = {c: (sizes[c] / total) / (n / len(got)) for c in sizes if (n := int((got["label"] == c).sum()))}
    return got, weight, sizes.get(1, 0) / total if total else 0.5


def _fitting(rows: list, chars: int) -> list[tuple]:
    """(id, label) of the rows that fit, in order: half of ``chars`` for each class first,
    then what is left for any. A row that does not fit is skipped by itself."""
    left, taken = {0: chars // 2, 1: chars - chars // 2}, set()
    for k, r in enumerate(rows):
        if r["_n"] <= left[r["label"]]:
            left[r["label"]] -= r["_n"]
            taken.add(k)
    rest = sum(left.values())
    for k, r in enumerate(rows):
        if k not in taken and r["_n"] <= rest:
            rest -= r["_n"]
            taken.add(k)
    return [(rows[k]["_id"], rows[k]["label"]) for k in sorted(taken)]
