"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of documents.

1. toxicity: documents that the classifier predicts toxic go (a null text stays).
2. line_dedup: later copies of repeated runs are deleted from the texts; a document of
   which nothing but blanks is left goes, and ``n_chars`` follows the text.
3. simhash_near_dedup: of each component the row with the smallest id stays; among rows
   of that id, the one with the smallest hash of the text.
4. decontamination: documents that hold a test item go.
5. byte_bpe: token ids of each text and the digests of the encoded and decoded bytes.

Defined cases: see the operators. Stages 3 and 4 tell rows apart by id and text (two
hashes of it), so an id with several texts, or a null id, is judged text by text: no row
goes because another row of its id does. Rows with a null id come last in stage 3: in a
component they stay only if it has no other rows, and then one of them does. Rows that
repeat id and text come through stages 1, 2 and 4 alike; stage 3 keeps one of them (the
smallest of its other columns). Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, line_dedup, queries, simhash, toxicity
from sheaf.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(spark, sf_dir, docs)
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), model, threshold=0.5)
    return scored.where("predicted = 0").select(*COLUMNS)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("lines_removed") > 0
    return (edited.where(~changed | F.coalesce(F.trim("text", F.lit(line_dedup.BLANKS + "\n")) != "", F.lit(True)))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def _row_key() -> Column:
    """Id and text as one value without nulls; null ids sort last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
                    F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("_key", _row_key())
    found = materialize(simhash.near_duplicates(docs, id_col="_key", words=3, radius=2).select("_key", "component_id"))
    # few rows go, so it is those that are matched with the texts
    gone = found.where(F.col("_key") != F.col("component_id")).select("_key").distinct()
    kept = docs.join(gone, "_key", "left_anti")
    many = (found.where(F.col("_key") == F.col("component_id")).groupBy("_key").agg(F.count("*").alias("n"))
            .where("n > 1").select("_key"))
    once = kept.join(many, "_key", "left_anti").select(*COLUMNS)
    again = (kept.join(many, "_key", "left_semi")
             .groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*"))
    return once.unionByName(again)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("_key", _row_key()).withColumn("_key", F.concat_ws(":", *[
        F.col(f"_key.{c}").cast("string") for c in ("none", "id", "h1", "h2")]))
    leaks = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), id_col="_key", id_type="string")
    leaks = materialize(leaks.select(F.col("doc_id").alias("_key")).distinct())
    return docs.join(leaks, "_key", "left_anti").select(*COLUMNS)


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.token_digests(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("simhash_near_dedup", _simhash),
          ("decontamination", _decontamination), ("byte_bpe", _byte_bpe)]

#: A classifier, fingerprints and BPE are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``."""
    *first, (_, last) = STAGES
    docs = reduce(lambda d, stage: materialize(stage[1](spark, d, sf_dir)), first, read(spark, sf_dir, "documents"))
    return last(spark, docs, sf_dir)
