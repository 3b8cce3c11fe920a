"""Helpers shared by the corpus operators: reading tables, lineage cuts in the shared
folder, global sort order in bounded slices with values carried from slice to slice."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``). A lost executor cannot take it along, and values that
    are not a pure function of a row (slice numbers) can never change on recompute."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hand texts to Python in batches of bounded rows and bytes: the default of 10,000
    rows says nothing about memory when a row is a whole text."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).lower().rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def range_slices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cut ``df`` into slices that follow each other in the order of ``keys`` and add
    ``_slice``. Callers end ``keys`` with a tie breaker, so that one hot key is cut too."""
    return materialize(df.repartitionByRange(*[F.col(k) for k in keys])
                       .withColumn("_slice", F.spark_partition_id()))


def carry_last(sliced: DataFrame, order: list[str], value: Column, out: str,
               groups: list[str] | None = None) -> DataFrame:
    """``out`` = the last non-null ``value`` at or before each row in the global order
    (within ``groups``). Each slice is swept once; what a slice needs from the earlier
    ones is one row per slice and group."""
    groups = groups or []
    rows = sliced.withColumn("_v", value)
    w = (Window.partitionBy("_slice", *groups).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = (rows.where(F.col("_v").isNotNull()).groupBy("_slice", *groups)
           .agg(F.max_by("_v", F.struct(*order)).alias("_v")))
    end = sliced.agg(F.max("_slice")).first()[0] or 0
    following = F.lead("_slice").over(Window.partitionBy(*groups).orderBy("_slice"))
    carried = (per.withColumn("_next", F.coalesce(following, F.lit(end)))
               .where(F.col("_next") > F.col("_slice"))
               .select(*groups, F.col("_v").alias("_carry"),
                       F.explode(F.expr("sequence(_slice + 1, _next)")).alias("_slice")))
    return (rows.withColumn("_here", F.last("_v", ignorenulls=True).over(w))
            .join(carried, ["_slice", *groups], "left")
            .withColumn(out, F.coalesce("_here", "_carry")).drop("_v", "_here", "_carry"))


def carry_sum(sliced: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``out`` = the running sum of ``value`` in the global order."""
    rows = sliced.withColumn("_v", value)
    w = (Window.partitionBy("_slice").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = (rows.groupBy("_slice").agg(F.sum("_v").alias("_s"))
           .select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry")))
    return (rows.withColumn("_here", F.sum("_v").over(w)).join(per, "_slice", "left")
            .withColumn(out, F.col("_here") + F.col("_carry")).drop("_v", "_here", "_carry"))


def ordered_ids(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """A number per row that follows the order of ``keys`` (rows distinct in them):
    slice number in the high bits, place in the slice in the low ones. No gaps are
    closed, so no task sees more than its slice."""
    w = Window.partitionBy("_slice").orderBy(*keys)
    return (range_slices(df, keys)
            .withColumn(out, F.shiftleft(F.col("_slice").cast("long"), 40) + F.row_number().over(w))
            .drop("_slice"))
