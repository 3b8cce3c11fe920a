"""Ordered work without a global window: rows are cut into slices by range of the sort
keys, each slice is swept on its own, and what a slice needs from the earlier ones is one
row per slice. A slice holds about as many rows as any other (ranges come from a sample of
the keys), so a file or a key of any size is spread over as many tasks as its rows need.
Callers end the keys with a tie breaker, so that equal keys are cut too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import cut_lineage


def range_slices(df: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice``: slices follow each other in the order of ``keys``. Written
    out, so that slice numbers cannot change when a task runs again."""
    by = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def carry_max(sliced: DataFrame, group: str, order: str, values: dict[str, Column]) -> DataFrame:
    """Adds, per name in ``values``, the largest value so far in the order of ``order``
    within ``group`` (this row included): the last one, if values grow along the order."""
    here = (Window.partitionBy(group, "_slice").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = sliced.groupBy(group, "_slice").agg(*[F.max(v).alias(n) for n, v in values.items()])
    carried = per.select(group, "_slice", *[F.max(n).over(before).alias(f"_before_{n}") for n in values])
    swept = sliced.withColumns({n: F.max(v).over(here) for n, v in values.items()})
    return (swept.join(carried, [group, "_slice"], "left")
            .withColumns({n: F.greatest(n, f"_before_{n}") for n in values}).drop(*[f"_before_{n}" for n in values]))


def row_numbers(df: DataFrame, keys: list[str], out: str, slices: int | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, 3 ... in the order of ``keys`` over all rows."""
    sliced = range_slices(df, keys, slices)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)    # one row a slice
    offset = (sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
              .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*keys))
    return sliced.withColumn("_place", place).join(offset, "_slice").withColumn(
        out, F.col("_offset") + F.col("_place")).drop("_slice", "_place", "_offset")
