"""Rename proposals (M3): which column that a table misses is which column that a new file
has besides. The source system asks a language model; here names and values decide.

* Values: one aggregate per table keeps a sketch per column -- a theta sketch of its values
  (how many two columns share) and, for numbers and dates, a KLL sketch (how they are
  spread). Profiles are a few KB a column whatever the number of rows, and are kept with
  the catalog; a proposal never reads the tables again.
* Names: an inverted index of the three-letter grams of names; only columns that share a
  gram meet, and are compared by the Dice share of their grams.

Only columns of one kind (number, date, text, flag) are paired. ``propose_renames`` orders
the pairs by score, and ``schema.reconcile_pairs`` folds them one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.names import normalize_for_similarity
from sheaf.operators import data_columns
from sheaf.operators.schema import RESERVED, reconcile_pairs

LOG_VALUES = 12         # 2 to this power hashes a column at most
DECILES = [i / 10 for i in range(11)]
SURE_VALUES = 0.8       # share of common values or of like spread that is enough by itself
SURE_NAME = 0.75        # Dice of the names' grams that is enough by itself
LEAST_SCORE = 0.5       # mean of both, else


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.BooleanType):
        return "flag"
    return "text" if isinstance(t, T.StringType) else None


def column_sketches(df: DataFrame, set_id: str) -> DataFrame:
    """``(set_id, col, kind, n, values_sketch, spread)`` for the columns of one table, by one
    aggregate. ``values_sketch`` is a theta sketch of the values' text, ``spread`` the deciles
    of numbers and dates; columns without a value are left out."""
    cols = [(c, k) for c in data_columns(df) if (k := kind_of(df.schema[c].dataType))]
    if not cols:
        return df.sparkSession.createDataFrame([], "set_id string, col string, kind string, n long, values_sketch binary, spread array<double>")
    aggs = []
    for i, (c, kind) in enumerate(cols):
        v = F.col(f"`{c}`")
        text = F.when(F.trim(v.cast("string")) != "", v.cast("double").cast("string") if kind == "number" else v.cast("string"))
        aggs += [F.count(text).alias(f"n{i}"), F.call_function("theta_sketch_agg", text, F.lit(LOG_VALUES)).alias(f"t{i}")]
        if kind in ("number", "date"):
            number = v.cast("double") if kind == "number" else v.cast("timestamp").cast("double")
            aggs.append(F.call_function("kll_sketch_agg_double", number).alias(f"k{i}"))
    deciles = F.array(*[F.lit(x) for x in DECILES])
    spread = lambda i, kind: (F.call_function("kll_sketch_get_quantile_double", F.col(f"k{i}"), deciles)
                              if kind in ("number", "date") else F.lit(None).cast("array<double>"))
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("n"),
                              F.col(f"t{i}").alias("values_sketch"), F.when(F.col(f"n{i}") > 0, spread(i, kind)).alias("spread"))
                     for i, (c, kind) in enumerate(cols)])
    return df.agg(*aggs).select(F.lit(set_id).alias("set_id"), F.inline(rows)).where("n > 0")


def sketches_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The sketches of several tables, each by its own aggregate."""
    return reduce(DataFrame.unionByName, [column_sketches(df, name) for name, df in tables.items()])


def _grams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), normalize_for_similarity(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _shared_values(a: Column, b: Column) -> Column:
    """Common distinct values over the distinct values of the side that has fewer."""
    estimate = lambda x: F.call_function("theta_sketch_estimate", x)
    return estimate(F.call_function("theta_intersection", a, b)) / F.greatest(F.least(estimate(a), estimate(b)), F.lit(1))


def _like_spread(a: Column, b: Column) -> Column:
    """1 less the mean distance of the deciles, in units of the wider range."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    width = F.greatest(F.element_at(a, -1) - F.element_at(a, 1), F.element_at(b, -1) - F.element_at(b, 1))
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / len(DECILES)
    return F.when(width > 0, F.greatest(F.lit(0.0), 1 - mean / width)).otherwise((mean == 0).cast("double"))


def propose_renames(pairs: DataFrame, new_sketches: DataFrame, table_sketches: DataFrame) -> DataFrame:
    """M3: for ``pairs(new_id, table_id)`` the likely renames ``(new_id, table_id, existing,
    new, name_score, value_score, ord)`` among columns that only one side has, best first."""
    side = lambda s, key, col: s.select(
        F.col("set_id").alias(key), F.lower("col").alias(col), "kind", F.col("values_sketch").alias(f"{col}_values"), F.col("spread").alias(f"{col}_spread"))
    new, old = side(new_sketches, "new_id", "new"), side(table_sketches, "table_id", "existing").where(F.col("existing") != RESERVED)
    mine, theirs = pairs.join(new, "new_id"), pairs.join(old, "table_id")
    both = ["new_id", "table_id"]
    extra = mine.join(theirs.select(*both, F.col("existing").alias("new")), [*both, "new"], "left_anti")
    missing = theirs.join(mine.select(*both, F.col("new").alias("existing")), [*both, "existing"], "left_anti")

    # names: columns that share a gram, by the index
    gram = lambda d, col: d.select(*both, "kind", col, F.size(_grams(F.col(col))).alias(f"{col}_n"), F.explode(_grams(F.col(col))).alias("gram"))
    names = (gram(extra, "new").join(gram(missing, "existing"), [*both, "kind", "gram"])
             .groupBy(*both, "existing", "new").agg((2 * F.count("*") / F.first(F.col("new_n") + F.col("existing_n"))).alias("name_score")))
    # values: columns of one kind in one pair of tables
    of_kind = extra.join(missing, [*both, "kind"])
    shared = _shared_values(F.col("existing_values"), F.col("new_values"))
    spread = F.coalesce(_like_spread(F.col("existing_spread"), F.col("new_spread")), F.lit(0.0))
    # whole ranges of small numbers share values by chance: both must agree
    value = F.when(F.col("kind").isin("number", "date"), F.sqrt(F.least(shared, F.lit(1.0)) * spread)).otherwise(F.least(shared, F.lit(1.0)))
    scored = (of_kind.select(*both, "existing", "new", value.alias("value_score")).join(names, [*both, "existing", "new"], "left")
              .withColumn("name_score", F.coalesce("name_score", F.lit(0.0)))
              .withColumn("_score", (F.col("name_score") + F.col("value_score")) / 2))
    likely = scored.where((F.col("value_score") >= SURE_VALUES) | (F.col("name_score") >= SURE_NAME) | (F.col("_score") >= LEAST_SCORE))
    # the order of one pair of tables: at most columns x columns
    listed = F.sort_array(F.collect_list(F.struct((-F.round("_score", 6)).alias("s"), "existing", "new", "name_score", "value_score")))
    return (likely.groupBy(*both).agg(listed.alias("_p")).select(*both, F.posexplode("_p").alias("_i", "_c"))
            .select(*both, "_c.existing", "_c.new", "_c.name_score", "_c.value_score", (F.col("_i") + 1).cast("long").alias("ord")))


def reconcile(pairs: DataFrame, new_sketches: DataFrame, table_sketches: DataFrame) -> DataFrame:
    """M3 end to end: proposals folded one to one, as ``schema.schema_diff_lists`` takes them."""
    return reconcile_pairs(propose_renames(pairs, new_sketches, table_sketches).select("new_id", "table_id", "existing", "new", "ord"))
