"""M3: proposals from names and values."""
import datetime as dt

from pyspark.sql import functions as F

from sheaf.operators import renames as R


def _pairs(spark):
    return spark.createDataFrame([("n", "t")], "new_id string, table_id string")


def _found(spark, old, new):
    return {(r.existing, r.new) for r in R.reconcile(_pairs(spark), R.column_sketches(new, "n"), R.column_sketches(old, "t")).collect()}


def test_names_values_and_kinds(spark):
    n = 400
    day = dt.date(2020, 1, 1)
    old = spark.createDataFrame([(i, f"town{i % 90}", i * 1.5, day + dt.timedelta(i), float(i % 7), "x", None) for i in range(n)],
                                "id int, town string, price double, day date, rank double, flag string, void string")
    new = spark.createDataFrame([(f"town{i % 80}", i, (i + 20) * 1.5, day + dt.timedelta(i + 30), 1000.0 + i, "y", "q") for i in range(n)],
                                "place string, id int, sum double, dated_on date, other double, flagged string, void2 string")
    assert _found(spark, old, new) == {("town", "place"), ("price", "sum"), ("day", "dated_on")}
    # the name alone is enough where the values changed
    assert _found(spark, old.select("id", F.col("flag").alias("state_of_order")), new.select("id", F.col("flagged").alias("state_of_orders"))) == {
        ("state_of_order", "state_of_orders")}


def test_one_to_one_best_first(spark):
    rows = [(i, i, i % 50) for i in range(300)]
    old = spark.createDataFrame(rows, "a long, b long, c long").select(F.col("a").alias("first_key"), F.col("b").alias("second_key"))
    new = spark.createDataFrame(rows, "a long, b long, c long").select(F.col("b").alias("second_keys"), F.col("a").alias("first_keys"), "c")
    assert _found(spark, old, new) == {("first_key", "first_keys"), ("second_key", "second_keys")}
    ord_ = [(r.existing, r.new) for r in R.propose_renames(_pairs(spark), R.column_sketches(new, "n"), R.column_sketches(old, "t")).orderBy("ord").collect()]
    assert set(ord_[:2]) == {("first_key", "first_keys"), ("second_key", "second_keys")} and len(ord_) >= 4


def test_nothing_to_pair(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert _found(spark, a, a) == set()
    assert _found(spark, a.limit(0), a.withColumnRenamed("a", "z")) == set()
    assert R.column_sketches(spark.createDataFrame([([1],)], "v array<int>"), "t").count() == 0
