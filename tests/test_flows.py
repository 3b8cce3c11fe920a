import datetime as dt
import os

from pyspark.sql import functions as F

from sheaf.functions import periods as P
from sheaf.operators import clean as C
from sheaf.operators import sheets as X
from sheaf.plans import load as L
from sheaf.plans import preprocess as PP


def test_category1_flow(spark):
    rows = [(0, "Andhra Pradesh", "1,200", "1,350", "—"), (1, "Bihar", "800", "950", "1,020"),
            (2, "Notes: provisional", None, None, None)]
    df = spark.createDataFrame(rows, "_row long, `State (Name)` string, `Jan-2024` string, `Feb-2024` string, "
                                     "`Mar-2024` string").withColumn("_file", F.lit("f"))
    out = PP.preprocess_category1(df, as_of=dt.date(2026, 1, 1))
    got = sorted((r.state, r.year, r.month, r.value) for r in out.collect())
    assert got[0] == ("Andhra Pradesh", 2024, 1, "1,200")
    assert "refresh_date" in out.columns and "month_numeric" in out.columns
    assert "state_unit" in out.columns       # H6: "(Name)" read as a unit label
    assert len(got) == 6                      # footer row dropped, the dash cell kept as text


def test_category2_flow(spark):
    rows = [(0, "A", "Public sector", None, None), (1, "1", "Bank one", "1,00,000", "2,00,000"),
            (2, "2", "Bank two *", "50", "70"), (3, None, "Total", "1,00,050", "2,00,070"),
            (4, "B", "Private sector", None, None), (5, "1", "Bank three (2)", "10", "-")]
    df = spark.createDataFrame(rows, "_row long, sr string, name string, `2023` string, `2024` string") \
        .withColumn("_file", F.lit("f"))
    out = PP.preprocess_category2(df, {"index_column": "sr", "label_column": "name"}, levels=1)
    got = sorted((r.name, r.level_0, r.year, r.value) for r in out.collect())
    assert got == [("Bank one", "Public sector", 2023, 100000.0), ("Bank one", "Public sector", 2024, 200000.0),
                   ("Bank three", "Private sector", 2023, 10.0), ("Bank three", "Private sector", 2024, None),
                   ("Bank two", "Public sector", 2023, 50.0), ("Bank two", "Public sector", 2024, 70.0)]


def test_redundant_columns_and_exports(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a", "a", 1), (2, "b", "b", 5), (3, None, None, 3)],
                               "_row long, x string, y string, z int")
    assert C.redundant_columns(df) == ["y"]
    out = df.drop("_row").withColumn("d", F.to_date(F.lit("2024-01-31")))
    L.export(out, os.path.join(tmpdir_path, "csv"), "csv")
    L.export(out, os.path.join(tmpdir_path, "json"), "json")
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv"))
    assert back.count() == 3 and back.first()["d"] == "2024-01-31"
    lines = [r[0] for r in spark.read.text(os.path.join(tmpdir_path, "json")).collect()]
    assert any('"x":null' in x for x in lines)                                 # NULLs kept


def test_period_column_detection_and_sql(spark):
    assert P.detect_period_column_py(["refresh_date", "state", "fiscal_year", "value"]) == "fiscal_year"   # K17
    assert P.detect_period_column_py(["a", "b"]) is None
    spark.createDataFrame([("2024-01",), ("2023-12",)], "period string").createOrReplaceTempView("t_periods")
    mn, mx = P.period_sql("t_periods", "period")
    assert spark.sql(mn).first()[0] == "2023-12" and spark.sql(mx).first()[0] == "2024-01"


def test_drop_empty_leading_columns(spark):
    df = spark.createDataFrame([(None, " ", "a"), (None, None, "b")], "_p0 string, _p1 string, _p2 string")
    assert X.drop_empty_leading_columns(df, df.columns).columns == ["_p2"]
