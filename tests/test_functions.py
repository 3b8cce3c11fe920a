"""Golden examples from the source system's documentation and the quirk list."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheaf.functions import names as N
from sheaf.functions import numbers as NUM
from sheaf.functions import periods as P
from sheaf.functions import types as TY
from sheaf.operators import headers as H


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


CLEAN_CASES = [
    ("Aggregate deposits (2+3) (Adjusted)_23117503.01", "aggregate_deposits_23117503_01_adjusted"),
    ("Year (ending March)", "year"),
    ("Value (Unadjusted) [x] - notes", "value_adjusted_unadjusted"),   # K13: substring rule kept
    ("2020 total", "col_2020_total"),
    ("((", "unnamed_column"),
    ("Élan vital (Net)", "élan_vital_net"),
    ("Sales – provisional figures", "sales"),
]


def test_clean_column_name_golden_and_parity(spark):
    got = one(spark, N.clean_column_name, [c for c, _ in CLEAN_CASES])
    assert got == [e for _, e in CLEAN_CASES]
    assert N.clean_names([c for c, _ in CLEAN_CASES]) == got


SIM_CASES = [("no_of_schemes_as_on_dec_31_2025", "no_of_schemes_as_on"),
             ("no_of_schemes_as_on_jan_31_2026", "no_of_schemes_as_on"),
             ("aum_2024-01-31", "aum"), ("sales_jan_2024", "sales"), ("x_fy2024_25", "x"),
             ("gdp_q1_2024", "gdp"), ("rev_2023_24", "rev"), ("gdp_2024", "gdp"), ("2024", "2024")]


def test_similarity_normaliser(spark):
    got = one(spark, N.normalize_for_similarity, [c for c, _ in SIM_CASES])
    assert got == [e for _, e in SIM_CASES]


def test_unique_names_and_suffixes(spark):
    for names, unique in [(["a", "A", "b", "a_1", "a"], ["a", "A_1", "b", "a_1_1", "a_2"]),
                          (["a", "a_1", "a"], ["a", "a_1", "a_2"]), (["a", "a_1", "a_1_1", "a"], ["a", "a_1", "a_1_1", "a_2"]),
                          (["", " ", ' "x" ', "X"], ["", "column_1_1", ' "x" ', "X_1"])]:
        assert N.unique_name_list(names) == unique
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "t int, pos int, name string")
        got = N.unique_names(df, group_cols=["t"]).orderBy("pos").collect()
        assert [r.unique_name for r in got] == unique
    rows = ["Deposits (2+3)", "Deposits (8+9)", "Deposits (Revised)", "Deposits"]
    df = spark.createDataFrame([(i, r, "deposits") for i, r in enumerate(rows)], "pos int, original string, cleaned string")
    assert [r.final_name for r in N.unique_mapping(df).orderBy("pos").collect()] == [
        "deposits", "deposits_89", "deposits_revised", "deposits_3"]


def test_table_name_rules(spark):
    df = spark.createDataFrame([("data_india_mth",), ("economic_data_x",), ("cpi_india_mth",),
                                ("wholesale_price_index_india_monthly_commodity_group",)], "n string")
    r = df.select(N.is_vague_table_name("n").alias("v"), N.shorten_table_name("n").alias("s")).collect()
    assert [x.v for x in r] == [True, True, False, False]
    assert r[3].s == "wholesale_price_index_india_mth_commodity_group"


def test_name_jaccard(spark):
    df = spark.createDataFrame([("cpi_india_mth", "cpi_india_yr"), ("", "x")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(N.name_jaccard("a", "b")).collect()] == [0.5, 0.0]


PERIOD_CASES = [("2020-21", "fiscal"), ("2021-2022", "fiscal"), ("Jan-2024", "month_year"),
                ("January 2024", "month_year"), ("Q1-2024", "quarter"), ("2024", "year"),
                ("April 01, 2018 - May 31, 2018", "date_range")]


@pytest.mark.parametrize("value,pattern", PERIOD_CASES)
def test_period_patterns(value, pattern):
    assert P.choose_period_pattern_py([value]) == pattern


def test_split_period_variants(spark):
    def split(vals):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_row long, period string")
        return [r.asDict() for r in P.split_period(df).orderBy("_row").drop("_row").collect()]
    assert split(["2020-21", "2021-2022"]) == [{"fiscal_year": "2020-21"}, {"fiscal_year": "2021-22"}]
    assert split(["2018-2020", "1999-00"]) == [{"from_year": 2018, "to_year": 2020},
                                               {"from_year": 1999, "to_year": 2000}]   # K12 century wrap
    assert split(["Jan-2024", "Sept 2023"]) == [{"year": 2024, "month": 1}, {"year": 2023, "month": 9}]
    assert split(["Q3-2024"]) == [{"year": 2024, "quarter": 3}]
    assert split(["April 01, 2018 - March 31, 2019"]) == [{"fiscal_year": "2018-19"}]
    assert split(["May 01, 2018 - May 31, 2018"]) == [{"month": 5, "year": 2018}]
    assert split(["April 01, 2018 - June 30, 2018", "May 01, 2018 - May 31, 2018"]) == [
        {"from_month": 4, "from_year": 2018, "to_month": 6, "to_year": 2018},
        {"from_month": 5, "from_year": 2018, "to_month": 5, "to_year": 2018}]
    assert split(["foo", "bar"]) == [{"period": "foo"}, {"period": "bar"}]


def test_month_numeric_rules(spark):
    df = spark.createDataFrame([("Jan",), ("february",), ("x",)], "month string")
    assert [r.month_numeric for r in P.add_month_numeric(df).collect()] == [1, 2, None]
    df2 = spark.createDataFrame([(1,), (12,)], "month int")
    assert [r.month_numeric for r in P.add_month_numeric(df2).collect()] == [1, 12]
    df3 = spark.createDataFrame([("2024-03-01",), ("2024-04-15",)], "period string")
    assert [r.month_numeric for r in P.add_month_numeric(df3).collect()] == [3, 4]


def test_mmm_yyyy_and_fy(spark):
    vals = ["12-2025", "2025-3", "December 2025", "market May 2024", "2025-13", "hello"]
    got = one(spark, P.normalize_mmm_yyyy, vals)
    assert got == ["Dec 2025", "Mar 2025", "Dec 2025", "Mar 2024", "2025-13", "hello"]  # K20 kept
    assert one(spark, P.derive_fy, ["December 2025", "Feb 2025", "2025", "1999"]) == [
        "FY2025-2026", "FY2024-2025", "FY2025-2026", None]


def test_compare_period(spark):
    df = spark.createDataFrame([("2024-06", "2024-05"), ("2024", "2023"), ("b", "a"), ("2020-21", "2021-22")],
                               "a string, b string")
    r = df.select(P.compare_period("a", "b").alias("c")).collect()
    assert [(x.c.gt, x.c.method) for x in r] == [(True, "date"), (True, "date"), (True, "string"),
                                                (False, "string")]


def test_numbers(spark):
    vals = ["1,23,456", "12.5%", "₹ 34.2", "-", "—", "na", "n/a", "null", "inf", "$1,000.50"]
    assert one(spark, NUM.coerce_numeric, vals) == [123456.0, 12.5, 34.2, None, None, None, None, None, None, 1000.5]
    assert one(spark, NUM.parse_indian_number, ["1,23,456.78", "-", "12"]) == [123456.78, None, 12.0]
    assert one(spark, NUM.format_indian, [12345678.9, -12.5, 999.0], "double") == [
        "1,23,45,678.90", "-12.50", "999.00"]


def test_types_and_lattice(spark):
    assert TY.normalise_type_py("VARCHAR(100)") == "character varying"
    assert TY.normalise_type_py("int8") == "bigint"
    assert TY.is_safe_widening_py("integer", "bigint") and not TY.is_safe_widening_py("bigint", "integer")
    assert TY.is_safe_widening_py("NUMERIC(15, 2)", "text")                         # K8: parameters stripped
    df = spark.createDataFrame([("12", "1.5", "2024-01-01", "x"), ("7", "2", "2024-02-01 10:00:00", "y")],
                               "a string, b string, c string, d string")
    got = {r.column_name: r.inferred_type for r in TY.infer_types(df, sample=None, order_col=None).collect()}
    assert got == {"a": "BIGINT", "b": "DOUBLE PRECISION", "c": "TIMESTAMP WITHOUT TIME ZONE", "d": "TEXT"}
    sizes = spark.createDataFrame([(10,), (60,), (200,), (300,)], "m int")
    assert [r[0] for r in sizes.select(TY.varchar_size("m")).collect()] == [
        "VARCHAR(100)", "VARCHAR(200)", "VARCHAR(500)", "TEXT"]
    fix = spark.createDataFrame([("VARCHAR(100)", 120), ("VARCHAR(100)", 300), ("VARCHAR(100)", 50)],
                                "d string, m int")
    assert [r[0] for r in fix.select(TY.fix_varchar("d", "m")).collect()] == ["VARCHAR(240)", "TEXT", "VARCHAR(100)"]


def test_header_merges(spark):
    levels = [["Year", ""], ["Unit value index", "Exports"], ["Unit value index", "Imports"],
              ["Quantum index", "Exports"], ["Quantum index", "Imports"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "i int, x array<string>").orderBy("i")
    merged = [r[0] for r in df.select(H.merge_header_levels("x")).collect()]
    assert merged == ["Year", "Unit value index_Exports", "Unit value index_Imports",
                      "Quantum index_Exports", "Quantum index_Imports"]
    assert N.clean_names(merged) == ["year", "unit_value_index_exports", "unit_value_index_imports",
                                     "quantum_index_exports", "quantum_index_imports"]
    grid = spark.createDataFrame([(0, ["A", "A", "B"]), (1, [None, "Unnamed: 1", "nan"])], "i int, x array<string>").orderBy("i")
    assert [r[0] for r in grid.select(H.merge_header_grid("x")).collect()] == ["A_B", None]


def test_row_header_merge(spark):
    rows = [(0, "Year", "Unit value index", "Unit value index"), (1, None, "Exports", "Imports"),
            (2, "2020", "101.5", "99.2"), (3, "2021", "104.0", "98.1")]
    df = spark.createDataFrame(rows, "_row long, a string, b string, c string")
    out = H.merge_row_headers(df)
    assert out.columns == ["_row", "Year", "Unit value index_Exports", "Unit value index_Imports"]
    assert out.count() == 2
