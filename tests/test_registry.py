"""Every registered query against its DuckDB oracle on the smallest tables, the
same compare the driver runs (row count, column names, order-free value hash)."""
import duckdb
import pytest

import __spark_entry__ as E
from sheaf.plans.registry import ORACLES, QUERIES
from sheaf.session import TABLES
from tests.conftest import SF_SMALL
from tools_check import digest



@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["l_returnflag", "year", "month", "month_numeric", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exp = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert digest(got) == digest(exp)
