"""Registered queries: one per operator family, each reading the driver tables at
``sf_dir`` (whole tables), plus the DuckDB SQL that reaches the same answer by
another route (true dates instead of parsed labels, SQL joins instead of
DataFrame ones). Computed columns carry the same alias on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# DuckDB expression for exact-cent revenue / order value (same rounding as Spark side).
REV_SQL = ("ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2)")
OVAL_SQL = "ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2)"
FY_START_SQL = "(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END)"

from sheaf.plans import queries_periods  # noqa: E402,F401
from sheaf.plans import queries_clean  # noqa: E402,F401
from sheaf.plans import queries_similarity  # noqa: E402,F401
from sheaf.plans import queries_load  # noqa: E402,F401
from sheaf.plans import queries_vectors  # noqa: E402,F401
from sheaf.plans import queries_hierarchy  # noqa: E402,F401
from sheaf.plans import queries_jobs  # noqa: E402,F401
from sheaf.plans import queries_profile  # noqa: E402,F401
from sheaf.plans import queries_sources  # noqa: E402,F401
from sheaf.plans import queries_sheets  # noqa: E402,F401
from sheaf.plans import queries_store  # noqa: E402,F401
from sheaf.plans import queries_streaming  # noqa: E402,F401
from sheaf.plans import queries_renames  # noqa: E402,F401
from sheaf.plans import queries_decide  # noqa: E402,F401
