import datetime as dt
import os
import uuid

import duckdb
from pyspark.sql import functions as F

from sheaf.plans import load as L
from sheaf.session import table
from sheaf.sources.store import TableStore
from tests.conftest import SF_SMALL

T0 = dt.datetime(2026, 1, 1)
T1 = dt.datetime(2026, 2, 1)


def new_store(spark, path, **options):
    return TableStore(spark, f"db_{uuid.uuid4().hex[:12]}", path, **options)


def _orders(spark):
    return table(spark, SF_SMALL, "orders")


def test_one_time_then_incremental_upsert(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path)
    o = _orders(spark)
    base = o.where(F.col("o_orderdate") < "1999-01-01").withColumn("_row", F.col("o_orderkey"))
    delta = (o.where(F.col("o_orderdate") >= "1998-07-01")
             .withColumn("o_totalprice", F.round(F.col("o_totalprice") * 1.1, 2))
             .withColumn("o_note", F.lit("rev"))
             .withColumn("_row", F.col("o_orderkey")))
    s = L.one_time_load(store, "Orders_Hist", base, key_columns=["o_orderkey"], now=T0)
    n_base = base.count()
    assert s["rows"] == n_base
    assert s["period_col"] == "o_orderdate"
    audit = L.incremental_load(store, "orders_hist", delta, now=T1, batch_id=1)
    con = duckdb.connect()
    p = f"{SF_SMALL}/orders.parquet"
    exp_upd = con.execute(f"select count(*) from '{p}' where o_orderdate >= '1998-07-01' and o_orderdate < '1999-01-01'").fetchone()[0]
    exp_ins = con.execute(f"select count(*) from '{p}' where o_orderdate >= '1999-01-01'").fetchone()[0]
    assert audit["rows_updated"] == exp_upd
    assert audit["rows_inserted"] == exp_ins
    assert audit["rows_after"] == n_base + exp_ins
    assert audit["columns_added"] == ["o_note"]
    got = store.read("orders_hist")
    assert got.count() == con.execute(f"select count(*) from '{p}'").fetchone()[0]
    # updated rows carry the new price and the new stamp; old rows keep theirs
    upd = got.where(F.col("o_note") == "rev").agg(F.min("ingested_at")).first()[0]
    assert upd == T1
    old = got.where(F.col("o_note").isNull()).agg(F.max("ingested_at")).first()[0]
    assert old == T0
    # replaying the same batch id is a no-op
    assert L.incremental_load(store, "orders_hist", delta, now=T1, batch_id=1)["skipped"]
    om = store.read("operational_metadata").where(F.col("table_name") == "orders_hist").first()
    assert om["rows_count"] == n_base + exp_ins
    assert om["last_available_value"].startswith(str(con.execute(f"select max(o_orderdate) from '{p}'").fetchone()[0])[:10])


def test_upsert_rewrites_only_touched_partitions_and_grows(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path, rows_per_part=100)
    o = _orders(spark).withColumn("_row", F.col("o_orderkey"))
    store.create_table("t", o.drop("_row").schema, ["o_orderkey"])
    store.upsert("t", o, ["o_orderkey"], ts=T0)
    parts = store.spark.table(store._t("t")).select("_part").distinct().count()
    assert parts > 4
    one = o.where(F.col("o_orderkey") == 7).withColumn("o_totalprice", F.lit(1.0))
    r = store.upsert("t", one, ["o_orderkey"], ts=T1)
    assert r["rows_updated"] == 1 and r["rows_inserted"] == 0 and r["touched_parts"] == 1
    assert r["rows_before_touched"] < store.count("t") == o.count()
    assert store.read("t").where(F.col("o_orderkey") == 7).first()["o_totalprice"] == 1.0


def test_types_are_widened_before_the_write(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path)
    store.create_table("w", {"k": "bigint", "i": "integer", "b": "bigint", "s": "VARCHAR(5)", "d": "date"}, ["k"])
    first = spark.createDataFrame([(1, 7, 8, "abc", "2024-01-02")], "k long, i int, b long, s string, d string")
    assert L.incremental_load(store, "w", first, batch_id=1, now=T0)["schema_changes"] == []
    more = spark.createDataFrame([(2, "3,000,000,000", "9007199254740993", "abcdefgh", "03/04/2024"), (3, "x", "5", None, None)],
                                 "k long, i string, b string, s string, d string")
    got = L.incremental_load(store, "w", more, batch_id=2, now=T1)
    assert got["schema_changes"] == ["i: integer -> bigint", "s: VARCHAR(5) -> text"]
    assert got["warnings"] == ["i: 1 values do not fit bigint; NULL"]
    assert store.column_types("w")["s"] == "text" and store.column_types("w")["i"] == "bigint"
    rows = {r.k: (r.i, r.b, r.s, str(r.d)) for r in store.read("w").collect()}
    assert rows == {1: (7, 8, "abc", "2024-01-02"), 2: (3_000_000_000, 9007199254740993, "abcdefgh", "2024-04-03"),
                    3: (None, 5, None, "None")}
    huge = spark.createDataFrame([(4, 1, "99999999999999999999", "a", None)], "k long, i int, b string, s string, d string")
    assert L.incremental_load(store, "w", huge, batch_id=3, now=T1)["schema_changes"] == ["b: bigint -> numeric"]
    assert int(store.read("w").where("k = 4").first()["b"]) == 99999999999999999999


def test_catalog_frames_and_signatures(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path)
    df = spark.createDataFrame([(1, 2, "a")], "b long, a long, v string")
    L.one_time_load(store, "kv", df, key_columns=["b", "a"], now=T0)
    assert [tuple(r) for r in store.key_columns().collect()] == [("kv", "b", "bigint", 0), ("kv", "a", "bigint", 1)]
    assert store.columns().where("table_name = 'kv'").count() == 4
    assert store.read("signatures").first()["row_count"] == 1
    store.create_table("bare", {"x": "text"})
    assert L.backfill_signatures(store, dry_run=True) == {"tables": 6, "missing": 1, "written": 0}
    assert L.backfill_signatures(store)["written"] == 1 and store.count("signatures") == 2
    L.delete_signature(store, "bare")
    assert [r.table_name for r in store.read("signatures").collect()] == ["kv"]
    L.drop_tables(store, ["kv"])
    assert store.count("signatures") == store.count("tables_metadata") == 0 and not store.exists("kv")


def test_repeated_keys_last_row_wins_and_null_keys(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path)
    rows = [(1, "a", 1), (1, "b", 2), (None, "x", 3), (2, "c", 4)]
    df = spark.createDataFrame(rows, "k long, v string, _row long")
    store.create_table("kv", {"k": "bigint", "v": "text"}, ["k"])
    r = store.upsert("kv", df, ["k"], ts=T0)
    assert (r["rows_inserted"], r["duplicates"], r["null_keys"]) == (2, 1, 1)
    got = {x["k"]: x["v"] for x in store.read("kv").collect()}
    assert got == {1: "b", 2: "c"}


def test_insert_ignore_and_purge(spark, tmpdir_path):
    store = new_store(spark, tmpdir_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    L.one_time_load(store, "kv", df, key_columns=["k"], now=T0)
    n = store.insert_ignore("kv", spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string"), ["k"], ts=T1)
    assert n == 1
    assert {x["k"]: x["v"] for x in store.read("kv").collect()} == {1: "a", 2: "b", 3: "c"}
    assert L.purge_by_date(store, T0.date(), dry_run=True) == ["kv"]
    L.purge_by_date(store, T0.date(), dry_run=False)
    assert not store.exists("kv")
    assert store.read("tables_metadata").where(F.col("table_name") == "kv").count() == 0


def test_a_rewrite_that_fails_leaves_a_whole_table(spark, tmpdir_path, monkeypatch):
    db = f"db_{uuid.uuid4().hex[:12]}"
    store = TableStore(spark, db, os.path.join(tmpdir_path, "wh"))
    store.create_table("t", {"k": "BIGINT", "v": "INTEGER"}, ["k"])
    store.append("t", spark.createDataFrame([(1, 2), (3, 4)], "k long, v int"))
    rows = lambda s: sorted((r.k, r.v) for r in s.read("t").collect())
    wide = spark.createDataFrame([], "k long, v string").schema
    for stop in ("__next` RENAME", f"DROP TABLE `{db}`.`t__before"):     # after the old table moved, and before it is dropped
        plain = spark.sql

        def failing(text, *a, stop=stop, plain=plain, **b):
            if stop in text:
                raise RuntimeError("lost")
            return plain(text, *a, **b)

        monkeypatch.setattr(spark, "sql", failing, raising=False)
        try:
            store.replace_schema("t", wide)
            raise AssertionError("should have failed")
        except RuntimeError:
            pass
        monkeypatch.undo()
        again = TableStore(spark, db, os.path.join(tmpdir_path, "wh"))
        assert again.tables() == ["t"] and [(int(k), int(v)) for k, v in rows(again)] == [(1, 2), (3, 4)]
    assert again.schema("t")["v"].dataType.simpleString() == "string"     # the second failure came after the switch
    again.append("t", spark.createDataFrame([(5, "x")], "k long, v string"))
    assert len(rows(again)) == 3


def test_merge_and_counts_share_one_join(spark):
    """The joined rows are held once, and period keys are made once per period."""
    from sheaf.functions import periods
    from sheaf.operators import upsert as U
    from sheaf.session import keep

    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y"), (None, "z")], "k long, v string")
    res = U.upsert_merge(old, new, ["k"], order=None, hold=keep)
    plain = U.upsert_merge(old, new, ["k"], order=None)
    assert "Join" not in res.counts._jdf.queryExecution().optimizedPlan().toString()
    assert plain.counts._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert res.counts.first() == plain.counts.first() and res.counts.first().asDict() == dict(
        inserted=1, updated=1, unchanged=2, duplicates=1, null_keys=1)
    assert sorted(res.merged.collect(), key=str) == sorted(plain.merged.collect(), key=str)
    p = spark.createDataFrame([("2020",), ("2019",), ("2020",), (None,)], "year string")
    bounds = periods.period_bounds(p, "year")
    assert bounds._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2    # periods, then their bounds
    assert tuple(bounds.first()) == ("2019", "2020")
