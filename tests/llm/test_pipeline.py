"""The pipeline on planted cases, and every stage on edge rows."""
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_their_own_rules(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    passage = " ".join(f"passage{i}" for i in range(60))
    item = duckdb.sql(f"SELECT text FROM '{SF_SMALL}/benchmark.parquet' WHERE length(text) > 150 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    clean = lambda n: " ".join(f"clean{n}x{i}" for i in range(40))
    long_text = " ".join(f"word{i}" for i in range(400))
    planted = [(10 ** 6 + i, t) for i, t in enumerate([
        clean(1), clean(2) + "\n" + passage, clean(3) + "\n" + passage, clean(4) + " " + item, long_text, long_text + " again", clean(5), clean(5)])]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], SCHEMA)
    out = docs.unionByName(extra)
    kept = {}
    for n, (name, stage) in enumerate(P.STAGES):
        path = f"{tmpdir_path}/{n}"
        stage(spark, out, SF_SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != P.STAGES[-1][0]:
            assert out.columns == list(P.COLUMNS)
        if name == "line_dedup":
            text = {r.doc_id: r.text for r in out.where("doc_id >= 1000000").collect()}
            assert passage in text[10 ** 6 + 1] and text[10 ** 6 + 2] == clean(3)
            assert out.where(F.col("n_chars") != F.length("text")).where("doc_id >= 1000000").count() == 0
    base = 10 ** 6
    assert {base, base + 1, base + 2, base + 6} <= kept["byte_bpe"]
    assert base + 3 in kept["simhash_near_dedup"] and base + 3 not in kept["decontamination"]
    assert base + 7 not in kept["simhash_near_dedup"]
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF_SMALL}/labels.parquet' WHERE toxic = 0").fetchall()}
    assert len(toxic & kept["toxicity"]) >= 0.97 * len(toxic)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0),
                                       (3, "x " * 1000, "en", "s", 5), (3, "y", "en", "s", 5)]])
def test_edge_rows(spark, rows, tmpdir_path):
    for n, (name, stage) in enumerate(P.STAGES):
        docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", score string")
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmpdir_path}/{name}")
        got = spark.read.parquet(f"{tmpdir_path}/{name}").count()
        assert got == 0 if not rows else got > 0


def test_run_is_the_last_stage(spark):
    got = P.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 0


def test_rows_are_told_apart_by_id_and_text(spark):
    item = duckdb.sql(f"SELECT text FROM '{SF_SMALL}/benchmark.parquet' WHERE length(text) > 150 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    t = [" ".join(f"text{n}x{i}" for i in range(60)) for n in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]),  # unique texts without an id, one of them twice
            (None, t[2]), (5, t[2]),                   # a copy without an id
            (2, t[3]), (2, t[4]), (7, t[4]),           # one id with two texts, the smallest of a component
            (8, t[5]), (3, t[5]), (8, t[6]),           # one text a copy of another document's, one its own
            (9, t[7]), (9, t[7]), (9, t[8])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], SCHEMA)
    told = lambda *r: sorted((str(i), str(x)) for i, x in r)
    found = lambda d: told(*[(r.doc_id, r.text) for r in d.collect()])
    stages = dict(P.STAGES)
    assert found(stages["simhash_near_dedup"](spark, docs, SF_SMALL)) == told(
        (None, t[0]), (None, t[1]), (5, t[2]), (2, t[3]), (2, t[4]), (3, t[5]), (8, t[6]), (9, t[7]), (9, t[8]))
    leaks = [(None, f"{t[0]} {item}"), (None, t[1]), (None, None), (4, f"{t[2]} {item}"), (4, t[3]), (4, t[3])]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in leaks], SCHEMA)
    assert found(stages["decontamination"](spark, docs, SF_SMALL)) == told((None, t[1]), (None, None), (4, t[3]), (4, t[3]))
