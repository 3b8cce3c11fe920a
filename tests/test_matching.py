"""J9 vectors with a maintained catalog, their exact search, and the ladder on candidates that
the library makes itself."""
import math
import os
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.operators import vectors as V
from sheaf.plans import matching as M
from sheaf.sources.store import TableStore


@pytest.fixture()
def store(spark, tmpdir_path):
    return TableStore(spark, f"db_{uuid.uuid4().hex[:12]}", os.path.join(tmpdir_path, "wh"))


def _texts(seed, n, names="t"):
    rnd = random.Random(seed)
    topics = [[f"w{t}x{k}" for k in range(25)] for t in range(6)]
    return {f"{names}{i}": " ".join(rnd.choices(topics[i % 6], k=rnd.randint(0, 40)) + ["common"] * rnd.randint(0, 3)) for i in range(n)}


def _vectors(counts, df, n):
    out = {}
    for name, tf in counts.items():
        w = {t: c * math.log((n + 1) / df.get(t, 1)) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if norm:
            out[name] = {t: x / norm for t, x in w.items()}
    return out


def _cosine(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


def test_catalog_follows_its_loads(spark, store):
    cat = V.VectorCatalog(store)
    state = {}
    steps = [_texts(1, 20), {"t3": "common other words", "t5": "", "new": "common common"}, {"t3": "common other words"}]
    for step in steps:
        state |= step
        cat.update(spark.createDataFrame(list(step.items()), "table_name string, text string"))
        counts = {k: Counter(v.split()) for k, v in state.items() if v}
        whole = V.text_buckets(spark.createDataFrame(list(state.items()), "id string, text string"), "id", "text")
        assert sorted(map(tuple, cat.terms().collect())) == sorted(map(tuple, whole.collect()))
        assert {tuple(r) for r in cat.frequencies().collect()} == {tuple(r) for r in whole.groupBy("bucket").count().collect()}
        assert cat.tables() == len(counts)


@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_search_is_exact(spark, store, threshold):
    tables, files = _texts(2, 60), _texts(3, 40, "f") | {"same": _texts(2, 60)["t7"], "none": "", "odd": "never seen"}
    cat = V.VectorCatalog(store)
    cat.update(spark.createDataFrame(list(tables.items()), "table_name string, text string"))
    counts = {k: Counter(v.split()) for k, v in tables.items() if v.split()}
    df = Counter(t for c in counts.values() for t in c)
    theirs = _vectors(counts, df, len(counts))
    mine = _vectors({k: Counter(v.split()) for k, v in files.items()}, df, len(counts))
    exp = set()
    for f, a in mine.items():
        best = sorted((-round(_cosine(a, b), 9), t) for t, b in theirs.items() if _cosine(a, b) >= threshold)
        exp |= {(f, t, k + 1, round(-s, 6)) for k, (s, t) in enumerate(best[:5])}
    got = cat.candidates(spark.createDataFrame(list(files.items()), "file_id string, text string"), threshold)
    assert {(r.file_id, r.table_name, r["rank"], round(r.score, 6)) for r in got.collect()} == exp and exp


def test_ladder_on_candidates_of_all_four_sources(spark, store):
    cols = {"prices": ["state", "crop", "price_jan_2024", "grade", "market"], "banks": ["bank", "branch", "loans", "deposits"],
            "rain": ["district", "station", "rain_mm", "days"]}
    text = {k: f"Table: {k}\nColumns: " + " ".join(v) + f"\nRow: {k} sample {k} values" for k, v in cols.items()}
    cat = V.VectorCatalog(store)
    cat.update(spark.createDataFrame(list(text.items()), "table_name string, text string"))
    files = [("f1", "Banks", "nothing alike"), ("f2", "rain_2025", text["rain"]), ("f3", "market_prices", "quite other words"),
             ("f4", "wholly_new", "unseen"), ("f5", "new_too", "unseen as well"), ("f6", "other", "alone")]
    columns = {"f1": ["bank", "branch", "loans", "deposits"], "f2": ["district", "station", "rain_mm", "days"],
               "f3": ["state", "crop", "price_feb_2025", "grade", "market"], "f4": ["alpha", "beta", "gamma"],
               "f5": ["alpha", "beta", "gamma", "delta"], "f6": ["omega"]}
    fdf = spark.createDataFrame(files, "file_id string, file_table string, text string")
    cdf = spark.createDataFrame([(f, c) for f, cs in columns.items() for c in cs], "file_id string, col string")
    kdf = spark.createDataFrame([(t, c) for t, cs in cols.items() for c in cs], "table_name string, col string")
    cand = M.match_candidates(fdf, cdf, cat, kdf)
    by = {(r.file_id, r.source): (r.table_name, round(r.match_pct, 2)) for r in cand.where("rank = 1").collect()}
    assert by["f1", "exact"] == ("banks", 100.0) and by["f2", "vector"] == ("rain", 100.0)
    assert by["f3", "column"] == ("prices", 100.0) and by["f5", "peer"][0] == "wholly_new"
    got = {r.file_id: (r.target_table, r.matched_by, r.is_incremental) for r in M.match_files(fdf, cdf, cat, kdf).collect()}
    assert got == {"f1": ("banks", "exact", True), "f2": ("rain", "vector", True), "f3": ("prices", "column", True),
                   "f4": (None, None, False), "f5": ("wholly_new", "peer", True), "f6": (None, None, False)}
    no = spark.createDataFrame([("f2", "rain", False, 0.95)], "file_id string, table_name string, is_related boolean, confidence double")
    assert {r.file_id: r.matched_by for r in M.match_files(fdf, cdf, cat, kdf, no).where(F.col("file_id") == "f2").collect()} == {"f2": None}
