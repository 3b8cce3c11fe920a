import os

import pandas as pd
from pyspark.sql import functions as F

from sheaf.sources import delimited as DL
from tests.conftest import SF_SMALL


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_dialects_headers_and_frames(spark, tmpdir_path):
    o = pd.read_parquet(f"{SF_SMALL}/orders.parquet").head(40)
    files = {}
    for d, name in [(",", "comma.csv"), ("|", "pipe.csv"), ("\t", "tab.csv"), (";", "semi.csv"), (":", "colon.csv")]:
        lines = [d.join(["key", "customer", "status", "price"])]
        lines += [d.join([str(r.o_orderkey), str(r.o_custkey), r.o_orderstatus, f"{r.o_totalprice:.2f}"])
                  for r in o.itertuples()]
        p = os.path.join(tmpdir_path, name)
        _write(p, "\n".join(lines) + "\n")
        files[p] = d
    # sep= directive, two header rows and a numbering row
    p = os.path.join(tmpdir_path, "directive.csv")
    body = ["sep=|", "Trade|Unit value index|Unit value index", "Year|Exports|Imports", "1|2|3"]
    body += [f"{2020 + i}|{100 + i}.5|{90 + i}.25" for i in range(5)]
    _write(p, "\n".join(body) + "\n")
    files[p] = "|"
    scan = DL.scan_delimited(spark, [os.path.join(tmpdir_path, "*.csv")])
    got = {r["_file"].replace("file:", ""): (r["delimiter"], r["skip_rows"]) for r in scan.dialect.collect()}
    for p, d in files.items():
        assert got[p][0] == d, (p, got[p])
    assert got[os.path.join(tmpdir_path, "directive.csv")][1] == 1
    hdr = {r["_file"].replace("file:", ""): r["header_rows"] for r in scan.headers.collect()}
    assert hdr[os.path.join(tmpdir_path, "comma.csv")] == 1
    assert hdr[os.path.join(tmpdir_path, "directive.csv")] == 2
    f = scan.frame("file:" + os.path.join(tmpdir_path, "directive.csv"))
    assert f.columns[2:] == ["Trade_Year", "Unit value index_Exports", "Unit value index_Imports"]
    rows = f.orderBy("_row").collect()
    assert [r["Trade_Year"] for r in rows] == ["1", "2020", "2021", "2022", "2023", "2024"]
    c = scan.frame("file:" + os.path.join(tmpdir_path, "tab.csv"))
    assert c.columns[2:] == ["key", "customer", "status", "price"]
    assert c.count() == 40
    assert [r["key"] for r in c.orderBy("_row").limit(3).collect()] == [str(k) for k in o.o_orderkey[:3]]


def test_row_numbers_dense_across_blocks(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "big.csv")
    _write(p, "\n".join(f"{i},{i * 2}" for i in range(200000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = DL.read_lines(spark, p)
        assert lines.rdd.getNumPartitions() > 3
        bad = lines.where(F.split("line", ",")[0].cast("long") != F.col("_row")).count()
        assert bad == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_input_filter(spark):
    df = spark.createDataFrame([("a.csv",), ("b.XLSX",), ("c.pdf",), ("noext",)], "path string")
    ok, bad = DL.split_input(df)
    assert sorted(r[0] for r in ok.collect()) == ["a.csv", "b.XLSX"]
    assert sorted(r[0] for r in bad.collect()) == ["c.pdf", "noext"]
