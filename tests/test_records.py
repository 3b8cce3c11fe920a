"""Records with quoted line breaks against pandas, over many splits and files."""
import io
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.sources import delimited as DL


def _expected(text, sep):
    try:
        df = pd.read_csv(io.StringIO(text, newline=""), sep=sep, header=None, names=range(60), dtype=str,
                         keep_default_na=False, skip_blank_lines=False)
    except (pd.errors.ParserError, pd.errors.EmptyDataError) as e:
        return None if "EOF" in str(e) else []
    return [list(r) for r in df.itertuples(index=False)]


def _bare(cells):
    cells = list(cells)
    while cells and cells[-1] == "":
        cells.pop()
    return cells


@pytest.mark.parametrize("stretch", [2, 7, 100_000])
def test_records_like_pandas(spark, tmpdir_path, monkeypatch, stretch):
    """Quotes that open, close, double, stand in plain fields or never close; line breaks of
    both kinds; a stretch of few lines stands for a split."""
    monkeypatch.setattr(DL, "STRETCH_LINES", stretch)
    rnd = random.Random(stretch)
    texts = {}
    for i in range(60):
        sep = rnd.choice(",;|")
        pieces = ["a", "b", " ", '"', '"', '""', sep, sep, "\n", "\n", "\r\n", '"x\n', f'{sep}"', f'"{sep}', "é"]
        body = "".join(rnd.choice(pieces) for _ in range(rnd.randint(5, 80))).strip("\r\n ")
        texts[f"{i}.csv"] = (sep, body)
        with open(os.path.join(tmpdir_path, f"{i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(f"sep={sep}\n{body}\n")
    scan = DL.scan_delimited(spark, tmpdir_path)
    name = F.element_at(F.split("_file", "/"), -1).alias("name")
    got = {}
    for r in scan.records.select(name, "_row", "cells").collect():
        got.setdefault(r["name"], {})[r["_row"]] = _bare(r["cells"])
    broken = {r["name"] for r in scan.broken.select(name).collect()}
    unclosed = 0
    for file, (sep, body) in texts.items():
        exp = _expected(body + "\n", sep)
        if exp is None:
            unclosed += 1
            assert file in broken and file not in got, (file, body)
            continue
        rows = got.get(file, {})
        assert sorted(rows) == list(range(len(rows))), file
        assert [rows[k] for k in sorted(rows)] == [_bare(e) for e in exp], (file, repr(body))
    assert 5 < unclosed < 55 and len(broken) == unclosed


def test_a_quote_open_over_many_splits(spark, tmpdir_path):
    """One record spans most of the file, and hence many splits of it."""
    lines = [f'{i},"{"x" * (i % 50)}"' for i in range(3000)]
    inner = "\n".join(f"inner {i}, with ""quotes""" for i in range(20_000))
    lines[1500] = '1500,"' + inner.replace('"', '""') + '"'
    with open(os.path.join(tmpdir_path, "one.csv"), "w", newline="") as f:
        f.write("sep=,\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = DL.scan_delimited(spark, tmpdir_path)
        assert DL.read_lines(spark, tmpdir_path).rdd.getNumPartitions() > 10
        rows = {r["_row"]: r["cells"] for r in scan.records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == list(range(3000))
    assert rows[1500] == ["1500", inner] and rows[2999] == ["2999", "x" * 49]
    assert scan.broken.count() == 0


def test_many_layouts_saved_with_a_partition_per_file(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    os.mkdir(src)
    for i, sep in enumerate([",", ";", "|", "\t", ":"] * 4):
        names = [f"Name {k}" for k in range(3 + i % 3)]
        with open(os.path.join(src, f"f{i}.csv"), "w") as f:
            f.write(sep.join(names) + "\n" + "".join(sep.join(str(r * 10 + k) for k in range(len(names))) + "\n\n" for r in range(i + 1)))
    scan = DL.scan_delimited(spark, src)
    scan.save(out)
    schemas = {os.path.basename(r["_file"]): r for r in spark.read.parquet(f"{out}/schemas").collect()}
    rows = spark.read.parquet(f"{out}/rows")
    assert len(os.listdir(f"{out}/rows")) >= 20
    for i in range(20):
        s = schemas[f"f{i}.csv"]
        width = 3 + i % 3
        assert (s.width, s.n_rows, s.header_rows, list(s.names)) == (width, i + 1, 1, [f"Name {k}" for k in range(width)])
        got = [r["values"] for r in rows.where(F.col("file_key") == s.file_key).orderBy("_row").collect()]
        assert got == [{f"Name {k}": str(r * 10 + k) for k in range(width)} for r in range(i + 1)]


def test_odd_files(spark, tmpdir_path):
    for name, text in {"empty.csv": "", "blank.csv": "\n\n", "header.csv": "a,b,c\n", "wide.csv": "a,b,c\n1,2,3,4,5\n6\n",
                       "nobreak.csv": 'x,y,z\n1,"2\n3",4'}.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    scan = DL.scan_delimited(spark, tmpdir_path)
    s = {os.path.basename(r["_file"]): r for r in scan.schemas().collect()}
    assert "empty.csv" not in s and s["blank.csv"].n_rows == 0
    assert (s["header.csv"].n_rows, list(s["header.csv"].names)) == (0, ["a", "b", "c"])
    assert list(s["wide.csv"].names) == ["a", "b", "c", "Unnamed: 3", "Unnamed: 4"] and s["wide.csv"].n_rows == 2
    rows = {(os.path.basename(r["_file"]), r["_row"]): r["values"] for r in scan.rows().collect()}
    assert rows["nobreak.csv", 1] == {"x": "1", "y": "2\n3", "z": "4"}
    assert rows["wide.csv", 2] == {"a": "6"}


def test_text_is_parsed_once(spark, tmpdir_path):
    """What is asked of a scan later does not read the files again."""
    for i in range(3):
        with open(os.path.join(tmpdir_path, f"{i}.csv"), "w") as f:
            f.write('a,b,c\n1,"x\ny",z\n2,"p""q",r\n' if i else "a,b,c\n1,2,3\n")
    scan = DL.scan_delimited(spark, tmpdir_path)
    for i in range(3):
        os.remove(os.path.join(tmpdir_path, f"{i}.csv"))
    assert scan.schemas().count() == 3 and scan.rows().count() == 5
    assert sorted(r["values"]["b"] for r in scan.rows().collect()) == ["2", 'p"q', 'p"q', "x\ny", "x\ny"]


def test_cells_with_separators_of_several_characters(spark):
    df = spark.createDataFrame([('a||"b||""c"||"d"e"||', "||"), ('"', ","), ('""', ","), ('x"y,"z', ","), ("", ",")], "l string, d string")
    got = [r[0] for r in df.select(DL.split_cells(F.col("l"), F.col("d"))).collect()]
    assert got == [["a", 'b||"c', 'de"', ""], [""], [""], ['x"y', "z"], [""]]
