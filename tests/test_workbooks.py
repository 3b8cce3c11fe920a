"""S4 as a data source: pruning, shared strings; X8 and X17 over books of any layout."""
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.operators import sheets as X
from sheaf.sources import workbook as WB


def _spoil(path, member):
    """Replace one sheet's XML by something that no parser accepts."""
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts[member] = b"<worksheet><broken"
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)


def test_pruned_sheets_and_books_are_not_parsed(spark, tmpdir_path):
    for b in range(3):
        WB.write_xlsx(os.path.join(tmpdir_path, f"b{b}.xlsx"), {"good": [["a", b], ["c", 1.5]], "bad": [["x"]], "other": [["y", "a"]]}, shared=b == 1)
        _spoil(os.path.join(tmpdir_path, f"b{b}.xlsx"), "xl/worksheets/sheet2.xml")
    with open(os.path.join(tmpdir_path, "b9.xlsx"), "wb") as f:
        f.write(b"no zip")
    src = WB.read_workbooks(spark, f"{tmpdir_path}/b[0-8]*.xlsx")
    good = src.where(F.col("sheet") == "good")
    assert good.rdd.getNumPartitions() == 3
    assert sorted((r._file[-7:], r.row, r.col, r.value, r.kind) for r in good.collect()) == sorted(
        (f"b{b}.xlsx", *x) for b in range(3) for x in [(1, 1, "a", "s"), (1, 2, str(b), "n"), (2, 1, "c", "s"), (2, 2, "1.5", "n")])
    assert src.where(F.col("sheet").isin("good", "other") & (F.col("col") == 2)).count() == 9
    one = src.where((F.col("_file") == f"{tmpdir_path}/b1.xlsx") & F.col("sheet").isin("other", "none"))
    assert [(r.value, r.sheet) for r in one.orderBy("col").collect()] == [("y", "other"), ("a", "other")]
    assert src.where(F.col("sheet") == "none").count() == 0
    with pytest.raises(Exception):
        src.where(F.col("sheet") == "bad").collect()


def _cells(spark, books):
    rows = [(f, s, r, c, str(v), "s" if isinstance(v, str) else "n") for f, sheets in books.items() for s, grid in sheets.items()
            for r, line in enumerate(grid, 1) for c, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(rows, "_file string, sheet string, row int, col int, value string, kind string")


A = ["State", "Crop", "Yield", "Rank"]
B = ["Bank", "Branch", "Town", "Loans"]


def test_tables_of_all_books_in_one_plan(spark):
    long = "These figures are provisional and will be revised at the end of the coming year"
    books = {
        "mixed": {"one": [A, ["x", "rice", 1, 7], ["y", "oats", 2, 7], [], B, ["m", "n", 4, 3]], "two": [["p", "q", "r", "s"], [9, 2, 3, 4]]},
        "same": {"GDP 2011-12": [A, ["x", "rice", 1, 1]], "GDP 2004-05": [A, ["z", "rye", 5, 2], ["w", "rye", 6, 1]]},
        "narrow": {"s": [["Name", "Worth"], ["a", 1], ["b", 2], [long], [], ["Notes: see annex"]]},
        "titled": {"s": [["Only a title"], [], ["Name", "Worth"], ["a", 7]]},
    }
    cells = _cells(spark, books)
    tables, rows = X.workbook_tables(cells, X.analyze_sheets(cells))
    t = {(r["_file"], r.sheet, r.sub_ord): r for r in tables.collect()}
    assert {k: v.is_primary for k, v in t.items() if k[0] == "mixed"} == {("mixed", "one", 1): True, ("mixed", "one", 2): False, ("mixed", "two", 1): False}
    assert t["mixed", "one", 2].names == B and t["mixed", "two", 1].table_key == "mixed#two#1"
    assert {v.table_key for k, v in t.items() if k[0] == "same"} == {"same"} and all(v.mergeable for k, v in t.items() if k[0] == "same")
    got = {}
    for r in rows.orderBy("sheet", "sub_ord", "row").collect():
        got.setdefault(r.table_key, []).append(r["values"])
    assert got["mixed#one#1"] == [{"State": "x", "Crop": "rice", "Yield": "1", "Rank": "7"}, {"State": "y", "Crop": "oats", "Yield": "2", "Rank": "7"}]
    assert got["mixed#one#2"] == [{"Bank": "m", "Branch": "n", "Town": "4", "Loans": "3"}]
    assert [(v["base_year"], v["State"]) for v in got["same"]] == [("2004-05", "z"), ("2004-05", "w"), ("2011-12", "x")]
    assert got["narrow#s#1"] == [{"Name": "a", "Worth": "1"}, {"Name": "b", "Worth": "2"}]      # X8: both footers cut
    # without a row of three cells the first row is the header, as for the first row of any sheet
    assert t["titled", "s", 1].names == ["Only a title"] and [v["Only a title"] for v in got["titled#s#1"]] == ["Name", "a"]


def test_many_sheets_share_tasks(spark, tmpdir_path):
    """Tasks do not follow the number of sheets; every sheet is read."""
    for b in range(20):
        WB.write_xlsx(os.path.join(tmpdir_path, f"b{b}.xlsx"), {f"s{i}": [[b * 100 + i, "x" * (i % 7)]] for i in range(40)}, shared=b % 2 == 0)
    src = WB.read_workbooks(spark, tmpdir_path)
    assert src.rdd.getNumPartitions() < 500
    assert sorted(int(r.value) for r in src.where("col = 1").collect()) == sorted(b * 100 + i for b in range(20) for i in range(40))
    assert [len(p.sheets) for p in WB.pack_sheets([("f", "s", "m", 40 << 20)] * 300)] == [1] * 300
    assert [len(p.sheets) for p in WB.pack_sheets([("f", "s", "m", 1)] * 3)] == [1] * 3
