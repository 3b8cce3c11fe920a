import json
import os

from pyspark.sql import functions as F

from sheaf.operators import decide as D
from sheaf.operators import hierarchy as HI
from sheaf.operators import profile as P
from sheaf.operators import schema as SC
from sheaf.operators import sheets as X
from sheaf.operators import signatures as SG
from sheaf.operators import similarity as S
from sheaf.sources import workbook as WB
from sheaf.session import table
from tests.conftest import SF_SMALL


def test_xlsx_roundtrip_tiled_and_merged(spark, tmpdir_path):
    rows = [["Stock exchange turnover"], [], ["Period", "BSE", None, None, "NSE", None],
            ["Period", "Turnover", "Trades", None, "Turnover", "Trades"]]
    for i in range(6):
        rows.append([f"Q{i % 4 + 1}-{2020 + i // 4}", 100 + i, 10 + i, None, 200 + i, 20 + i])
    rows += [[], ["Source: exchanges"]]
    path = os.path.join(tmpdir_path, "tiles.xlsx")
    WB.write_xlsx(path, {"Turnover": rows}, merges={"Turnover": ["B3:C3", "E3:F3"]})
    cells, merges = WB.scan_workbooks(spark, tmpdir_path)
    filled = X.fill_merged(cells, merges)
    assert filled.where((F.col("row") == 3) & (F.col("col") == 3)).first()["value"] == "BSE"   # X1
    subs = X.analyze_sheets(cells, merges).orderBy("sub_ord").collect()
    assert len(subs) == 2 and all(s.horizontal_split for s in subs)                          # X13
    assert [s.label for s in subs] == ["BSE", "NSE"]
    assert subs[0].header_values == [["Period", "Turnover", "Trades"]]
    assert subs[1].header_values == subs[0].header_values
    assert (subs[0].data_start_row, subs[0].data_end_row) == (5, 10)
    assert subs[0].title == "Stock exchange turnover"


def test_stacked_banners_base_year_and_mergeable(spark, tmpdir_path):
    hdr = ["State", "FY 2019-20", "FY 2020-21", "FY 2021-22"]   # pure-digit cells are not labels
    body = [["A", 1, 2, 3], ["B", 4, 5, 6]]
    rows = [["Base Year : 2011-12"], hdr] + body + [[], ["Current Prices"], hdr] + body
    path = os.path.join(tmpdir_path, "gsdp.xlsx")
    WB.write_xlsx(path, {"GSDP": rows})
    cells, merges = WB.scan_workbooks(spark, tmpdir_path)
    subs = X.analyze_sheets(cells, merges)
    got = subs.orderBy("sub_ord").select("base_year", "label").collect()
    assert [(r.base_year, r.label) for r in got] == [("2011-12", None), ("2011-12", "Current Prices")]  # X12
    assert X.mergeable(subs).first()["mergeable"]
    names = X.header_names(subs).where(F.col("sub_ord") == 1).first()["names"]
    st = X.stacked_table(cells, subs, names, merges)
    assert st.count() == 4 and set(st.columns) >= {"State", "FY 2019-20", "base_year", "price_type"}


def _brute_groups(sets, t):
    order = sorted(sets)
    assigned, groups = set(), {}
    for a in order:
        if a in assigned:
            continue
        groups[a] = (a, "anchor")
        assigned.add(a)
        for b in order:
            if b in assigned:
                continue
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) / u >= t:
                groups[b] = (a, "member")
                assigned.add(b)
    return groups


def test_greedy_groups_match_sequential_rule(spark):
    docs = table(spark, SF_SMALL, "documents")
    sets_df = S.text_column_sets(docs, "doc_id", "text")
    sets = {}
    for r in sets_df.collect():
        sets.setdefault(r.set_id, set()).add(r.col)
    for t in (0.9, 0.5):
        edges = S.jaccard_pairs(sets_df, t)
        nodes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
        got = {r.id: (r.anchor_id, r.role) for r in S.greedy_groups(nodes, edges).collect()}
        assert got == _brute_groups(sets, t)
        classes, links = S.jaccard_links(sets_df, t)
        got = {r.id: (r.anchor_id, r.role) for r in S.greedy_class_groups(nodes, classes, links).collect()}
        assert got == _brute_groups(sets, t)


def test_equal_sets_make_no_pairs(spark):
    """A thousand equal sets and a few near ones: rows grow with the sets, not their pairs."""
    sets = spark.range(1000).select(F.col("id").alias("set_id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string"))).alias("col"))
    near = spark.range(1000, 1003).select(F.col("id").alias("set_id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda x: x.cast("string"))).alias("col"))
    nodes = spark.range(1004).select("id", (-F.col("id")).alias("ord"))     # the last first; 1003 has no columns
    classes, links = S.jaccard_links(sets.unionByName(near))
    assert {tuple(r) for r in links.select("a", "b").collect()} == {(0, 1000)}
    got = S.greedy_class_groups(nodes, classes, links).groupBy("anchor_id", "role").count().collect()
    assert {tuple(r) for r in got} == {(1003, "anchor", 1), (1002, "anchor", 1), (1002, "member", 1002)}


def test_match_ladder_guards_and_override(spark):
    c = spark.createDataFrame([
        ("f1", "cpi_india_mth", "vector", 1, 0.95, 80.0, "cpi_india_mth_new"),
        ("f1", "cpi_state_mth", "column", 1, 0.70, 90.0, "cpi_india_mth_new"),
        ("f2", "iip_india_mth", "vector", 2, 0.90, 99.0, "iip_x"),        # vector counts at rank 1 only
        ("f2", "iip_india_yr", "column", 1, 0.60, 40.0, "iip_x"),         # below 60 %
        ("f3", "gdp_india_qtr", "exact", 1, 1.0, 100.0, "gdp_india_qtr"),
        ("f4", "wpi_india_mth", "column", 1, 0.8, 96.0, "wpi_india_mth")],
        "file_id string, table_name string, source string, rank int, score double, match_pct double, file_table string")
    dec = spark.createDataFrame([("f1", "cpi_india_mth", False, 0.95), ("f4", "wpi_india_mth", False, 0.5)],
                                "file_id string, table_name string, is_related boolean, confidence double")
    got = {r.file_id: (r.target_table, r.matched_by) for r in D.match_ladder(c, dec).collect()}
    assert got == {"f1": ("cpi_state_mth", "column"), "f2": (None, None), "f3": ("gdp_india_qtr", "exact"),
                   "f4": ("wpi_india_mth", "column")}   # f4: rejected, but 96 % overlap overrides (D3)


def test_manual_modes_and_routing(spark):
    files = spark.createDataFrame([("a", "otl", "X"), ("b", "inc", "Sales Data"), ("c", "inc", "missing")],
                                  "file_id string, sql_mode string, table_name_override string")
    cat = spark.createDataFrame([("sales_data",)], "table_name string")
    got = {r.file_id: (r.target_table, r.is_incremental, r.error) for r in D.manual_modes(files, cat).collect()}
    assert got["a"] == (None, False, None) and got["b"] == ("sales_data", True, None)
    assert got["c"][2].startswith("target table does not exist")
    dec = spark.createDataFrame([("a", True, "DUPLICATE", True), ("b", True, "PARTIAL_OVERLAP", True),
                                 ("c", False, None, None)],
                                "file_id string, is_incremental boolean, dup_status string, is_compatible boolean")
    got = {r.file_id: r.status for r in D.route(dec).collect()}
    assert got == {"a": "duplicate_data_detected", "b": "schema_mismatch", "c": "awaiting_approval"}


def test_hierarchy_small_fixture(spark):
    rows = [(0, "A", "Public sector", None), (1, "I", "Large banks", None), (2, "1", "Bank one", "10"),
            (3, "2", "Bank two", "20"), (4, "II", "Small banks", None), (5, "1", "Bank three", "5"),
            (6, None, "Total", "35"), (7, "B", "Private sector", None), (8, "1", "Bank four", "7"),
            (9, None, "Notes: provisional", None)]
    df = spark.createDataFrame(rows, "_row long, sr string, name string, amount string").withColumn("_file", F.lit("f"))
    idx, label = HI.structural_columns(df)
    assert (idx, label) == ("sr", "name")
    for slices in (1, 3, 20):        # the carry gives the same answer for any number of slices
        out = HI.flatten(df, levels=2, slices=slices, index_col=idx, label_col=label)
        got = [(r.name, r.level_0, r.level_1) for r in out.orderBy("_row").collect()]
        assert got == [("Bank one", "Public sector", "Large banks"), ("Bank two", "Public sector", "Large banks"),
                       ("Bank three", "Public sector", "Small banks"), ("Bank four", "Private sector", None)]
    cat = HI.table_category(HI.classify_rows(df, idx, label)).first()
    assert cat.category == 2


def test_profiles_labels_descriptions(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "a", None)], "_row long, a string, b string")
    prof = {r.column_name: (r.null_count, r.samples) for r in P.column_profile(df).collect()}
    assert prof == {"a": (2, ["a"]), "b": (2, ["x"])}
    assert {r.column_name for r in P.mostly_empty_columns(df).collect()} == {"a", "b"}
    tabs = spark.createDataFrame([("cpi_india_mth", ["inflation", "index"]), ("gst_collections", ["state"]),
                                  ("misc_x", ["foo"])], "table_name string, columns array<string>")
    toks = P.name_tokens_frame(tabs)
    got = {r.table_name: r.label for r in P.classify_labels(toks, P.DOMAINS, P.DEFAULT_DOMAIN).collect()}
    assert got == {"cpi_india_mth": "CPI", "gst_collections": "GST", "misc_x": "IIP"}
    maj = {r.table_name: r.label for r in P.classify_labels(toks, P.MAJOR_DOMAINS, P.DEFAULT_MAJOR_DOMAIN).collect()}
    assert maj["misc_x"] == "Economy and Financial Indicators"
    d = spark.createDataFrame([("t", 10, ["a", "b"], "a", "2020", "2024")],
                              "table_name string, rows_count long, columns array<string>, period_col string, "
                              "first_value string, last_value string")
    assert P.describe(d).first()[1] == "Table t with 10 rows and 2 columns: a, b. Period column a covers 2020 to 2024."


def test_signature_text_and_backfill(spark):
    df = spark.createDataFrame([(i, f"v{i}", 2020 + i) for i in range(8)], "_row long, name string, sales_dec_2025 int")
    built = SG.build_signature(df, "amfi_dec_2025", {"name": "text", "sales_dec_2025": "integer"})
    sig = built.first().asDict()
    assert sig["row_count"] == 8 and len(sig["sample_rows"]) == 5
    assert json.loads(sig["sample_rows"][0]) == {"name": "v0", "sales_dec_2025": 2020}
    txt = SG.signature_text(built).first()["text"]
    assert txt.splitlines()[0] == "Table: amfi" and "  - sales: integer" in txt and "  Row 1: name=v0, sales_dec_2025=2020" in txt and txt.endswith("Total Rows: 8")
    cat = spark.createDataFrame([("a",), ("b",), ("tables_metadata",)], "table_name string")
    sigs = spark.createDataFrame([("a",)], "table_name string")
    assert [r[0] for r in SG.backfill_candidates(cat, sigs).collect()] == ["b"]


def test_reconcile_and_report(spark):
    pairs = spark.createDataFrame([("n", "t")], "new_id string, table_id string")
    new = spark.createDataFrame([("n", c) for c in ["year", "state", "fiscal_year", "extra"]], "set_id string, col string")
    old = spark.createDataFrame([("t", c) for c in ["year", "state", "period", "ingested_at"]], "set_id string, col string")
    cand = spark.createDataFrame([("n", "t", "period", "fiscal_year", 1), ("n", "t", "period", "extra", 2)],
                                 "new_id string, table_id string, existing string, new string, ord int")
    rec = SC.reconcile_pairs(cand)
    assert [(r.existing, r.new) for r in rec.collect()] == [("period", "fiscal_year")]      # M3 1:1
    more = spark.createDataFrame([("n", "t", "a", "x", 1), ("n", "t", "a", "y", 2), ("n", "t", "b", "y", 3)], cand.schema)
    assert [(r.existing, r.new) for r in SC.reconcile_pairs(more).collect()] == [("a", "x"), ("b", "y")]
    d = SC.schema_diff_lists(pairs, new, old, reconciled=rec).first()
    assert (d.missing, d.extra, d.match_pct, d.is_compatible, d.is_additive) == ([], ["extra"], 100.0, False, True)
    rep = {(r.section, r.column_name) for r in SC.discrepancy_report(SC.schema_diff_lists(pairs, new, old)).collect()}
    assert ("missing", "period") in rep and ("extra", "extra") in rep


def test_cosine_topk_exact(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).astype("float32")
    corpus = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id long, embedding array<float>")
    q = spark.createDataFrame([(100 + i, m[i].tolist()) for i in range(3)], "qid long, embedding array<float>")
    got = SG.cosine_topk(corpus, q, k=3, threshold=None).where(F.col("rank") == 1).collect()
    assert sorted((r.qid, r.id) for r in got) == [(100, 0), (101, 1), (102, 2)]


def _cells(spark, rows):
    kinds = {str: "s", int: "n", float: "n"}
    return spark.createDataFrame([("b.xlsx", "S", r, c, str(v), kinds[type(v)]) for r, line in enumerate(rows, 1)
                                  for c, v in enumerate(line, 1) if v is not None],
                                 "_file string, sheet string, row int, col int, value string, kind string")


def test_header_scan_goes_on_past_a_leading_numeric_row(spark):
    rows = [[10, 20, 30, 40], ["State", "North", "South", "West"], ["A", 1, 2, 3], ["B", 3, 4, 5]]
    sub = X.analyze_sheets(_cells(spark, rows)).collect()
    assert [(s.header_rows, s.data_start_row, s.data_end_row) for s in sub] == [([2], 3, 4)]        # X6


def test_header_grid_blank_names_and_footers(spark):
    rows = [["Table 1"], [], ["Region", "Output", None, "Total"], [None, "North", "South", "All"], [1, 2, 3, 4],
            ["A", 1, 2, 3], ["B", 4, 5, 9], [],
            ["Figures for the latest year are estimates that may still change a little"], ["Source: office"]]
    cells = _cells(spark, rows)
    sub = X.analyze_sheets(cells).collect()
    assert [(s.header_rows, s.col_number_row, s.data_start_row, s.data_end_row) for s in sub] == [([3, 4], 5, 6, 7)]
    assert sub[0].header_values == [["Region", "Output", None, "Total"], ["Region", "North", "South", "All"]]   # X9
    assert X.header_names(X.analyze_sheets(cells)).first()["names"] == ["Region", "Output_North", "South", "Total_All"]
    last = X.last_data_rows(cells).first()
    assert (last.last_data_row, last.footer_start) == (7, 9)                                          # X8
    names = spark.createDataFrame([("f", "s", 1, [["a", None]])],
                                  "_file string, sheet string, sub_ord int, header_values array<array<string>>")
    assert X.header_names(names).first()["names"] == ["a", "column_1"]                                # H3


def test_paren_year_is_a_fallback_and_banners_reset(spark):
    wide = ["Accounts (1999-00)"] * 4
    hdr = ["State", "North", "South", "West"]
    rows = [wide, ["(₹ Crores)"], hdr, ["A", 1, 2, 3], [], ["constant prices"], ["Base year: 2004-05"], hdr, ["B", 1, 2, 3]]
    sub = X.analyze_sheets(_cells(spark, rows)).orderBy("sub_ord").collect()
    assert [(s.base_year, s.label, s.unit) for s in sub] == [("1999-00", None, "₹ Crores"), ("2004-05", "Constant Prices", None)]


def test_batch_approval_follows_chains_of_increments(spark):
    import datetime as dt

    from sheaf.plans import jobs as G
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, "awaiting_approval", day(9), False, "", None, "T1"), (2, "schema_mismatch", day(2), True, "t", 1, "a"),
            (3, "schema_mismatch", day(3), True, "t", 2, "b"), (4, "schema_mismatch", day(1), True, "t", 3, "c"),
            (5, "schema_mismatch", day(5), True, "t", 4, "d"), (6, "schema_mismatch", day(6), True, "t", 99, "e"),
            (7, "awaiting_approval", day(7), True, " ", 8, "F"), (8, "failed", day(1), False, None, None, "g"),
            (9, "schema_mismatch", day(8), True, "t", 8, "h")]
    jobs = spark.createDataFrame(rows, "job_id long, status string, created_at timestamp, is_incremental_load boolean, "
                                 "matched_table_name string, peer_anchor_job_id long, proposed_table_name string")
    got = {r.job_id: (r.action, r.approval_order, r.table_name) for r in G.batch_approval(jobs).collect()}
    assert got == {1: ("approve", 1, "t1"), 4: ("skip", 2, "t"), 2: ("approve", 3, "t"), 3: ("approve", 4, "t"),
                   5: ("skip", 5, "t"), 6: ("approve", 6, "t"), 7: ("approve", 7, "f"), 9: ("skip", 8, "t")}


def test_greedy_groups_on_a_chain(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(9)], "id long, ord long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    got = {r.id: (r.anchor_id, r.role) for r in S.greedy_groups(nodes, edges).collect()}
    assert got == {i: (i, "anchor") if i % 2 == 0 else (i - 1, "member") for i in range(9)}


def test_samples_are_taken_from_whole_columns(spark):
    from sheaf.functions import types as TY
    df = spark.range(3000).select(F.col("id").alias("_row"), F.when(F.col("id") >= 1500, F.col("id").cast("string")).alias("late"))
    assert [r.inferred_type for r in TY.infer_types(df).collect()] == ["BIGINT"]
    assert P.column_profile(df).first().samples == [str(1500 + i) for i in range(10)]


def test_workbook_dates_and_single_cell_merges(spark, tmpdir_path):
    import datetime as dt
    rows = [["when", "n"], [dt.date(2024, 1, 1), 45292], [dt.datetime(2024, 3, 1, 6, 30), 1.5]]
    WB.write_xlsx(os.path.join(tmpdir_path, "d.xlsx"), {"S": rows}, merges={"S": ["A1", "A1:B1"]})
    cells, merges = WB.scan_workbooks(spark, tmpdir_path)
    got = {(r.row, r.col): (r.value, r.kind) for r in cells.collect()}
    assert got[2, 1] == ("2024-01-01", "d") and got[3, 1] == ("2024-03-01 06:30:00", "d")
    assert got[2, 2] == ("45292", "n") and got[3, 2] == ("1.5", "n") and got[1, 1] == ("when", "s")
    assert [(m.min_row, m.max_col) for m in merges.collect()] == [(1, 2)]
    assert [WB._is_date_format(f) for f in ("yyyy-mm", '0.00"days"', "[h]:mm", "[Red]0", "General")] == [True, False, True, False, False]


def test_preview_block_and_increment_validation(spark):
    df = spark.createDataFrame([(0, None, 1), (1, "a", 2), (2, "b", 3), (3, "c", 4), (4, "d", 5)], "_row long, s string, n int")
    got = {r.column_name: (r.type, r.sample_values, r.total_rows) for r in P.preview_block(df, {"n": "BIGINT"}).collect()}
    assert got == {"s": ("string", ["a", "b", "c"], 5), "n": ("BIGINT", ["1", "2", "3"], 5)}
    files = spark.createDataFrame([("f", "t"), ("g", "gone"), ("h", "t")], "new_id string, table_id string")
    new = spark.createDataFrame([("f", "A"), ("f", "b"), ("f", "x"), ("g", "a"), ("h", "a")], "set_id string, col string")
    cat = spark.createDataFrame([("t", ["a", "b"])], "table_name string, columns array<string>")
    out = {r.new_id: r for r in SC.validate_increment(files, new, cat).collect()}
    assert (out["f"].is_compatible, out["f"].is_additive, out["f"].extra, out["f"].match_pct) == (False, True, ["x"], 100.0)
    assert (out["h"].is_additive, out["h"].missing) == (False, ["b"]) and "b" in out["h"].report
    assert out["g"].error == "Table 'gone' not found in metadata" and not out["g"].is_compatible


def test_hierarchy_years_beyond_roman_numerals():
    from sheaf.plans.queries_hierarchy import roman
    assert [roman(n) for n in (1, 4, 9, 14, 39)] == ["I", "IV", "IX", "XIV", "XXXIX"]


def test_slices_spread_one_file_over_tasks(spark):
    """A third of all rows in one file, and one sort key for a third: no slice holds much
    more than its share, and numbers and carried headers are those of one long sweep."""
    from sheaf.operators import ordered as O
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 700).cast("string"))).alias("_file"),
                               F.col("id").alias("_row"), F.when(F.col("id") % 997 == 0, F.col("id")).alias("h"))
    sliced = O.range_slices(df, ["_file", "_row"], 12)
    sizes = [r[1] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * n / 12
    got = O.carry_max(sliced, "_file", "_row", {"last": F.col("h")}).where("_file = 'hot'").orderBy("_row").collect()
    last = None
    for r in got:
        last = r.h if r.h is not None else last
        assert r["last"] == last
    tied = spark.range(n).select((F.col("id") % 3 == 0).alias("k"), F.col("id"))
    rows = O.row_numbers(tied, ["k", "id"], "n", 9).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, n + 1)) and [(r.k, r.id) for r in rows] == sorted((i % 3 == 0, i) for i in range(n))
