"""Source queries. S2 runs over lines derived from the tables: every conversation is a
"file", its turns are the lines (``_row`` = turn). S1, S3 and S10 write files from the
tables into the checkpoint folder, read them back on many splits and compare with SQL
over the tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.plans.registry import register
from sheaf.session import cut_lineage, ensure_checkpoint_dir, keep, table
from sheaf.operators import sheets as X
from sheaf.sources import delimited as DL
from sheaf.sources import workbook as WB

_C = ["','", "'|'", "chr(9)", "';'", "':'"]
_SCORES = ",\n".join(
    f"CASE WHEN avg(len(string_split(text, {d}))) <= 1 THEN 0.0 ELSE avg(len(string_split(text, {d}))) / "
    f"(1 + var_pop(len(string_split(text, {d})))) END AS s{i}" for i, d in enumerate(_C))


@register("s2_delimiter_detection", f"""
WITH first AS (SELECT conv_id, text AS first FROM conversations WHERE turn = 0),
sc AS (SELECT conv_id, {_SCORES} FROM conversations WHERE turn < 20 AND trim(text) <> '' GROUP BY conv_id),
best AS (SELECT conv_id, CASE greatest(s0, s1, s2, s3, s4) WHEN s0 THEN ',' WHEN s1 THEN '|' WHEN s2 THEN chr(9)
                              WHEN s3 THEN ';' ELSE ':' END AS sniffed FROM sc)
SELECT conv_id AS _file,
       CASE WHEN lower(first) LIKE 'sep=%' AND length(trim(first)) <= 6 THEN substr(trim(first), 5, 2)
            ELSE coalesce(sniffed, ',') END AS delimiter,
       CASE WHEN lower(first) LIKE 'sep=%' AND length(trim(first)) <= 6 THEN 1 ELSE 0 END AS skip_rows
FROM first LEFT JOIN best USING (conv_id)""")
def q_sniff(spark, sf_dir):
    """Delimiter sniffing for every conversation-as-file in one aggregate."""
    cv = table(spark, sf_dir, "conversations")
    lines = cv.select(F.col("conv_id").alias("_file"), F.col("turn").alias("_row"), F.col("text").alias("line"))
    return DL.detect_dialect(lines)


@contextmanager
def small_splits(spark, size: str):
    """Read with splits of ``size``, so that files of test size have several."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_files(lines: DataFrame, key: str, order: list[str], n: int) -> str:
    """``line`` of all rows as text files, one folder per value of ``key``."""
    folder = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/sheaf-files-{uuid.uuid4().hex}"
    (lines.repartition(min(n, 200), key).sortWithinPartitions(key, *order).select(key, "line")
     .write.partitionBy(key).text(folder))
    return folder


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


@register("s1_quoted_records", """
WITH n AS (SELECT 8 + count(*) // 20000 AS n FROM documents)
SELECT doc_id % n AS file, row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) AS record, doc_id,
       md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') || '"q' AS lang,
       'from "' || coalesce(source, '') || '",' || chr(10) || chr(10) || ';|' AS origin
FROM documents, n""")
def q_quoted(spark, sf_dir):
    """Whole document texts with their line breaks, quotes and separators written as
    delimited files of three separators and read back record by record; quotes stay open
    over split borders, and one column has a quote inside a plain field."""
    d = table(spark, sf_dir, "documents")
    rows, size = d.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = 8 + rows // 20000
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sep = F.element_at(F.array(*[F.lit(x) for x in ",|;"]), (F.col("file") % 3 + 1).cast("int"))
    body = d.withColumn("file", F.col("doc_id") % n).select("file", F.lit(2).alias("ord"), "doc_id", F.array_join(F.array(
        *[x.cast("string") for x in (F.col("doc_id"), F.col("doc_id") % 7, F.col("doc_id") % 11, F.col("file"))], _quoted(text("text")), F.concat(text("lang"), F.lit('"q')),
        _quoted(F.concat(F.lit('from "'), text("source"), F.lit('",\n\n;|')))), "\x00").alias("line"))
    head = spark.range(n).withColumnRenamed("id", "file")
    none = F.lit(None).cast("long").alias("doc_id")
    first = head.select("file", F.lit(0).alias("ord"), none, F.concat(F.lit("sep="), sep).alias("line"))
    names = head.select("file", F.lit(1).alias("ord"), none, F.lit("id\x00seven\x00eleven\x00file\x00text\x00lang\x00origin").alias("line"))
    lines = first.unionByName(names).unionByName(body).withColumn("line", F.replace("line", F.lit("\x00"), sep))
    folder = write_files(lines, "file", ["ord", "doc_id"], n)
    with small_splits(spark, str(max(128 << 10, (size or 0) // 64))):   # several splits a file
        v = F.col("values")
        scan = DL.scan_delimited(spark, folder)
        schemas = keep(scan.schemas())
        rows = scan.rows(schemas).join(schemas.select("_file", "last_header"), "_file")
        return cut_lineage(rows.select(
            F.regexp_extract("_file", r"file=(\d+)", 1).cast("long").alias("file"), (F.col("_row") - F.col("last_header")).alias("record"),
            v["id"].cast("long").alias("doc_id"), F.md5(v["text"]).alias("text_md5"), v["lang"].alias("lang"), v["origin"].alias("origin")))


_LAYOUT = ["Order key", "Customer", "Total price", "Priority", "Year", "Month", "Status"]
_UPPER = ["Order", "Order", "Money", "Money", "Time", "Time", "State"]
_SEPS = [",", "|", "\t", ";", ":"]
_NAMES_SQL = ", ".join(f"CASE WHEN file % 3 = 0 THEN '{u}_{n}' ELSE '{n}' END" for u, n in zip(_UPPER, _LAYOUT))


@register("s10_many_layouts", f"""
WITH n AS (SELECT 1000 * (1 + count(*) // 10000000) AS n FROM orders),
o AS (SELECT o_custkey % n AS file, o_orderkey AS k, [o_orderkey::VARCHAR, o_custkey::VARCHAR,
        CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, substr(o_orderpriority, 1, 1), year(o_orderdate)::VARCHAR, month(o_orderdate)::VARCHAR,
        o_orderstatus || chr(10) || 'x"y' || [',', '|', chr(9), ';', ':'][o_custkey % n % 5 + 1]] AS cells FROM orders, n)
SELECT file, [',', '|', chr(9), ';', ':'][file % 5 + 1] AS delimiter, CASE WHEN file % 3 = 0 THEN 2 ELSE 1 END AS header_rows,
       (4 + file % 4)::INTEGER AS width, array_to_string([{_NAMES_SQL}][1:4 + file % 4], '/') AS names, count(*) AS n_rows,
       sum(k)::BIGINT AS sum_key, sum(length(array_to_string(cells[1:4 + file % 4], '')))::BIGINT AS chars,
       min(k) AS first_key, max(k) AS last_key
FROM o GROUP BY file""")
def q_layouts(spark, sf_dir):
    """A thousand files (orders of a customer group each) of five separators,
    four widths, one or two header rows, some with a directive and with cells that span
    lines, read in one plan; a row per file tells its layout and what its cells hold."""
    o = table(spark, sf_dir, "orders")
    n = 1000 * (1 + o.count() // 10_000_000)
    of_file = lambda values, by: F.element_at(F.array(*[F.lit(x) for x in values]), (by + 1).cast("int"))
    f, none = F.col("file"), F.lit(None).cast("long")
    sep, width = of_file(_SEPS, f % 5), (4 + f % 4).cast("int")
    row = lambda cells: F.array_join(F.slice(cells, F.lit(1), width), "\x00")
    body = o.withColumn("file", F.col("o_custkey") % n).select("file", F.lit(3).alias("ord"), F.col("o_orderkey").alias("k"), row(F.array(
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.substring("o_orderpriority", 1, 1), F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"),
        F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('\nx""y'), sep, F.lit('"')))).alias("line"))
    files = body.select("file").distinct()
    head = lambda at, cells, where: files.where(where).select("file", F.lit(at).alias("ord"), none.alias("k"), cells.alias("line"))
    lines = (head(0, F.concat(F.lit("sep="), sep), f % 7 == 0).unionByName(head(1, row(F.array(*map(F.lit, _UPPER))), f % 3 == 0))
             .unionByName(head(2, row(F.array(*map(F.lit, _LAYOUT))), F.lit(True))).unionByName(body)
             .withColumn("line", F.replace("line", F.lit("\x00"), sep)))
    scan = DL.scan_delimited(spark, write_files(lines, "file", ["ord", "k"], n))
    schemas = keep(scan.schemas())
    key = F.element_at(F.map_values("values"), 1).cast("long")
    told = (scan.rows(schemas).groupBy("_file").agg(
        F.sum(key).alias("sum_key"), F.sum(F.length(F.array_join(F.map_values("values"), ""))).alias("chars"),
        F.min_by(key, "_row").alias("first_key"), F.max_by(key, "_row").alias("last_key")))
    return schemas.join(told, "_file").select(
        F.regexp_extract("_file", r"file=(\d+)", 1).cast("long").alias("file"), "delimiter", "header_rows", "width",
        F.array_join("names", "/").alias("names"), "n_rows", "sum_key", "chars", "first_key", "last_key")


def write_books(rows: DataFrame, order: str, sheet: str, title) -> str:
    """A workbook per ``book`` with a sheet per value of ``sheet``: a merged title over the
    columns, a header row and the rows in the order of ``order``. Books are bounded by the
    caller's choice of ``book``; each is written whole by one task."""
    folder = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/sheaf-books-{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c not in ("book", sheet)]

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = part.sort_values(order)
        sheets = {name: [[title(name)], columns, *(list(r) for r in p[columns].itertuples(index=False))] for name, p in part.groupby(sheet)}
        merged = {name: [f"A1:{chr(64 + len(columns))}1"] for name in sheets}
        with store.open_output_stream(f"{root}/book-{key[0]}.xlsx") as f:
            WB.write_xlsx(f, sheets, merged, shared=key[0] % 2 == 0)
        return pd.DataFrame({"book": [key[0]], "sheets": [len(sheets)]})

    rows.groupBy("book").applyInPandas(write, "book long, sheets long").agg(F.sum("sheets")).collect()
    return folder


@register("s4_workbooks", """
WITH n AS (SELECT 12 + count(*) // 2000 AS n FROM orders)
SELECT o_orderkey % n AS book, o_orderstatus AS sheet, (2 + row_number() OVER (PARTITION BY o_orderkey % n, o_orderstatus ORDER BY o_orderkey))::INTEGER AS row,
       'Orders in state ' || o_orderstatus AS title, o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       CAST(o_totalprice AS DOUBLE) AS price, o_orderpriority AS priority
FROM orders, n WHERE o_orderstatus IN ('F', 'P')""")
def q_workbooks(spark, sf_dir):
    """All orders written as workbooks (a sheet per status, a merged title, dates)
    and two of the statuses read back; the sheets of the third are pruned while planning."""
    o = table(spark, sf_dir, "orders")
    n = 12 + o.count() // 2000
    folder = write_books(o.select((F.col("o_orderkey") % n).alias("book"), "o_orderstatus", F.col("o_orderkey").alias("key"),
                                  F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("price"),
                                  F.col("o_orderpriority").alias("priority")), "key", "o_orderstatus", lambda s: f"Orders in state {s}")
    cells, merges = WB.cells_and_merges(keep(WB.read_workbooks(spark, folder).where(F.col("sheet").isin("F", "P"))))
    cells = X.fill_merged(cells, merges)
    at = lambda col, of=F.col("value"): F.max(F.when(F.col("col") == col, of))
    rows = cells.where("row > 2").groupBy("_file", "sheet", "row").agg(
        at(1).cast("long").alias("order_key"), at(2).alias("order_date"), at(3).cast("double").alias("price"), at(4).alias("priority"))
    titles = cells.where("row = 1 AND col = 4").select("_file", "sheet", F.col("value").alias("title"))
    return rows.join(titles, ["_file", "sheet"]).select(
        F.regexp_extract("_file", r"book-(\d+)", 1).cast("long").alias("book"), "sheet", F.col("row").cast("int").alias("row"),
        "title", "order_key", "order_date", "price", "priority")
