"""Delimited-text scan for many files at once.

* Lines: ``spark.read.text`` with the file path; a dense per-file ``_row`` comes
  from block offsets (lines per (file, block) + a prefix over the few blocks of a
  file) plus the row's index inside its block -- no window over a whole file.
* Dialect (S2): a first line ``sep=X`` wins and is skipped; otherwise every
  candidate delimiter is scored over the first 20 non-blank lines as
  ``avg / (1 + var_pop)`` of field counts (avg <= 1 scores 0); best score, ties
  to the earlier candidate, default ``,``. One aggregate for all files.
* Records (S1): quoted line breaks stay inside their record, on splittable text. Whether
  a line begins inside quotes depends on all lines before it, but each line is a small
  function of that one bit; functions are composed within each block by windows and over
  the blocks of a file by a prefix over one row a block. Files in which no line can leave
  a quote open skip all of it.
* Cells: an array per record, split by the file's own delimiter in one expression, so
  files of any delimiter and width share one plan.
* Header rows (S3): over the first 5 content records, count the leading rows that
  carry labels in >= 3 columns, skipping blank, ``1 | 2 | 3`` numbering and sparse
  section rows; 1 to 3, default 1.
* Many files (S10): ``schemas`` has a row per file with its names, ``rows`` a map from
  name to cell per record; nothing is decided on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.names import unique_name_array
from sheaf.operators.headers import merge_header_levels
from sheaf.session import keep

# ---- fixed values ------------------------------------------------------------
DELIMITER_CANDIDATES = [",", "|", "\t", ";", ":"]
SNIFF_LINES = 20
HEADER_PREVIEW_ROWS = 5
ALLOWED_EXTENSIONS = [".csv", ".xlsx"]
# ------------------------------------------------------------------------------
STRETCH_LINES = 100_000     # lines of a file that one window task sees

def split_input(paths: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by lower-cased extension."""
    ext = F.lower(F.regexp_extract(F.col(path_col), r"(\.[^./\\]+)$", 1))
    ok = ext.isin(*ALLOWED_EXTENSIONS)
    return paths.where(ok), paths.where(~ok | ext.isNull()).withColumn("reason", F.lit("unsupported file type"))


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(_file, _row, line)`` with a dense 0-based line number per file."""
    raw = (spark.read.text(paths, lineSep="\n")
           .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"),
                   F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line")))
    blk = raw.groupBy("_file", "_blk").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = blk.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (raw.join(offs, ["_file", "_blk"])
            .select("_file", (F.col("_off") + F.col("_mid") - F.col("_m0")).alias("_row"), "line"))


def _nfields(line: Column, delim: str) -> Column:
    return F.size(F.split(line, re.escape(delim), -1))


def detect_dialect(lines: DataFrame) -> DataFrame:
    """S2 per file -> ``(_file, delimiter, skip_rows)``."""
    first = lines.where(F.col("_row") == 0).select(
        "_file", F.regexp_replace(F.col("line"), r"[\r\n]+$", "").alias("first"))
    directive = F.lower(F.col("first")).startswith("sep=") & (F.length(F.trim("first")) <= 6)
    head = lines.where((F.col("_row") < SNIFF_LINES) & (F.trim(F.col("line"), F.lit(" \r")) != ""))
    aggs = []
    for i, d in enumerate(DELIMITER_CANDIDATES):
        n = _nfields(F.col("line"), d).cast("double")
        aggs += [F.avg(n).alias(f"a{i}"), F.var_pop(n).alias(f"v{i}")]
    sc = head.groupBy("_file").agg(*aggs)
    scores = [F.when(F.col(f"a{i}") <= 1, F.lit(0.0)).otherwise(F.col(f"a{i}") / (1 + F.col(f"v{i}")))
              for i in range(len(DELIMITER_CANDIDATES))]
    # best score, ties to the earlier candidate: encode (score, -position)
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("p"), F.lit(d).alias("d"))
                                 for i, (s, d) in enumerate(zip(scores, DELIMITER_CANDIDATES))]))
    sniff = sc.select("_file", best["d"].alias("sniffed"))
    j = first.join(sniff, "_file", "left")
    return j.select("_file",
                    F.when(directive, F.substring(F.trim("first"), 5, 2))
                    .otherwise(F.coalesce("sniffed", F.lit(","))).alias("delimiter"),
                    F.when(directive, F.lit(1)).otherwise(F.lit(0)).alias("skip_rows"))


def _after_text(state: Column, text: Column, delim: Column) -> Column:
    """Parser state after text without quotes. States: 0 at the start of a field, 1 in a
    plain field, 2 in quotes, 3 after a quote that ends a quoted part or is half of two."""
    return (F.when((text == "") | (state == 2), state)
            .when(text.endswith(delim), F.lit(0)).otherwise(F.lit(1)))


def _after_quote(state: Column) -> Column:
    """A quote opens only at the start of a field; two in quotes are one quote's text."""
    return F.when(state == 0, F.lit(2)).when(state == 2, F.lit(3)).when(state == 3, F.lit(2)).otherwise(state)


def _ends_inside(line: Column, delim: Column, inside: bool) -> Column:
    """Whether the line break after ``line`` is inside quotes, if it began so or not."""
    parts = F.split(line, '"', -1)
    start = _after_text(F.lit(2 if inside else 0), F.get(parts, 0), delim)
    end = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start,
                      lambda s, text: _after_text(_after_quote(s), text, delim))
    return F.when(line.contains('"'), end == 2).otherwise(F.lit(inside))


def _effect_before(w, opens: Column, stays: Column) -> tuple[Column, Column]:
    """What all rows before a row (in ``w``) make of the bit that the first began with:
    (fixed, flips). A row maps outside to ``opens`` and inside to ``stays``. From the last
    row that maps both alike on, the bit is known up to the flips since; ``fixed`` is null
    if there is none, and then ``flips`` are to be applied to the first row's bit."""
    known = opens == stays
    flip = (opens & ~stays).cast("int")
    total = F.coalesce(F.sum(flip).over(w), F.lit(0))
    at = F.last(F.when(known, F.struct(opens.alias("bit"), F.col("_flips").alias("flips"))), ignorenulls=True).over(w)
    return (F.when(at.isNotNull(), at["bit"] != ((total - at["flips"]) % 2 == 1)), total % 2 == 1)


def quoted_records(lines: DataFrame, dialect: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, broken)``. ``records`` is ``(_file, _row, line, delimiter)`` with a
    dense record number per file and quoted line breaks inside ``line``; lines of the
    directive are skipped. A file whose last quote never closes cannot be read: it is in
    ``broken`` (``_file``, ``_row`` of the physical line that opened it) and has no records."""
    own = (lines.join(dialect, "_file").where(F.col("_row") >= F.col("skip_rows"))
           .withColumn("_row", F.col("_row") - F.col("skip_rows")))
    opens = _ends_inside(F.col("line"), F.col("delimiter"), False)
    risky = keep(own.where(opens).select("_file").distinct())
    plain = own.join(risky, "_file", "left_anti").select("_file", "_row", "line", "delimiter")

    many = (own.join(risky, "_file").withColumn("_opens", opens)
            .withColumn("_stays", _ends_inside(F.col("line"), F.col("delimiter"), True)))
    # windows over stretches of a fixed number of lines, whatever the size of the file; all of
    # one order, so that lines are shuffled and sorted once
    many = many.withColumn("_blk", F.expr(f"_row div {STRETCH_LINES}"))
    inner = Window.partitionBy("_file", "_blk").orderBy("_row")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    many = many.withColumn("_flips", F.sum((F.col("_opens") & ~F.col("_stays")).cast("int")).over(so_far))
    fixed, odd = _effect_before(before, F.col("_opens"), F.col("_stays"))
    many = many.withColumn("_fixed", fixed).withColumn("_odd", odd)
    begin = lambda bit: F.coalesce(F.col("_fixed"), F.col("_odd") != F.lit(bit))
    starts = lambda bit: F.sum((~begin(bit)).cast("int")).over(so_far)
    many = keep(many.withColumn("_nth0", starts(False)).withColumn("_nth1", starts(True)).drop("_flips"))
    # one row a stretch: its effect is that of its last line after what was before it
    through = lambda bit: F.when(begin(bit), F.col("_stays")).otherwise(F.col("_opens"))
    blocks = many.groupBy("_file", "_blk").agg(
        F.max_by(F.struct(through(False).alias("_o"), through(True).alias("_s"), "_nth0", "_nth1"), "_row").alias("_l")).select("_file", "_blk", "_l.*")
    outer = Window.partitionBy("_file").orderBy("_blk")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_flips", F.sum((F.col("_o") & ~F.col("_s")).cast("int")).over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    fixed, odd = _effect_before(earlier, F.col("_o"), F.col("_s"))
    blocks = blocks.withColumn("_begin", F.coalesce(fixed, odd))
    blocks = blocks.select("_file", "_blk", "_begin", F.when(F.col("_begin"), F.col("_s")).otherwise(F.col("_o")).alias("_end"),
                           F.when(F.col("_begin"), F.col("_nth1")).otherwise(F.col("_nth0")).alias("_starts"))
    blocks = keep(blocks.select("_file", "_blk", "_begin", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_off"),
                                F.max_by("_end", "_blk").over(Window.partitionBy("_file")).alias("_unclosed")))
    told = (many.join(blocks, ["_file", "_blk"]).withColumn("_in", F.coalesce("_fixed", F.col("_odd") != F.col("_begin")))
            .withColumn("_rec", F.col("_off") + F.when(F.col("_begin"), F.col("_nth1")).otherwise(F.col("_nth0")) - 1))
    broken = told.where(F.col("_unclosed") & ~F.col("_in") & F.col("_opens")).groupBy("_file").agg(F.max("_row").alias("_row"))
    told = told.where(~F.col("_unclosed"))
    alone = ~F.col("_in") & ~F.col("_opens")
    single = told.where(alone).select("_file", F.col("_rec").alias("_row"), "line", "delimiter")
    # only lines of records that span several lines meet
    split = (told.where(~alone).groupBy("_file", "_rec", "delimiter")
             .agg(F.sort_array(F.collect_list(F.struct("_row", "line"))).alias("_l"))
             .select("_file", F.col("_rec").alias("_row"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("line"), "delimiter"))
    return plain.unionByName(single).unionByName(split), broken


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def _quoted_cells(text: str | None, delim: str) -> list[str] | None:
    """The cells of a record with quotes: the steps of ``_after_text`` and ``_after_quote``."""
    if text is None:
        return None
    done, cur, state = [], [], 0
    for i, piece in enumerate(text.split('"')):
        if i:
            if state in (1, 3):     # a quote that is text: in a plain field, or the second of two in quotes
                cur.append('"')
            state = (2, 1, 3, 2)[state]
        if piece and state != 2:
            *cut, piece = piece.split(delim)
            for cell in cut:
                done.append("".join(cur) + cell)
                cur = []
            state = 1 if piece else 0
        cur.append(piece)
    return [*done, "".join(cur)]


def split_cells(line: Column, delim: Column) -> Column:
    """The cells of one record as an array: quotes around a field go, two quotes in quotes
    are one, a quote within a plain field is text. A carriage return that ends the record
    is no part of it."""
    text = F.regexp_replace(line, r"\r\z", "")
    quoted = text.contains('"')
    plain = F.split(text, F.concat(F.lit("\\Q"), delim, F.lit("\\E")), -1)
    return F.when(quoted, _quoted_cells(F.when(quoted, text), delim)).otherwise(plain)


def _header_flags(rows: DataFrame) -> DataFrame:
    """Per row of cells: filled and label cells, numbering and section rows."""
    cells = F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit("")))
    filled = F.size(F.filter(cells, lambda c: c.isNotNull()))
    numeric = F.size(F.filter(cells, lambda c: c.try_cast("double").isNotNull()))
    vals = F.filter(F.transform(cells, lambda c: c.try_cast("int")), lambda v: v.isNotNull())
    rising = F.forall(F.zip_with(F.slice(vals, 2, F.greatest(F.size(vals) - 1, F.lit(0))), F.slice(vals, 1, F.greatest(F.size(vals) - 1, F.lit(0))),
                                 lambda b, a: b > a), lambda x: x)
    numbering = (F.size(vals) >= 3) & (F.size(vals) == filled) & (F.get(vals, 0) == 1) & rising
    first_two = F.size(F.filter(F.slice(cells, 1, 2), lambda c: c.isNotNull()))
    return rows.select("_file", "_row", "cells", filled.alias("filled"), (filled - numeric).alias("labels"),
                       F.coalesce(numbering, F.lit(False)).alias("numbering"),
                       ((filled > 0) & (filled <= 2) & (first_two == filled)).alias("section"))


def detect_header_rows(rows: DataFrame) -> DataFrame:
    """S3 per file -> ``(_file, header_rows, header_row_ids)`` over the first 5 rows."""
    f = _header_flags(rows.where(F.col("_row") < HEADER_PREVIEW_ROWS))
    g = f.groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_row", "filled", "labels", "numbering",
                                                                    "section"))).alias("rows"))
    # fold in row order: skip blank / numbering / section rows, count label rows, stop at the first other row
    init = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"),
                    F.array().cast("array<long>").alias("ids"))

    def step(acc, r):
        skip = (r["filled"] == 0) | r["numbering"] | r["section"]
        label_row = (r["labels"] >= 3) & (r["labels"] >= r["filled"] - r["labels"])
        take = ~acc["stop"] & ~skip & label_row & (acc["n"] < 3)
        stop = acc["stop"] | (~skip & ~take)
        return F.struct(F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"), stop.alias("stop"),
                        F.when(take, F.concat(acc["ids"], F.array(r["_row"].cast("long")))).otherwise(acc["ids"]).alias("ids"))
    res = F.aggregate("rows", init, step)
    return g.select("_file", F.greatest(res["n"], F.lit(1)).alias("header_rows"),
                    F.when(res["n"] > 0, res["ids"]).otherwise(F.array(F.lit(0).cast("long"))).alias("header_row_ids"))


@dataclass
class DelimitedScan:
    """Any number of files in one plan. ``records``: (_file, _row, cells) for every content
    record. ``dialect``: (_file, delimiter, skip_rows). ``headers``: (_file, header_rows,
    header_row_ids). ``broken``: files whose last quote never closes (_file, _row)."""

    records: DataFrame
    dialect: DataFrame
    headers: DataFrame
    broken: DataFrame

    def schemas(self) -> DataFrame:
        """A row per file -- delimiter, header_rows, last_header (row), width, n_rows
        (records with a cell that is not blank, after the headers) and unique ``names``
        (H1 over several header rows, H8). Names reach as far as any record does."""
        blank = F.forall("cells", lambda c: F.trim(c) == "")
        h = self.headers.select("_file", "header_rows", "header_row_ids", F.array_max("header_row_ids").alias("last_header"))
        per = (self.records.join(h, "_file").groupBy("_file", "header_rows", "last_header").agg(
            F.count(F.when((F.col("_row") > F.col("last_header")) & ~blank, 1)).alias("n_rows"),
            F.max(F.when(F.array_contains("header_row_ids", F.col("_row")) | ~blank, F.size("cells"))).alias("width"),
            # at most three header rows a file
            F.sort_array(F.collect_list(F.when(F.array_contains("header_row_ids", F.col("_row")), F.struct("_row", "cells")))).alias("grid")))
        level = lambda j: F.transform("grid", lambda g: F.coalesce(
            F.nullif(F.get(g["cells"], j), F.lit("")), F.concat(F.lit("Unnamed: "), j.cast("string"))))
        places = F.sequence(F.lit(0), F.greatest("width", F.lit(1)) - 1)
        one = F.transform(places, lambda j: F.get(level(j), 0))
        several = F.transform(places, lambda j: merge_header_levels(level(j)))
        per = per.withColumn("names", unique_name_array(F.when(F.size("grid") > 1, several).otherwise(one)))
        return per.join(self.dialect.select("_file", "delimiter"), "_file").drop("grid")

    def rows(self, schemas: DataFrame | None = None) -> DataFrame:
        """``(_file, _row, values)`` of all files, ``values`` a map from the file's own
        names to cells; blank records are dropped."""
        schemas = self.schemas() if schemas is None else schemas
        body = (self.records.join(schemas.select("_file", "last_header", "names"), "_file").where(F.col("_row") > F.col("last_header"))
                .where(~F.forall("cells", lambda c: F.trim(c) == "")))
        size = F.least(F.size("cells"), F.size("names"))
        return body.select("_file", "_row", F.map_from_arrays(F.slice("names", 1, size), F.slice("cells", 1, size)).alias("values"))

    def save(self, folder: str) -> None:
        """The rows of all files as Parquet with a partition per file
        (``file_key``, a hash of the path) and ``schemas`` beside them with the same key."""
        key = F.sha2("_file", 256).alias("file_key")
        schemas = keep(self.schemas())
        schemas.select(key, "*").write.parquet(f"{folder.rstrip('/')}/schemas")
        # ranges of rows, so that a file of any size is written by as many tasks as it needs
        (self.rows(schemas).select(key, "*").repartitionByRange("file_key", "_row")
         .write.partitionBy("file_key").parquet(f"{folder.rstrip('/')}/rows"))

    def frame(self, file: str) -> DataFrame:
        """One file as a DataFrame with its own column names; ``_file``/``_row`` kept for order."""
        row = self.schemas().where(F.col("_file") == file).first()
        names = list(row["names"]) if row else []
        body = self.records.where((F.col("_file") == file) & (F.col("_row") > (row["last_header"] if row else 0)))
        body = body.where(~F.forall("cells", lambda c: F.trim(c) == ""))
        return body.select("_file", "_row", *[F.get("cells", i).alias(n) for i, n in enumerate(names)])


def scan_delimited(spark: SparkSession, paths: list[str] | str, delimiter: str | None = None) -> DelimitedScan:
    """S1 + S10: one scan over any number of files. ``delimiter`` overrides detection."""
    # text is read, parsed and cut into cells once, whatever is asked of the scan later
    lines = keep(read_lines(spark, paths))
    dialect = keep(detect_dialect(lines))    # one row a file, used by all that follows
    if delimiter is not None:
        dialect = dialect.withColumn("delimiter", F.lit(delimiter))
    records, broken = quoted_records(lines, dialect)
    records = keep(records.select("_file", "_row", split_cells(F.col("line"), F.col("delimiter")).alias("cells")))
    return DelimitedScan(records, dialect, keep(detect_header_rows(records)), broken)
