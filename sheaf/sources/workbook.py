"""Workbook scan (S4): ``.xlsx`` files -> long cells + merged ranges, as a Python data source.

``spark.read.format("sheaf_workbook").load(folder)`` has one partition per book and sheet, and
packs sheets where there are many, so that tasks follow the bytes and not the books. Planning reads the list of sheets of each book and nothing else; filters on ``_file`` and
``sheet`` are pushed into it, so other books are not opened and other sheets not parsed.
A task streams its sheet's XML and hands rows on in chunks, so neither a grid nor a whole
book is held; shared strings are read when the first cell refers to one. (No spreadsheet
library is needed: the standard library opens the zip.)"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sheaf.session import keep

# ---- fixed values ------------------------------------------------------------
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Number formats that the file format defines as dates or times.
DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO, DAY_ZERO_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
# ------------------------------------------------------------------------------
LISTING_THREADS = 16    # books whose lists of sheets are read at a time while planning
CHUNK = 10_000          # rows handed on at a time
PARTS = 256             # sheets that have a task each; more are packed, about so many tasks ...
PART_BYTES = 32 << 20   # ... or more, of this size of XML; a larger sheet is alone
#: A cell has kind s (text), n (number), b (boolean) or d (date); a merged range has kind
#: merge, with its last row and column.
RECORD = "_file string, sheet string, row int, col int, max_row int, max_col int, value string, kind string"


def _tag(name: str) -> str:
    return f"{{{NS['m']}}}{name}"


CELL, VALUE, TEXT, ROW, MERGED = map(_tag, ("c", "v", "t", "row", "mergeCell"))     # tags, made once
_REF = re.compile(r"\$?([A-Z]+)\$?(\d+)")


def _place(ref: str) -> tuple[int, int]:
    letters, digits = _REF.match(ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def _number_text(t: str) -> str:
    try:
        x = float(t)
    except ValueError:
        return t
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _is_date_format(code: str) -> bool:
    """A custom format shows a date if letters of dates or times stay once texts,
    escapes, colours and conditions are taken out."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General', "", code), re.I))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles (by number) that show their number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(_tag("numFmt"))}
    dates = DATE_FORMAT_IDS | {i for i, code in custom.items() if _is_date_format(code)}
    xfs = root.find("m:cellXfs", NS)
    return {i for i, xf in enumerate(xfs if xfs is not None else []) if int(xf.get("numFmtId") or 0) in dates}


def _date_text(serial: str, zero: dt.datetime) -> str | None:
    try:
        when = zero + dt.timedelta(seconds=round(float(serial) * 86400))
    except (ValueError, OverflowError):
        return None
    return when.strftime("%Y-%m-%d") if when.time() == dt.time(0) else when.strftime("%Y-%m-%d %H:%M:%S")


def _open(path: str):
    """A book in any store that pyarrow knows, for random access."""
    from pyarrow.fs import FileSystem

    store, place = FileSystem.from_uri(path)
    return store.open_input_file(place)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, member of the zip) in the order of the book."""
    names, targets = set(z.namelist()), {}
    if "xl/_rels/workbook.xml.rels" in names:
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in rels.findall(f"{{{REL_NS}}}Relationship")}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS):
        target = targets.get(sheet.get(f"{{{NS['r']}}}id"), "")
        target = target if target.startswith("xl/") else f"xl/{target}"
        if target in names:
            out.append((sheet.get("name"), target))
    return out


class _Shared:
    """Shared strings of a book, read when the first is asked for."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.texts = z, None

    def __getitem__(self, i: int) -> str:
        if self.texts is None:
            self.texts = []
            for _, el in ET.iterparse(self.z.open("xl/sharedStrings.xml")):
                if el.tag == _tag("si"):
                    self.texts.append("".join(t.text or "" for t in el.iter(TEXT)))
                    el.clear()
        return self.texts[i]


def read_sheet(z: zipfile.ZipFile, member: str) -> Iterator[tuple]:
    """The records of one sheet: (row, col, max_row, max_col, value, kind)."""
    props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", NS)
    zero = DAY_ZERO_1904 if props is not None and props.get("date1904") in ("1", "true") else DAY_ZERO
    dates, shared = _date_styles(z), _Shared(z)
    for _, el in ET.iterparse(z.open(member)):
        if el.tag == CELL:
            cell = _cell(el, shared, dates, zero)
            if cell is not None:
                yield (*_place(el.get("r")), None, None, *cell)
        elif el.tag == MERGED and ":" in (el.get("ref") or ""):
            first, last = el.get("ref").split(":")
            yield (*_place(first), *_place(last), None, "merge")
        elif el.tag == ROW:
            el.clear()


def _cell(el, shared: _Shared, dates: set[int], zero: dt.datetime) -> tuple[str | None, str] | None:
    v, kind = el.find(VALUE), el.get("t")
    text = v.text if v is not None else None
    if kind == "inlineStr":
        return "".join(t.text or "" for t in el.iter(TEXT)), "s"
    if kind == "str":
        return text, "s"
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)], "s"
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE", "b"
    if kind == "d":
        return text, "d"
    if kind == "e":
        return text, "s"
    date = _date_text(text, zero) if int(el.get("s") or 0) in dates else None
    return (date, "d") if date else (_number_text(text), "n")


@dataclass
class SheetsPartition(InputPartition):
    """Sheets that one task reads: (file, sheet, member of the zip)."""
    sheets: list[tuple[str, str, str]]


def pack_sheets(sheets: list[tuple[str, str, str, int]]) -> list[SheetsPartition]:
    """Sheets with the size of their XML, in order, in partitions of bounded size."""
    most = min(PART_BYTES, sum(s[3] for s in sheets) // PARTS) if len(sheets) > PARTS else 0
    parts, room = [], 0
    for *sheet, size in sheets:
        if not parts or size > room:
            parts.append(SheetsPartition([]))
            room = most
        parts[-1].sheets.append(tuple(sheet))
        room -= size
    return parts


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}    # column -> values that the filters leave

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("_file", "sheet"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = values & self.wanted.get(column, values)
            else:
                yield f

    def _books(self) -> list[str]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", self.path)
        folder, _, pattern = self.path.rpartition("/") if "*" in self.path else (self.path, "", "*.xlsx")
        store, root = FileSystem.from_uri(folder)
        if store.get_file_info(root).type == FileType.File:
            return [self.path]
        found = [f.path for f in store.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File]
        prefix = scheme.group(0) if scheme else ""
        return sorted(prefix + p for p in found if fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern) and p.lower().endswith(".xlsx"))

    def partitions(self) -> list[SheetsPartition]:
        left = lambda column, value: column not in self.wanted or value in self.wanted[column]

        def listed(book: str) -> list[tuple[str, str, str, int]]:
            with _open(book) as f, zipfile.ZipFile(f) as z:
                return [(book, sheet, member, z.getinfo(member).file_size) for sheet, member in _sheets(z) if left("sheet", sheet)]

        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            return pack_sheets([s for found in pool.map(listed, [b for b in self._books() if left("_file", b)]) for s in found])

    def read(self, partition: SheetsPartition | None) -> Iterator[pa.RecordBatch]:
        for file, sheet, member in partition.sheets if partition is not None else []:   # None: no partition is left
            yield from self._read_sheet(file, sheet, member)

    def _read_sheet(self, file: str, sheet: str, member: str) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 4 + [pa.string()] * 2
        with _open(file) as f, zipfile.ZipFile(f) as z:
            chunk: list[tuple] = []

            def told() -> pa.RecordBatch:
                names = [pa.array([x] * len(chunk), pa.string()) for x in (file, sheet)]
                cells = [pa.array(c, k) for c, k in zip(zip(*chunk), kinds)]
                return pa.RecordBatch.from_arrays([*names, *cells], [f.split()[0] for f in RECORD.split(", ")])

            for record in read_sheet(z, member):
                chunk.append(record)
                if len(chunk) >= CHUNK:
                    yield told()
                    chunk = []
            if chunk:
                yield told()


class WorkbookSource(DataSource):
    """Cells and merged ranges of the ``.xlsx`` files at ``path`` (a file, a folder or a
    pattern for file names) in any store that pyarrow and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "sheaf_workbook"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The data source's rows (``RECORD``); filters on ``_file`` and ``sheet`` prune."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("sheaf_workbook").load(path)


def cells_and_merges(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = records.where("kind <> 'merge'").select("_file", "sheet", "row", "col", "value", "kind")
    merges = records.where("kind = 'merge'").select(
        "_file", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), "max_row", "max_col")
    return cells, merges


def scan_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(cells, merges)`` of all books; each is read once, into the checkpoint folder."""
    return cells_and_merges(keep(read_workbooks(spark, path)))


def write_xlsx(path, sheets: dict[str, list[list]], merges: dict[str, list[str]] | None = None, shared: bool = False):
    """Minimal workbook writer (strings, numbers, dates) for fixtures and exports, to a path
    or an open binary file; ``shared`` keeps strings in the book's table of strings."""
    strings: dict[str, int] = {}

    def col_letters(i):
        s = ""
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    def esc(x):
        return str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    z = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
    names = list(sheets)
    z.writestr("[Content_Types].xml",
               '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
               '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
               '<Default Extension="xml" ContentType="application/xml"/>'
               '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
               + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                         for i in range(len(names))) + "</Types>")
    z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{NS["m"]}">'
               '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
    z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{REL_NS}">'
               '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets>'
               + "".join(f'<sheet name="{esc(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
               + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{REL_NS}">'
               + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                         for i in range(len(names))) + "</Relationships>")
    for i, n in enumerate(names):
        rows = []
        for r, vals in enumerate(sheets[n], 1):
            cs = []
            for c, v in enumerate(vals, 1):
                if v is None or v == "":
                    continue
                ref = f"{col_letters(c)}{r}"
                if isinstance(v, dt.date):
                    v = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
                    serial = (v - DAY_ZERO) / dt.timedelta(days=1)
                    cs.append(f'<c r="{ref}" s="1"><v>{serial!r}</v></c>')
                elif isinstance(v, (int, float)) and not isinstance(v, bool):
                    cs.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif shared:
                    cs.append(f'<c r="{ref}" t="s"><v>{strings.setdefault(esc(v), len(strings))}</v></c>')
                else:
                    cs.append(f'<c r="{ref}" t="inlineStr"><is><t>{esc(v)}</t></is></c>')
            rows.append(f'<row r="{r}">{"".join(cs)}</row>')
        mc = ""
        if merges and merges.get(n):
            mc = f'<mergeCells count="{len(merges[n])}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merges[n]) + "</mergeCells>"
        z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS["m"]}"><sheetData>{"".join(rows)}</sheetData>{mc}</worksheet>')
    if strings:
        z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{NS["m"]}">'
                   + "".join(f"<si><t>{t}</t></si>" for t in strings) + "</sst>")
    z.close()
