"""Workbooks (SpreadsheetML) as tables of rows, and tables as workbooks.

The data source ``quire_xlsx`` (option ``path``, a folder or a file) gives a row for each row of each sheet, its cells as texts, in a pull
over the zipped XML; a task holds a workbook's shared strings and one row. Writing streams a task's rows into workbooks, a new one for
each value of the column ``book`` and a new sheet for each one of ``sheet``, so rows come sorted by these. The folder appears when
all is written. The first row of a sheet has the names of the columns, bold and frozen.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter
from pyspark.sql.types import StructType

from quire.functions.text import strip
from quire.sources.packed import Done, Files, FolderWriter, groups, opened

NAME = "quire_xlsx"
ROWS = "path string, sheet_no int, sheet string, row int, cells array<string>"

#: The format's namespaces, parts and limits.
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, NAME_LENGTH, CELL_LENGTH = 1_048_576, 31, 32_767
STYLES = (
    f'<styleSheet xmlns="{S[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)
UNFIT = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]")
#: A character that XML can't hold, or what looks like its escape.
CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
#: Different strings that a workbook shares; further ones stand in their cells.
SHARED = 200_000


def column_name(k: int) -> str:
    """A, B, ..., Z, AA for 0, 1, ..., 25, 26."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def decoded(text: str) -> str:
    return CODED.sub(lambda m: chr(int(m[1], 16)), text)


def encoded(text: str) -> str:
    text = CODED.sub(lambda m: f"_x005F_x{m[1]}_", text)
    return escape(UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text), {"\r": "&#13;"})


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic parts."""
    return "".join(decoded(t.text or "") for part in ([element, *element.findall(f"{S}r")]) for t in part.findall(f"{S}t"))


def sheets(package: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of a workbook's sheets, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(package.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = ElementTree.parse(package.open("xl/workbook.xml")).iter(f"{S}sheet")
    return [(x.get("name"), t[1:] if (t := targets[x.get(f"{R}id")]).startswith("/") else f"xl/{t}") for x in found]


def rows(f: BinaryIO) -> Iterator[tuple]:
    """``sheet_no, sheet, row, cells`` of each row that is there; cells that are not are null."""
    with zipfile.ZipFile(f) as package:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in package.namelist():
            for _, x in ElementTree.iterparse(package.open("xl/sharedStrings.xml"), ["end"]):
                if x.tag == f"{S}si":
                    shared.append(_text(x))
                    x.clear()
        for number, (sheet, part) in enumerate(sheets(package)):
            with package.open(part) as xml:
                at = 0
                for _, x in ElementTree.iterparse(xml, ["end"]):
                    if x.tag != f"{S}row":
                        continue
                    at = int(x.get("r") or at + 1)
                    cells: list[str | None] = []
                    for c in x.findall(f"{S}c"):
                        k = column_number(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (k + 1 - len(cells))
                        value, kind = c.find(f"{S}v"), c.get("t")
                        if kind == "inlineStr":
                            cells[k] = _text(c.find(f"{S}is"))
                        elif value is not None:
                            text = value.text or ""
                            cells[k] = shared[int(text)] if kind == "s" else decoded(text) if kind == "str" else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
                    yield number, sheet, at, cells
                    x.clear()


class Book:
    """A workbook that is written sheet by sheet; its strings are shared up to a number."""

    def __init__(self, f: BinaryIO, names: list[str]):
        self.package, self.names = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED), names
        self.sheets: list[str] = []
        self.shared: dict[str, int] = {}

    def cell(self, at: int, row: int, value, head: bool = False) -> str:
        if value is None:
            return ""
        ref = f'<c r="{column_name(at)}{row}"' + (' s="1"' if head else "")
        if isinstance(value, bool):
            return f'{ref} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
            return f"{ref}><v>{value!r}</v></c>"
        if isinstance(value, datetime.datetime | datetime.date):
            value = value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat()
        text = str(value)
        if len(text) > CELL_LENGTH:
            raise ValueError(f"a cell of {len(text)} characters; the format holds {CELL_LENGTH}")
        k = self.shared.get(text)
        if k is None:
            if len(self.shared) >= SHARED:
                return f'{ref} t="inlineStr"><is><t xml:space="preserve">{encoded(text)}</t></is></c>'
            k = self.shared[text] = len(self.shared)
        return f'{ref} t="s"><v>{k}</v></c>'

    def sheet(self, name: str, values: Iterator[tuple]) -> None:
        """A sheet; rows beyond the format's limit go to further ones."""
        values = iter(values)
        first = next(values, None)
        n = 0
        while first is not None or not n:
            called = f" {n + 1}" if n else ""
            title = re.sub(r"[\[\]:*?/\\]", "_", UNFIT.sub("", name or "")).strip("'")[: NAME_LENGTH - len(called)] + called
            while not title or title.lower() in (s.lower() for s in self.sheets):
                title = f"{title[: NAME_LENGTH - 5]}~{len(self.sheets)}"
            self.sheets.append(title)
            with self.package.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet xmlns="{S[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                out.write(f'<row r="1">{"".join(self.cell(k, 1, c, head=True) for k, c in enumerate(self.names))}</row>'.encode())
                row = 1
                while first is not None and row < MOST_ROWS:
                    row += 1
                    out.write(f'<row r="{row}">{"".join(self.cell(k, row, v) for k, v in enumerate(first))}</row>'.encode())
                    first = next(values, None)
                out.write(b"</sheetData></worksheet>")
            n += 1

    def close(self) -> None:
        put = lambda name, text: self.package.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        numbers = range(1, len(self.sheets) + 1)
        kinds = {"workbook": "sheet.main", "styles": "styles", "sharedStrings": "sharedStrings", **{f"worksheets/sheet{k}": "worksheet" for k in numbers}}
        over = "".join(f'<Override PartName="/xl/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>' for part, kind in kinds.items())
        put("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}</Types>')
        link = lambda k, kind, target: f'<Relationship Id="{k}" Type="{R[1:-1]}/{kind}" Target="{target}"/>'
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{link("r1", "officeDocument", "xl/workbook.xml")}</Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(link(f"r{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in numbers)}{link("s", "styles", "styles.xml")}{link("t", "sharedStrings", "sharedStrings.xml")}</Relationships>')
        named = "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="r{k}"/>' for k, s in zip(numbers, self.sheets, strict=True))
        put("xl/workbook.xml", f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets>{named}</sheets></workbook>')
        put("xl/styles.xml", STYLES)
        with self.package.open("xl/sharedStrings.xml", "w", force_zip64=True) as out:
            out.write(f'<sst xmlns="{S[1:-1]}">'.encode())
            for text in self.shared:
                out.write(f'<si><t xml:space="preserve">{encoded(text)}</t></si>'.encode())
            out.write(b"</sst>")
        self.package.close()


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return groups(self.path, "xlsx")

    def read(self, partition: Files) -> Iterator[tuple]:
        for name, f in opened(partition.paths, self.path):
            for r in rows(f):
                yield name, *r


class Writer(FolderWriter, DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        super().__init__(path)
        self.names = names

    def write(self, iterator) -> Done:
        n = 0
        for name, of_book in groupby(iterator, lambda r: r.book):

            def fill(f, of_book=of_book):
                book = Book(f, self.names)
                for sheet, of_sheet in groupby(of_book, lambda r: r.sheet):
                    book.sheet(sheet, (r[2:] for r in of_sheet))
                book.close()

            self.put(f"{name}.xlsx", fill)
            n += 1
        return Done(n)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.names[2:])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all sheets of all workbooks below ``path``, heads included."""
    spark.dataSource.register(Workbooks)
    return spark.read.format(NAME).option("path", path).load()


def heads(sheet_rows: DataFrame) -> DataFrame:
    """``path, sheet_no, head``: the names in the first row of each sheet."""
    return sheet_rows.where("row = 1").select("path", "sheet_no", F.col("cells").alias("head"))


def typed(sheet_rows: DataFrame, schema: str) -> DataFrame:
    """The rows below the heads as a table: ``path, sheet_no, sheet, row`` and the columns that ``schema`` names, found by the heads."""
    fields = StructType.fromDDL(schema).fields
    with_head = sheet_rows.where("row > 1").join(heads(sheet_rows), ["path", "sheet_no"])
    at = lambda name: F.array_position("head", name).cast("int")
    return with_head.select("path", "sheet_no", "sheet", "row", *(F.when(at(f.name) > 0, F.get("cells", at(f.name) - 1)).cast(f.dataType).alias(f.name) for f in fields))


def glossary(sheet_rows: DataFrame, source_names: list[str], target_names: list[str]) -> DataFrame:
    """``source_term, target_term`` of all sheets whose heads name a source and a target in one of the given ways, the first that is there.

    Pairs without source or target go; of equal terms the last one by file, sheet and row is taken.
    """

    def first(names: list[str]):
        return F.get(F.filter(F.array(*(F.array_position("head", n) for n in names)), lambda x: x > 0), F.lit(0)).cast("int")

    known = heads(sheet_rows).select("path", "sheet_no", first(source_names).alias("_s"), first(target_names).alias("_t")).where("_s is not null and _t is not null")
    pairs = sheet_rows.where("row > 1").join(known, ["path", "sheet_no"]).select("path", "sheet_no", "row", strip(F.get("cells", F.col("_s") - 1)).alias("source_term"), strip(F.get("cells", F.col("_t") - 1)).alias("target_term"))
    return pairs.where("source_term != '' and target_term != ''").groupBy("source_term").agg(F.max_by("target_term", F.struct("path", "sheet_no", "row")).alias("target_term"))


def write(df: DataFrame, path: str, book, sheet, order: list[str]) -> None:
    """``df`` as workbooks in a new folder: ``book`` (a column) names a row's file and ``sheet`` its sheet; rows of a sheet go by ``order``.

    A workbook is written by one task, as it is one file; it streams through, so its size is no matter for memory.
    """
    df.sparkSession.dataSource.register(Workbooks)
    names = [c for c in df.columns if c not in ("book", "sheet")]  # these two are no cells
    named = df.select(book.cast("string").alias("book"), sheet.cast("string").alias("sheet"), *names)
    named.repartition("book").sortWithinPartitions("book", "sheet", *order).write.format(NAME).option("path", path).mode("append").save()
