"""Text documents (WordprocessingML) as tables of paragraphs, and their articles by three strategies.

The data source ``quire_docx`` (option ``path``, a folder or a file) gives a row for each paragraph, in a pull over the zipped XML, so that a
task holds one paragraph at a time; a task reads a group of files. Writing takes a row for each document.

Articles are made of paragraphs by windows within a file. The whole file's headings open articles; if these are too few for the
contents list, the paragraphs that the list names do; and without a list, paragraphs that look like titles.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from quire.functions.checks import extraction_strategy
from quire.functions.text import strip, title_key
from quire.sources.packed import Done, Files, FolderWriter, groups, opened

NAME = "quire_docx"
PARAGRAPHS = "path string, paragraph int, style string, level int, bold boolean, new_page boolean, text string"
DOCUMENTS = "name string, paragraphs array<struct<style:string,bold:boolean,new_page:boolean,text:string>>"

#: The format's namespace and the parts of a package.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
OF_DOCUMENT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
HEADING = re.compile(r"heading ([1-9])", re.IGNORECASE)
#: What XML can't hold.
UNFIT = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]")


def styles(package: zipfile.ZipFile) -> dict[str, tuple[str, int | None]]:
    """Name and heading level (from 1) of each style."""
    out = {}
    if "word/styles.xml" in package.namelist():
        for s in ElementTree.parse(package.open("word/styles.xml")).iter(f"{W}style"):
            name = s.find(f"{W}name")
            called = name.get(f"{W}val") if name is not None else s.get(f"{W}styleId")
            outline, heading = s.find(f"{W}pPr/{W}outlineLvl"), HEADING.fullmatch(called or "")
            level = int(outline.get(f"{W}val")) + 1 if outline is not None else int(heading[1]) if heading else 1 if (called or "").lower() == "title" else None
            out[s.get(f"{W}styleId")] = (called, level)
    return out


def on(element: ElementTree.Element | None) -> bool:
    """Is a switch there and not off?"""
    return element is not None and element.get(f"{W}val") not in ("0", "false", "off")


def paragraphs(f: BinaryIO) -> Iterator[tuple]:
    """``paragraph, style, level, bold, new_page, text`` of each paragraph of a document, those in tables included."""
    with zipfile.ZipFile(f) as package:
        known = styles(package)
        n, breaks = 0, False
        with package.open("word/document.xml") as xml:
            for _, p in ElementTree.iterparse(xml, ["end"]):
                if p.tag != f"{W}p":
                    continue
                style = p.find(f"{W}pPr/{W}pStyle")
                name, level = known.get(style.get(f"{W}val"), (style.get(f"{W}val"), None)) if style is not None else (None, None)
                new_page, text, bold = breaks or on(p.find(f"{W}pPr/{W}pageBreakBefore")), [], []
                breaks = False
                for run in p.iter(f"{W}r"):
                    was = len(text)
                    for x in run:
                        if x.tag == f"{W}t":
                            text.append(x.text or "")
                        elif x.tag == f"{W}tab":
                            text.append("\t")
                        elif x.tag in (f"{W}br", f"{W}cr"):
                            if x.get(f"{W}type") != "page":
                                text.append("\n")
                            elif any(text):
                                breaks = True  # the next paragraph's
                            else:
                                new_page = True
                    if any(text[was:]):
                        bold.append(on(run.find(f"{W}rPr/{W}b")))
                yield n, name, level, bool(bold) and all(bold), new_page, "".join(text)
                n += 1
                p.clear()


def document_xml(f: BinaryIO, rows: list) -> None:
    """A document of paragraphs (style, bold, new_page, text); characters that XML can't hold go."""
    used = sorted({r.style for r in rows if r.style})
    number = {name: f"S{k}" for k, name in enumerate(used)}
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", TYPES)
        package.writestr("_rels/.rels", RELATIONS)
        package.writestr("word/_rels/document.xml.rels", OF_DOCUMENT)
        named = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val={quoteattr(UNFIT.sub("", s))}/></w:style>' for s, k in number.items())
        package.writestr("word/styles.xml", f'<w:styles xmlns:w="{W[1:-1]}">{named}</w:styles>')
        with package.open("word/document.xml", "w") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>'.encode())
            for r in rows:
                properties = (f'<w:pStyle w:val="{number[r.style]}"/>' if r.style else "") + ("<w:pageBreakBefore/>" if r.new_page else "")
                parts = re.split("([\t\n])", escape(UNFIT.sub("", r.text or ""), {"\r": "&#13;"}))
                body = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{x}</w:t>' for x in parts if x)
                out.write(f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:rPr>{'<w:b/>' if r.bold else ''}</w:rPr>{body}</w:r></w:p>".encode())
            out.write(b"</w:body></w:document>")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return groups(self.path, "docx")

    def read(self, partition: Files) -> Iterator[tuple]:
        for name, f in opened(partition.paths, self.path):
            for p in paragraphs(f):
                yield name, *p


class Writer(FolderWriter, DataSourceWriter):
    def write(self, iterator) -> Done:
        n = 0
        for row in iterator:
            self.put(f"{row.name}.docx", lambda f, rows=row.paragraphs: document_xml(f, rows or []))
            n += 1
        return Done(n)


class TextDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PARAGRAPHS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The paragraphs of all documents below ``path``."""
    spark.dataSource.register(TextDocuments)
    return spark.read.format(NAME).option("path", path).load()


def write(documents: DataFrame, path: str) -> None:
    """A file ``name``.docx for each row (name, paragraphs) in a new folder, which appears when all are written."""
    documents.sparkSession.dataSource.register(TextDocuments)
    documents.select("name", "paragraphs").write.format(NAME).option("path", path).mode("append").save()


def _articles(rows: DataFrame, file: str, opens: Column) -> DataFrame:
    """Articles of the paragraphs, each of which begins where ``opens``; what stands before the first one belongs to none."""
    w = Window.partitionBy(file).orderBy("paragraph")
    numbered = rows.withColumn("_n", F.sum(opens.cast("int")).over(w)).where("_n > 0")
    lines = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    text = F.transform("_p", lambda p: p["text"])
    parts = numbered.groupBy(file, F.col("_n").cast("int").alias("number")).agg(lines.alias("_p"))
    return parts.select(file, "number", F.get(text, F.lit(0)).alias("title"), F.array_join(F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0))), "\n").alias("content"))


def articles(rows: DataFrame, contents: DataFrame, file: str = "path", title: str = "title") -> DataFrame:
    """``file, number, title, content, strategy`` of the articles of all documents.

    ``rows`` are paragraphs, ``contents`` has the titles (file, title) that contents lists name. Whole: headings of the first
    level open articles. By contents: so do titles of the list, where a paragraph begins a page, is bold or has a heading's style.
    By segments: so do bold paragraphs, and those that begin a page, if they have 120 characters at most.
    """
    level, shown = F.col("level") == 1, F.coalesce(F.col("level").isNotNull(), F.lit(False)) | F.col("bold") | F.col("new_page")
    whole = _articles(rows, file, F.coalesce(level, F.lit(False)))
    last = whole.groupBy(file).agg(F.count("*").alias("found"), F.max_by(F.length("content"), "number").alias("last_length"))
    listed = contents.groupBy(file).agg(F.count("*").alias("expected"))
    files = rows.select(file).distinct().join(listed, file, "left").join(last, file, "left")
    how = files.select(file, extraction_strategy(F.col("expected"), F.coalesce("found", F.lit(0)), F.col("last_length")).alias("strategy"))
    of = lambda name: rows.join(how.where(F.col("strategy") == name).select(file), file, "left_semi")
    keyed = of("by_contents").withColumn("_k", title_key(strip(F.col("text")))).withColumn("_shown", shown)
    names = contents.select(file, title_key(strip(F.col(title))).alias("_k"), F.lit(True).alias("_listed")).distinct()
    by_contents = _articles(keyed.join(names, [file, "_k"], "left"), file, F.coalesce(F.col("_shown") & F.col("_listed"), F.lit(False)))
    by_segments = _articles(of("by_segments"), file, (F.col("bold") | F.col("new_page")) & (F.length("text").between(1, 120)))
    kept = whole.join(how.where("strategy = 'whole'").select(file), file, "left_semi")
    out = [df.withColumn("strategy", F.lit(name)) for name, df in (("whole", kept), ("by_contents", by_contents), ("by_segments", by_segments))]
    return out[0].unionByName(out[1]).unionByName(out[2])
