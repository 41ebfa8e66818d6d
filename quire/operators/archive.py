"""Results that come as archives and in parts."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_parts(items: DataFrame, file: str, part: str, order: str) -> DataFrame:
    """Items of a file's parts as one list: pages shifted by those of the parts before, images numbered through (``image_no``)."""
    pages = items.groupBy(file, part).agg((F.max("page_idx") + 1).alias("_n"))
    before = Window.partitionBy(file).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pages.select(file, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    n = F.sum(F.when(F.col("is_image"), 1).otherwise(0)).over(Window.partitionBy(file).orderBy(part, order)) - 1
    return items.join(offsets, [file, part]).withColumn("page_idx", F.col("page_idx") + F.col("_off")).withColumn("image_no", F.when(F.col("is_image"), n)).drop("_off")


KINDS = {"markdown": ("md",), "json": ("json",), "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp"), "html": ("html", "htm"), "docx": ("docx",), "latex": ("tex",)}


def kind_of(path: Column) -> Column:
    """The class of a file by its extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ext.isin(*exts), k) for k, exts in KINDS.items()), F.lit("other"))


def inventory(paths: DataFrame, path: str = "path", examples: int = 20) -> DataFrame:
    """``kind, n, paths`` of files by extension class; ``paths`` has the first ``examples`` in order. All are listed by kind_of()."""
    rows = paths.select(kind_of(F.col(path)).alias("kind"), F.col(path).alias("path"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    # The first ones of a kind are among the first of its salted parts, so no task sorts a whole kind.
    part = Window.partitionBy("kind", "_salt").orderBy("path")
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= examples)
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy("path"))).where(F.col("_r") <= examples)
    return counts.join(first.groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths")), "kind")


def report(name: Column, pages: Column, markdown: Column, content: Column, n_images: Column) -> Column:
    """What an archive holds, as markdown text."""
    flags = content_flags(F.coalesce(content, F.lit("")))
    said = lambda c: F.when(c, "yes").otherwise("no")
    lines = F.when(markdown.isNotNull(), F.concat(F.size(F.split(markdown, "\n")), F.lit(" lines, "), F.length(markdown), F.lit(" characters"))).otherwise("none")
    parts = {"pages": pages, "markdown": lines, "json": F.when(content.isNotNull(), "yes").otherwise("none"), "images": n_images, "tables": said(flags["has_tables"]), "formulas": said(flags["has_formulas"])}
    return F.concat_ws("\n", F.concat(F.lit("# "), name), *(F.concat(F.lit(f"- {k}: "), v) for k, v in parts.items()))


SCHEMA = "path string, status string, n_entries int, markdown string, content string, images array<string>"


def read_archives(files: DataFrame) -> DataFrame:
    """Archives from a binaryFile scan: ``status`` valid, empty, invalid_zip, incomplete or invalid_json, and what they hold."""

    def one(path: str, data: bytes) -> dict:
        out = {"path": path, "status": "valid", "n_entries": 0, "markdown": None, "content": None, "images": []}
        if not data:
            return out | {"status": "empty"}
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [n for n in z.namelist() if not n.endswith("/")]
                texts = {k: next((n for n in sorted(names) if n.lower().endswith(f".{k}")), None) for k in ("md", "json")}
                listed = next((n for n in sorted(names) if n.endswith("content_list.json")), texts["json"])
                out |= {"n_entries": len(names), "images": sorted(n for n in names if n.lower().rpartition(".")[2] in KINDS["image"])}
                if not names or not any(texts.values()):
                    return out | {"status": "incomplete"}
                out["markdown"] = z.read(texts["md"]).decode("utf-8", "replace") if texts["md"] else None
                out["content"] = z.read(listed).decode("utf-8", "replace") if listed else None
        except (zipfile.BadZipFile, RuntimeError, OSError):
            return out | {"status": "invalid_zip"}
        try:
            json.loads(out["content"] or "[]")
        except ValueError:
            out["status"] = "invalid_json"
        return out

    def run(batches):
        types = pa.schema([("path", pa.string()), ("status", pa.string()), ("n_entries", pa.int32()), ("markdown", pa.string()), ("content", pa.string()), ("images", pa.list_(pa.string()))])
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([one(b.column(0)[k].as_py(), b.column(1)[k].as_py())], types)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def status_report(archives: DataFrame) -> DataFrame:
    return archives.groupBy("status").agg(F.count("*").alias("n"))


def content_flags(content: Column) -> dict[str, Column]:
    """Page count and whether there are tables and formulas, from a content list's text."""
    pages = F.transform(F.regexp_extract_all(content, F.lit(r'"page_idx"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.cast("int"))
    low = F.lower(content)
    return {"n_pages": F.coalesce(F.array_max(pages) + 1, F.lit(0)), "has_tables": F.contains(low, F.lit("table")), "has_formulas": F.contains(low, F.lit("equation")) | F.contains(low, F.lit("formula"))}


def merge_markdown(parts: DataFrame, file: str, part: str, markdown: str) -> DataFrame:
    """``file, n_parts, markdown``: the parts' texts in order, with a rule between them; blank ones are left out."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.trim(F.coalesce(F.col(markdown), F.lit(""))).alias("m"))))
    texts = F.filter(F.transform(rows, lambda x: x["m"]), lambda m: m != "")
    return parts.groupBy(file).agg(F.count("*").alias("n_parts"), F.array_join(texts, "\n\n---\n\n").alias("markdown"))


def rekey_pages(pages: DataFrame, file: str, part: str, page: str) -> DataFrame:
    """Layout pages (file, part, page from 0) with ``page`` counted through a file's parts: each part begins after those before."""
    sizes = pages.groupBy(file, part).agg((F.max(page) + 1).alias("_n"))
    before = Window.partitionBy(file).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(file, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return pages.join(offsets, [file, part]).withColumn(page, F.col(page) + F.col("_off")).drop("_off")
