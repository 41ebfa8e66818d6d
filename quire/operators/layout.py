"""Page layout: blocks in their page's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip

#: Characters that end a sentence, and others after which a block may go on.
SENTENCE_END = r"[.!?。！？]$"
PAUSE = r"[.!?。！？,;:]$"


def neighbours(df: DataFrame, page: list[str], order: str, text: str, n: int = 500) -> DataFrame:
    """``before`` and ``after``: the end of the block before and the beginning of the next one, ``n`` characters each."""
    w = Window.partitionBy(page).orderBy(order)
    return df.withColumn("before", F.right(F.lag(text).over(w), F.lit(n))).withColumn("after", F.left(F.lead(text).over(w), F.lit(n)))


def runs(df: DataFrame, page: list[str], order: str, holds: Column) -> DataFrame:
    """``run``: a number that rises wherever ``holds`` is false, and ``place``: a row's number in its run, from 0."""
    w = Window.partitionBy(page).orderBy(order)
    numbered = df.withColumn("run", F.sum(F.when(holds, 0).otherwise(1)).over(w))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(*page, "run").orderBy(order)) - 1)


def goes_on(text: Column, after: Column, gap: Column | None = None, max_gap: float = 80) -> Column:
    """Does a block's text go on in the next one: a hyphen; a column's end; or no end mark and a lower-case start?"""
    t, a = strip(text), strip(after)
    hyphen = F.endswith(t, F.lit("-"))
    column = F.lit(False) if gap is None else F.coalesce(gap, F.lit(0)) > max_gap
    same = ~t.rlike(PAUSE) & (t != "") & a.rlike(r"^\p{Ll}")
    return F.coalesce(hyphen | F.when(column, (t != "") & ~t.rlike(SENTENCE_END)).otherwise(same), F.lit(False)) & (F.coalesce(a, F.lit("")) != "")


def merge_adjacent(df: DataFrame, page: list[str], order: str, text: str, gap: str | None = None) -> DataFrame:
    """Pairs of blocks that go on as one row, ``merged`` set; pairs do not chain.

    A block that goes on is the first of a pair unless it is already the second of one: in a run of such blocks every
    other one opens a pair.
    """
    w = Window.partitionBy(page).orderBy(order)
    after = F.lead(text).over(w)
    flagged = df.withColumn("_after", after).withColumn("_on", goes_on(F.col(text), F.col("_after"), None if gap is None else F.col(gap)))
    # A run of blocks that go on takes in the block after it, whose own flag is false.
    placed = runs(flagged, page, order, F.coalesce(F.lag("_on").over(w), F.lit(False)))
    opens = F.col("_on") & (F.col("place") % 2 == 0)
    marked = placed.withColumn("_open", opens).withColumn("_second", F.coalesce(F.lag("_open").over(w), F.lit(False)))
    whole = F.when(F.col("_open"), F.concat(F.rtrim(text), F.lit(" "), F.ltrim("_after"))).otherwise(F.col(text))
    return marked.where("not _second").select(*(c for c in df.columns if c != text), whole.alias(text), F.col("_open").alias("merged"))


def group_runs(df: DataFrame, page: list[str], order: str, holds: Column, most: int = 4, least: int = 2) -> DataFrame:
    """Rows of a run for which ``holds``, in groups of at most ``most``: ``group_no`` within the run and ``grouped``."""
    placed = runs(df.withColumn("_h", holds), page, order, F.col("_h") & F.coalesce(F.lag("_h").over(Window.partitionBy(page).orderBy(order)), F.lit(False)))
    chunk = placed.withColumn("group_no", F.floor(F.col("place") / most).cast("int"))
    size = F.count("*").over(Window.partitionBy(*page, "run", "group_no"))
    return chunk.withColumn("grouped", F.col("_h") & (size >= least)).drop("_h", "place")


def number(df: DataFrame, group: list[str], order: str, name: str = "n", start: int = 1) -> DataFrame:
    """Rows numbered in order within their group, as after a deletion."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1 + start)


def split_back(first: Column, second: Column, translated: Column) -> tuple[Column, Column]:
    """A translation of two joined blocks cut in the ratio of their lengths."""
    total = F.length(first) + F.length(second)
    n = F.when(total > 0, F.floor(F.length(translated) * F.length(first) / total)).otherwise(0).cast("int")
    return F.trim(F.left(translated, n)), F.trim(F.substring(translated, n + 1, F.length(translated)))


#: Item types that are left out of a page, and those that are kept as they are.
SKIPPED = ("footer", "page_number")
UNTRANSLATED = ("ref_text", "code")


def tasks(items: DataFrame, page: list[str], order: str) -> DataFrame:
    """Texts of content-list items to translate: ``field, text, task_id``, numbered within a page.

    Text-like items give their text, lists each entry, images and tables their captions and footnotes.
    """
    one = lambda field, c: F.array(F.struct(F.lit(field).alias("field"), c.alias("text")))
    many = lambda field, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("text")))
    kind = F.col("type")
    found = (
        F.when(kind.isNull() | kind.isin(*SKIPPED, *UNTRANSLATED), F.array().cast("array<struct<field:string,text:string>>"))
        .when(kind == "list", many("list_item", F.col("list_items")))
        .when(kind == "image", F.concat(many("image_caption", F.col("image_caption")), many("image_footnote", F.col("image_footnote"))))
        .when(kind == "table", F.concat(many("table_caption", F.col("table_caption")), many("table_footnote", F.col("table_footnote"))))
        .otherwise(one("text", F.col("text")))
    )
    rows = items.select(*page, order, "type", F.posexplode(found).alias("_k", "t")).select(*page, order, "type", "_k", "t.*").where(strip(F.coalesce("text", F.lit(""))) != "")
    n = F.row_number().over(Window.partitionBy(page).orderBy(order, "_k")) - 1
    return rows.withColumn("task_id", F.concat(F.lit("page_"), F.col(page[-1]), F.lit("_task_"), n, F.lit("_"), F.col("field"))).drop("_k")
