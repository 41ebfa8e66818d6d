"""Tables that were found on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def markdown(rows: Column) -> Column:
    """A markdown table from an array of arrays: the first row is the head, short rows are filled, blank ones dropped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(clean, F.lit(0)))), F.array(rule), F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), line))
    return F.when(F.size(clean) > 0, F.array_join(lines, "\n")).otherwise("")


def anchors(blocks: Column, top: Column, bottom: Column) -> dict[str, Column]:
    """From blocks (y0, y1, text): the last two texts above, the first two below, and a caption among the nearest."""
    ordered = F.array_sort(blocks)
    above = F.filter(ordered, lambda b: b["y1"] <= top)
    below = F.filter(ordered, lambda b: b["y0"] >= bottom)
    n = F.size(above)
    up = F.transform(F.slice(above, F.greatest(n - 1, F.lit(1)), 2), lambda b: b["text"])
    down = F.transform(F.slice(below, 1, 2), lambda b: b["text"])
    title = r"(?i)^\s*((?:table|tab\.|表)\s*\d+.*)"
    found = lambda texts: F.get(F.filter(F.transform(texts, lambda t: F.regexp_extract(t, title, 1)), lambda t: t != ""), F.lit(0))
    return {"anchor_before": F.array_join(up, "\n"), "anchor_after": F.array_join(down, "\n"), "caption": F.coalesce(found(down), found(up))}


def continue_tables(df: DataFrame, file: str, order: str, chains: bool = True) -> DataFrame:
    """Tables (page, n_columns, caption, rows) with those on the next page that go on appended.

    A table goes on one that ends on the page before if it has no caption and at most one column more or less. Without
    ``chains`` only the first page after a table's first one counts.
    """
    w = Window.partitionBy(file).orderBy(order)
    page, columns = F.col("page"), F.col("n_columns")
    goes = F.coalesce((page == F.lag(page).over(w) + 1) & (F.coalesce("caption", F.lit("")) == "") & (F.abs(columns - F.lag(columns).over(w)) <= 1), F.lit(False))
    marked = df.withColumn("_goes", goes).withColumn("_head", F.sum(F.when(goes, 0).otherwise(1)).over(w))
    if not chains:
        place = F.row_number().over(Window.partitionBy(file, "_head").orderBy(order))
        marked = marked.withColumn("_place", place).withColumn("_goes", F.col("_goes") & (F.col("_place") == 2)).withColumn("_head", F.sum(F.when(F.col("_goes"), 0).otherwise(1)).over(w)).drop("_place")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "page", "n_columns", "caption", "rows")))
    merged = marked.groupBy(file, "_head").agg(parts.alias("_p"))
    rows = F.flatten(F.transform("_p", lambda p, i: F.when(i == 0, p["rows"]).otherwise(F.slice(p["rows"], 2, F.greatest(F.size(p["rows"]) - 1, F.lit(0))))))
    first = F.get("_p", F.lit(0))
    return merged.select(file, first["o"].alias(order), first["page"].alias("page"), first["n_columns"].alias("n_columns"), first["caption"].alias("caption"), F.size("_p").alias("n_parts"), rows.alias("rows"))
