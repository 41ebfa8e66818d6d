"""Prompt texts and the tables that they show a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.layout import neighbours


def numbered(items: Column, line) -> Column:
    """Lines of an array, numbered from 1; ``line`` makes a line of an entry and its number."""
    return F.array_join(F.transform(items, lambda x, i: line(x, i + 1)), "\n")


def outline_context(name: Column, issue: Column, summary: Column, articles: Column) -> Column:
    """What a file's outline says: name, issue, summary and its articles (title, subtitle, authors), without empty lines."""
    known = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    line = lambda x, n: F.concat_ws(" | ", F.concat(n.cast("string"), F.lit(". "), x["title"]), F.nullif(x["subtitle"], F.lit("")), F.nullif(x["authors"], F.lit("")))
    listed = F.when(F.size(articles) > 0, F.concat(F.lit("Contents:\n"), numbered(articles, line)))
    return F.concat_ws("\n", known("Journal", name), known("Issue", issue), known("Summary", summary), listed)


def context_prompt(df: DataFrame, page: list[str], order: str, text: str, chapter: str, n: int = 500) -> DataFrame:
    """``prompt``: a block between the end of the one before and the beginning of the next one, with its chapter."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    rows = neighbours(df, page, order, text, n)
    return rows.withColumn("prompt", F.concat_ws("\n", part("Chapter", chapter), part("Before", "before"), part("After", "after"), F.concat(F.lit("Text:\n"), text))).drop("before", "after")


def language_prompt(prompts: dict[str, str], language: Column, default: str) -> Column:
    """The prompt of a language, by name; the default where there is none."""
    return F.coalesce(*(F.when(F.lower(language) == k.lower(), F.lit(v)) for k, v in prompts.items()), F.lit(default))


def image_table(images: Column) -> Column:
    """A markdown table of images (name, page, vertical and horizontal position, size in KB)."""
    line = lambda x, n: F.concat(F.lit("| "), F.concat_ws(" | ", n.cast("string"), x["name"], x["page"].cast("string"), x["vertical_position"], x["horizontal_position"], F.round(x["size"] / 1024, 1).cast("string")), F.lit(" |"))
    head = "| # | name | page | vertical | horizontal | KB |\n| --- | --- | --- | --- | --- | --- |"
    return F.when(F.size(images) > 0, F.concat(F.lit(head + "\n"), numbered(images, line))).otherwise("")


def box_size(width: Column, height: Column, box: Column) -> dict[str, Column]:
    """An image's size, from its box where it is not known."""
    side = lambda a, b: F.round(F.get(box, F.lit(b)) - F.get(box, F.lit(a))).cast("int")
    return {"width": F.coalesce(F.nullif(width, F.lit(0)), side(0, 2)), "height": F.coalesce(F.nullif(height, F.lit(0)), side(1, 3))}
