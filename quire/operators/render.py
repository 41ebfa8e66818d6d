"""Html strings from article tables; the files themselves are written by quire.sources.sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ellipsis


def escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(df: DataFrame, keys: list[str], order: str, part: str, name: str, separator: str = "") -> DataFrame:
    """Parts of a group in order, as one string, with their number in n_articles."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p"))))
    return df.groupBy(keys).agg(F.count("*").alias("n_articles"), F.array_join(F.transform(rows, lambda x: x["p"]), separator).alias(name))


def toc_table(df: DataFrame, file: str, order: str, title: str) -> DataFrame:
    """Each file's table of contents: numbered rows of shortened titles."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(order))
    row = F.concat(F.lit("<tr><td>"), F.col("_n"), F.lit("</td><td>"), escape(ellipsis(F.col(title))), F.lit("</td></tr>"))
    parts = joined(df.withColumn("_n", n).withColumn("_row", row), [file], "_n", "_row", "rows")
    return parts.select(file, "n_articles", F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("toc"))


def figure(path: Column, description: Column, native_caption: Column, number: Column, page: Column, position: Column) -> Column:
    """An image with its caption: its own description, or nothing under a native one, or its number, page and place."""
    made = F.concat(F.lit("Figure "), number, F.lit(" (Page "), page, F.lit(", "), position, F.lit(")"))
    caption = F.when(F.coalesce(description, F.lit("")) != "", escape(description)).when(native_caption, "").otherwise(made)
    return F.concat(F.lit('<figure><img src="'), escape(path), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))


def article(number: Column, title: Column, authors: Column, content: Column, not_in_toc: Column) -> Column:
    """An article's division: heading, authors and a paragraph per blank-line block."""
    paragraphs = F.array_join(F.transform(F.split(escape(content), r"\n\s*\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    mark = F.when(F.coalesce(not_in_toc, F.lit(False)), ' data-not-in-toc="true"').otherwise("")
    by = F.when(F.coalesce(authors, F.lit("")) != "", F.concat(F.lit('<p class="authors">'), escape(authors), F.lit("</p>"))).otherwise("")
    return F.concat(F.lit('<div class="article" id="article-'), number, F.lit('"'), mark, F.lit("><h2>"), escape(title), F.lit("</h2>"), by, paragraphs, F.lit("</div>"))


def documents(df: DataFrame, file: str, order: str, name: str, title: str = "title", authors: str = "authors", content: str = "content", not_in_toc: str = "not_in_toc") -> DataFrame:
    """``file, n_articles, html``: a page of every file with title, table of contents and its articles, numbered in order."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order)))
    rows = numbered.withColumn("_article", article(F.col("_n"), F.col(title), F.col(authors), F.col(content), F.col(not_in_toc))).withColumn(
        "_toc", F.concat(F.lit('<li><a href="#article-'), F.col("_n"), F.lit('">'), escape(ellipsis(F.col(title))), F.lit("</a></li>"))
    )
    parts = F.array_sort(F.collect_list(F.struct("_n", "_article", "_toc")))
    out = rows.groupBy(file).agg(F.count("*").alias("n_articles"), F.first(name, ignorenulls=True).alias("_name"), parts.alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda x: x["_article"]), "\n")
    toc = F.array_join(F.transform("_parts", lambda x: x["_toc"]), "")
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape(F.col("_name")), F.lit("</title><style></style></head><body><h1>"), escape(F.col("_name")), F.lit("</h1>"))
    return out.select(file, "n_articles", F.concat(head, F.lit("<ol>"), toc, F.lit("</ol>"), body, F.lit("</body></html>")).alias("html"))


def or_placeholder(df: DataFrame, html: str = "html", title: str = "title") -> DataFrame:
    """``df`` with a placeholder where a page's html is blank, and ``made``: was it there?"""
    made = F.trim(F.coalesce(F.col(html), F.lit(""))) != ""
    stand_in = F.concat(F.lit('<div class="article missing">'), escape(F.col(title)), F.lit("</div>"))
    return df.withColumn("made", made).withColumn(html, F.when(made, F.col(html)).otherwise(stand_in))


#: Elements after which no empty ones are wanted.
SPACED = "h3|h4|h5|blockquote|ul|ol|figure"


def tight_spacing(html: Column, most: int = 5) -> Column:
    """Without line breaks, white space and empty paragraphs, ``most`` of them at a time, right after headings, quotes, lists and figures."""
    empty = r"(?:<br\s*/?>|\s+|<(?:p|div)(?:\s[^>]*)?>(?:\s|&nbsp;)*</(?:p|div)>)"
    return F.regexp_replace(html, f"(?i)(</(?:{SPACED})>){empty}{{1,{most}}}", "$1")


def block(kind: Column, text: Column, level: Column, items: Column, path: Column, caption: Column) -> Column:
    """A page's block as html by its type: text (a heading where it has a level), list, table (html as it is), image, else nothing."""
    said = escape(text)
    n = F.least(level + 1, F.lit(6)).cast("string")
    heading = F.concat(F.lit("<h"), n, F.lit(">"), said, F.lit("</h"), n, F.lit(">"))
    listed = F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), escape(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    image = F.concat(F.lit('<figure><img src="'), escape(path), F.lit('"><figcaption>'), escape(caption), F.lit("</figcaption></figure>"))
    return (
        F.when(kind == "text", F.when(F.coalesce(level, F.lit(0)) > 0, heading).otherwise(F.concat(F.lit("<p>"), said, F.lit("</p>"))))
        .when(kind == "list", F.coalesce(listed, F.lit("")))
        .when(kind == "table", F.concat(F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("<p>"), escape(caption), F.lit("</p>"))).otherwise(""), F.coalesce(text, F.lit(""))))
        .when(kind == "image", image)
        .otherwise("")
    )


def side_bar(df: DataFrame, file: str, order: str, title: str) -> DataFrame:
    """Each file's navigation: a link for every article, numbered in order."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order)))
    item = F.concat(F.lit('<li class="toc-item"><a href="#article-'), F.col("_n"), F.lit('">'), escape(ellipsis(F.col(title))), F.lit("</a></li>"))
    rows = joined(numbered.withColumn("_item", item), [file], "_n", "_item", "items")
    return rows.select(file, "n_articles", F.concat(F.lit('<nav class="table-of-contents"><ul>'), "items", F.lit("</ul></nav>")).alias("side_bar"))
