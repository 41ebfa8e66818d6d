"""Html as a sequence of nodes: tags, comments, scripts, styles, and the text between them, whose edits leave all else alone.

The nodes of a page, put together, are the page. A ``<`` that opens nothing is text, and so is a tag that no ``>`` ends; a script, a
style or a comment that is not closed goes to the page's end. Character references stay as they are written. A null page has no nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE

NODE = r"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|</?[a-z](?:[^<>"']|"[^"]*"|'[^']*')*>|<[a-z/!?][^<>]*>|[^<]+|<"""

#: The same for Java, which would else remember each step of a long tag, end words at ASCII letters alone or not by its version, take a
#: vertical tab for white space, and know no ſ and K (the Kelvin sign) as cases of s and k.
_NODE = NODE.replace("""(?:[^<>"']|"[^"]*"|'[^']*')*""", """(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
for _of, _by in ((r"\b", "(?![0-9a-z_])"), (r"\s", SPACE), ("<s", "<[sſ]"), ("</s", "</[sſ]"), ("?[a-z]", "?[a-zſ\u212a]"), ("<[a-z/!?]", "<[a-zſ\u212a/!?]")):
    _NODE = _NODE.replace(_of, _by)

#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which the value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nodes(html: Column) -> Column:
    """The nodes of a page as an array of strings."""
    return F.regexp_extract_all(html, F.lit(_NODE), F.lit(0))


def is_text(node: Column) -> Column:
    return ~F.startswith(node, F.lit("<")) | (node == "<")


def map_text(html: Column, change: Callable[[Column], Column]) -> Column:
    """A page with its text nodes changed."""
    return F.array_join(F.transform(nodes(html), lambda x: F.when(is_text(x), change(x)).otherwise(x)), "")


def node_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """``keys, n, begin, kind, tag, depth, node``: the nodes of each page as rows.

    ``begin`` counts characters from 1, ``kind`` is open, close, void, text or other, and ``depth`` is the number of elements that
    are open before the node, end tags without a beginning counting as one less.
    """
    rows = pages.select(*keys, F.posexplode(nodes(F.col(html))).alias("n", "node"))
    node = F.col("node")
    tag = F.lower(F.regexp_extract(node, r"^</?([A-Za-z][^\s/>]*)", 1))
    kind = (
        F.when(is_text(node), "text")
        .when(F.startswith(node, F.lit("</")), "close")
        .when((tag == "") | tag.isin("script", "style"), "other")
        .when(tag.isin(*VOID) | F.endswith(node, F.lit("/>")), "void")
        .otherwise("open")
    )
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    named = rows.withColumn("tag", F.when(tag != "", tag)).withColumn("kind", kind)
    placed = named.withColumn("begin", F.coalesce(F.sum(F.length("node")).over(before), F.lit(0)) + 1).withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
    return placed.select(*keys, "n", "begin", "kind", "tag", "depth", "node")


def joined(rows: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Pages from the rows of node_rows(), some of which may have been changed."""
    parts = F.array_sort(F.collect_list(F.struct("n", "node")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["node"]), "").alias(html))
