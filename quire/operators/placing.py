"""Placing images in the text of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.markup import is_text, let
from quire.functions.text import SPACE, lower_each, strip


def by_position(blocks: DataFrame, images: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Blocks and images of an article in one order: blocks evenly over 0 to 1, images by their relative position after equal blocks.

    ``blocks`` has a text column ``html``; ``images`` has ``html`` and ``relative_position``.
    """
    w = Window.partitionBy(keys)
    n = F.count("*").over(w)
    spread = F.when(n > 1, (F.row_number().over(w.orderBy(order)) - 1) / (n - 1)).otherwise(0.0)
    text = blocks.select(*keys, spread.alias("at"), F.lit(0).alias("kind"), F.col(order).cast("long").alias("n"), "html")
    pictures = images.select(*keys, F.coalesce("relative_position", F.lit(0.5)).alias("at"), F.lit(1).alias("kind"), F.col(order).cast("long").alias("n"), "html")
    return text.unionByName(pictures).withColumn("place", F.row_number().over(Window.partitionBy(keys).orderBy("at", "kind", "n")))


def by_rule(paragraphs: Column, figure: Column, position: Column) -> Column:
    """Paragraphs with a figure at the start, after the middle one, or at the end."""
    half = F.ceil(F.size(paragraphs) / 2).cast("int")
    middle = F.concat(F.slice(paragraphs, 1, half), F.array(figure), F.slice(paragraphs, half + 1, F.greatest(F.size(paragraphs) - half, F.lit(0))))
    return F.when(F.size(paragraphs) == 0, F.array(figure)).when(position == "start", F.concat(F.array(figure), paragraphs)).when(position == "end", F.concat(paragraphs, F.array(figure))).otherwise(middle)


def _put(nodes: Column, n: Column, figure: Column, after: Column) -> Column:
    """The page of these nodes with a figure on a line of its own behind the first ``n``; ``after`` follows it."""
    rest = F.slice(nodes, n + 1, F.greatest(F.size(nodes) - n, F.lit(0)))
    return F.concat(F.array_join(F.slice(nodes, F.lit(1), n), ""), F.lit("\n"), figure, after, F.array_join(rest, ""))


def _nth_of(nodes: Column, is_it: Callable[[Column], Column], last: bool = False) -> Column:
    """The place, from 1, of the first or last node that is one; zero if none is."""
    at = F.transform(nodes, lambda x, i: F.when(is_it(x), i + 1))
    return F.coalesce((F.array_max if last else F.array_min)(at), F.lit(0))


def by_anchor(html: Column, figure: Column, anchor: Column, before: Column | bool = False, least: int = 5, trim: Callable[[Column], Column] = strip) -> Column:
    """Html with a figure beside the paragraph that holds the anchor, else beside its text, else before the first closing division,
    else at the end.

    The anchor, without white space around it (as ``trim`` takes it off) and whatever its case, must stand within one text node and have ``least`` characters;
    so a figure never comes into a tag, script, style or comment. It follows, unless ``before`` says otherwise.
    """
    wanted = lower_each(trim(F.coalesce(anchor, F.lit(""))))
    before = F.coalesce(before, F.lit(False)) if isinstance(before, Column) else F.lit(before)
    opens = lambda x: x.rlike(rf"(?i)^<p(?:{SPACE}|>)")
    closes = lambda x: F.lower(x) == "</p>"

    def beside(nodes: Column, hit: Column) -> Column:
        head = F.slice(nodes, F.lit(1), hit)
        start = _nth_of(head, opens, last=True)
        end = _nth_of(F.slice(nodes, hit + 1, F.size(nodes)), closes)
        held = (start > _nth_of(head, closes, last=True)) & (end > 0)
        place = F.when(before, F.when(held, start - 1).otherwise(hit - 1)).otherwise(F.when(held, hit + end).otherwise(hit))
        return let(place, lambda n: _put(nodes, n, figure, F.lit("\n")))

    def elsewhere(nodes: Column) -> Column:
        return let(_nth_of(nodes, lambda x: x == "</div>"), lambda n: F.when(n > 0, _put(nodes, n - 1, figure, F.lit("\n"))).otherwise(_put(nodes, F.size(nodes), figure, F.lit(""))))

    def put(nodes: Column) -> Column:
        hit = F.when(F.length(wanted) >= least, _nth_of(nodes, lambda x: is_text(x) & F.contains(lower_each(x), wanted))).otherwise(0)
        return let(hit, lambda n: F.when(n > 0, beside(nodes, n)).otherwise(elsewhere(nodes)))

    return let(markup.nodes(html), put)


def by_anchors(html: Column, images: Column, figure: Callable[[Column, Column], Column]) -> Column:
    """Html with all its images, one after the other, each by its anchor in what the ones before it left.

    ``images`` are structs with path, anchor and insert_position; those without path and those whose path came before are left out.
    ``figure(image, number)`` gives the html of one, numbered from 1.
    """
    some = F.filter(images, lambda x: F.coalesce(x["path"], F.lit("")) != "")
    paths = F.transform(some, lambda x: x["path"])
    first = F.filter(some, lambda x, i: F.array_position(paths, x["path"]) == i + 1)
    numbered = F.transform(first, lambda x, i: F.struct(x.alias("image"), (i + 1).alias("number")))
    put = F.aggregate(numbered, html, lambda page, x: by_anchor(page, figure(x["image"], x["number"]), x["image"]["anchor"], x["image"]["insert_position"] == "before"))
    return F.when(images.isNull(), html).otherwise(put)


def map_images(images: Column, change) -> Column:
    """An article's nested images, each field changed by ``change(image)``: a dict of names and columns."""

    def changed(image: Column) -> Column:
        for name, value in change(image).items():
            image = image.withField(name, value)
        return image

    return F.transform(images, changed)


def undescribed_pages(articles: DataFrame, file: str, images: str) -> DataFrame:
    """``n_missing`` and ``pages``: a file's images without description."""
    each = articles.select(file, F.explode(images).alias("i")).where(F.trim(F.coalesce("i.description", F.lit(""))) == "")
    return each.groupBy(file).agg(F.count("*").alias("n_missing"), F.sort_array(F.collect_set("i.page")).alias("pages"))
