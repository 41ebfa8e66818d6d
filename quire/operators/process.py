"""From fragments to pages: the whole of a periodical's processing as one plan for all files at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import articles, fragments, images, matching, render, translate


@dataclass
class Processed:
    """What comes out, as lazy tables: ``articles`` (with ``article_idx`` and ``images``), ``translated`` and the two sets of pages."""

    articles: DataFrame
    translated: DataFrame
    pages: DataFrame
    translated_pages: DataFrame


def process(parts: DataFrame, pictures: DataFrame, cache: DataFrame, names: DataFrame, client: translate.Client) -> Processed:
    """Merge fragments, leave out what is no article and advertisements, give images to articles, translate and render.

    ``parts`` is merge_fragments()' input; ``pictures`` has file_id, page, path, size, width, height, color_richness;
    ``cache`` has file_id, article_idx, translated (of contents); ``names`` gives each file_id its ``name``.
    """
    merged = articles.drop_ads(articles.drop_non_articles(fragments.merge_fragments(parts)))
    order = Window.partitionBy("file_id").orderBy(F.coalesce("start_page", F.lit(0)), "title", "content")
    numbered = merged.withColumn("article_idx", F.row_number().over(order) - 1)
    fit = images.loose_reason(F.col("size"), F.col("width"), F.col("height"), F.col("color_richness")).isNull()
    good = images.dedup_by_path(pictures.where(fit), "path", "page")
    ranges = numbered.where("start_page is not null and end_page is not null").select("file_id", "article_idx", "start_page", "end_page")
    found = matching.match_pages(good.select("file_id", "path", "page"), ranges, "file_id", "page", "start_page", "end_page", "article_idx")
    lists = found.groupBy("file_id", "article_idx").agg(F.array_sort(F.collect_list(F.struct("page", "path"))).alias("_p"))
    known = numbered.drop("images").join(lists, ["file_id", "article_idx"], "left").withColumn("images", F.coalesce(F.transform("_p", lambda x: x["path"]), F.array().cast("array<string>"))).drop("_p")
    done = translate.translate_missing(known, cache, ["file_id", "article_idx"], "content", client)
    shown = done.withColumn("content", F.coalesce("translated", "content"))
    page = lambda df: render.documents(df.join(names, "file_id"), "file_id", "article_idx", "name")
    return Processed(known, done, page(known), page(shown))
