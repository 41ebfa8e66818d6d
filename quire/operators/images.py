"""Images of articles: filters, references, deduplication, covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_reason(form: Column, size: Column, width: Column, height: Column, richness: Column) -> Column:
    """Why an image fails the strict filter, the cheapest test first; null if it passes."""
    return (
        F.when(~F.lower(form).isin("jpg", "jpeg", "png"), "format")
        .when(size < 10 * 1024, "size")
        .when((width < 400) | (height < 300), "dimensions")
        .when(richness < 0.20, "richness")
    )


def loose_reason(size: Column, width: Column, height: Column, richness: Column) -> Column:
    """Why an image fails the loose filter; null if it passes."""
    aspect = width / F.nullif(height, F.lit(0))
    return (
        F.when(size < 50 * 1024, "size")
        .when((width < 100) | (height < 100), "dimensions")
        .when(aspect.isNull() | (aspect < 0.1) | (aspect > 10), "aspect")
        .when(richness < 0.1, "richness")
    )


def is_full_page(width: Column, height: Column, page_width: Column, page_height: Column, share: float = 0.9, aspect_gap: float = 0.1) -> Column:
    """Does an image fill its page?"""
    area = width * height / (page_width * page_height)
    return (width / page_width >= share) & (height / page_height >= share) & (area >= share * share) & (F.abs(width / height - page_width / page_height) <= aspect_gap)


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """``reason, n, share`` of all rows, passes under 'kept'."""
    by = df.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def check_references(refs: DataFrame, images: DataFrame, key: str, order: str, page: str, ref_page: str, reach: int = 3) -> DataFrame:
    """``refs`` with ``verdict``: format (no key, or a blank one), missing, page (too far), repeated (its image is already taken) or accepted.

    An image goes to its first reference within ``reach`` pages; references that fail by page do not take it. Those without key meet
    no image, so that they are not dealt out, which would bring them all to one task.
    """
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    known = images.groupBy(key).agg(F.min(page).alias("_page"))
    joined = refs.where(~blank).join(known, key, "left")
    near = F.abs(F.col(ref_page) - F.col("_page")) <= reach
    taken = joined.where(near).groupBy(key).agg(F.min(order).alias("_taken"))  # combined before the shuffle, however often an image is named
    verdict = F.when(F.col("_page").isNull(), "missing").when(F.col("_taken").isNotNull() & (F.col(order) > F.col("_taken")), "repeated").when(~near, "page").otherwise("accepted")
    judged = joined.join(taken, key, "left").withColumn("verdict", verdict).drop("_page", "_taken")
    return judged.unionByName(refs.where(blank).withColumn("verdict", F.lit("format")))


def undescribed(images: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    return images.join(refs.select(key).distinct(), key, "left_anti")


def best_of_each(df: DataFrame, keys: list[str], score: Column, order: str) -> DataFrame:
    """Of each group the row of the highest score, the first one in order on ties."""
    worst = F.coalesce(-score.cast("double"), F.lit(float("inf")))
    rows = df.select(*keys, F.struct(worst.alias("s"), F.col(order).alias("o"), F.struct(*df.columns).alias("row")).alias("_r"))
    return rows.groupBy(keys).agg(F.min("_r").alias("_r")).select("_r.row.*")


def dedup_by_path(df: DataFrame, path: str, order: str) -> DataFrame:
    """The first image of each path; those without a path all stay."""
    first = F.row_number().over(Window.partitionBy(path).orderBy(order)) == 1
    return df.withColumn("_f", first | (F.coalesce(F.col(path), F.lit("")) == "")).where("_f").drop("_f")


def annotation_score(meaningful: Column, article: Column) -> Column:
    """What an image's annotation is worth: two for a meaningful image, one for a named article."""
    return F.when(meaningful, 2).otherwise(0) + F.when(F.coalesce(article, F.lit("")) != "", 1).otherwise(0)


def cover_score(width: Column, height: Column, richness: Column | None = None) -> Column:
    """Area, times richness where it counts; usual values where unknown."""
    area = F.coalesce(width, F.lit(800)) * F.coalesce(height, F.lit(600))
    return area if richness is None else area * F.coalesce(richness, F.lit(0.5))


def groups_of(df: DataFrame, page: list[str], order: str, n: int) -> DataFrame:
    """``group_no``: a page's images in groups of ``n``, for one model call each."""
    w = Window.partitionBy(page).orderBy(order)
    return df.withColumn("group_no", F.floor((F.row_number().over(w) - 1) / n).cast("int"))


def caption(strategy: str, name: Column, page: Column, vertical_position: Column) -> Column:
    """A caption by a strategy: position_based, filename or none."""
    if strategy == "filename":
        return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]+", " ")
    return F.concat(F.lit("Page "), page, F.lit(", "), vertical_position) if strategy == "position_based" else F.lit("")


def number_figures(df: DataFrame, article: list[str], path: str, order: str) -> DataFrame:
    """The first image of each path of an article, with its ``figure`` number from 1."""
    first = df.groupBy(*article, path).agg(F.min(order).alias(order))
    return df.join(first, [*article, path, order]).withColumn("figure", F.row_number().over(Window.partitionBy(article).orderBy(order)))


def attach_to_titles(articles: DataFrame, pictures: DataFrame, file: str, order: str, picture_order: str, name: str, cover_page: int = 1) -> DataFrame:
    """Articles (title, images: an array of names) with the names of further pictures at the end of ``images``.

    A picture that is not on the cover page and passes the loose filter goes to the first article of its file with the title
    that it names.
    """
    fit = loose_reason(F.col("size"), F.col("width"), F.col("height"), F.col("color_richness")).isNull()
    good = pictures.where((F.coalesce("page", F.lit(0)) != cover_page) & fit & F.col("belongs_to_article").isNotNull())
    first = articles.groupBy(F.col(file).alias("_f"), F.col("title").alias("_t")).agg(F.min(order).alias("_a"))
    named = good.select(F.col(file).alias("_f"), F.col("belongs_to_article").alias("_t"), F.struct(F.col(picture_order).alias("o"), F.col(name).alias("n")).alias("_p"))
    lists = named.join(first, ["_f", "_t"]).groupBy("_f", "_a").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    out = articles.join(lists, (F.col(file) == F.col("_f")) & (F.col(order) == F.col("_a")), "left")
    more = F.coalesce(F.transform("_p", lambda p: p["n"]), F.array().cast("array<string>"))
    return out.withColumn("images", F.concat(F.coalesce("images", F.array().cast("array<string>")), more)).select(articles.columns)


def first_existing(rows: DataFrame, files: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """``rows`` with the first of the candidate paths that is among ``files`` (path), else null."""
    known, out = files.select("path").distinct(), rows
    for k, c in enumerate(candidates):
        out = out.join(known.select(F.col("path").alias(f"_p{k}")), F.col(c) == F.col(f"_p{k}"), "left")
    return out.withColumn(name, F.coalesce(*(f"_p{k}" for k in range(len(candidates))))).drop(*(f"_p{k}" for k in range(len(candidates))))


def reusable(cached: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of cached images that may be used again: some image of theirs has a description."""
    return cached.groupBy(keys).agg(F.bool_or(F.trim(F.coalesce("description", F.lit(""))) != "").alias("_some")).where("_some").drop("_some")
