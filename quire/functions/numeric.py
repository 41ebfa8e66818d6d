"""Numbers: page ranges, positions, delays, error classes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_ranges(total: Column, size: int, overlap: int) -> Column:
    """Page ranges of ``size`` pages that overlap: an array of (batch_idx, start_page, end_page, before, after)."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the batch")
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.cast("int").alias("batch_idx"),
            (s + 1).alias("start_page"),
            F.least(s + size, total).alias("end_page"),
            (s > 0).alias("has_overlap_before"),
            (s + size < total).alias("has_overlap_after"),
        ),
    )


def relative_position(low: Column, high: Column, extent: Column) -> Column:
    """The centre of (low, high) as a share of the extent, within 0 and 1, to four places; 0.5 where unknown."""
    centre = (low + high) / 2 / extent
    return F.when(centre.isNull(), 0.5).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), centre)), 4))


def vertical(share: Column) -> Column:
    return F.when(share < 0.33, "top").when(share > 0.67, "bottom").otherwise("middle")


def horizontal(share: Column) -> Column:
    return F.when(share < 0.33, "left").when(share > 0.67, "right").otherwise("center")


def layout(width: Column, height: Column) -> Column:
    """narrow, wide or normal by aspect."""
    aspect = width / F.nullif(height, F.lit(0))
    return F.when(aspect < 0.6, "narrow").when(aspect > 1.8, "wide").otherwise("normal")


def insert_position(vertical_position: Column) -> Column:
    return F.when(vertical_position == "top", "start").when(vertical_position == "bottom", "end").otherwise("middle")


def backoff(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait before a retry: doubling from base, capped."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))), F.lit(cap))


def is_retryable(message: Column) -> Column:
    """Is an error one that passes by itself?"""
    low = F.lower(message)
    lasting = low.rlike("401|403|400|404|unauthorized|forbidden|invalid|insufficient")
    passing = low.rlike("429|5[0-9][0-9]|timeout|timed out|connection|network|temporar|rate limit|too many")
    return F.when(lasting & ~low.rlike("429|timeout"), False).when(passing, True).otherwise(False)


def split_pages(pages: Column, size_mb: Column, limit_mb: float) -> Column:
    """Pages for each part of a file that is too large; all of them where it is not."""
    return F.when(size_mb <= limit_mb, pages).otherwise(F.greatest(F.lit(1), F.floor(pages * limit_mb / size_mb * 0.9).cast("int")))


def file_signature(path: Column, size: Column, mtime: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, size.cast("string"), mtime.cast("string")))


def path_id(path: Column) -> Column:
    return F.left(F.md5(path), F.lit(16))


def engine_backoff(attempt: Column, initial: float = 1.0, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait after the n-th attempt, from 1: initial times base to the n - 1, capped."""
    return F.least(F.lit(initial) * F.pow(F.lit(base), attempt - 1), F.lit(cap))


#: Kinds of errors that a caller may want asked again, and what their messages say.
RETRY_KINDS = {"timeout": "timeout|timed out", "rate_limit": "429|rate limit|too many", "server": r"\b5[0-9][0-9]\b|server error", "network": "connection|network"}


def should_retry(message: Column, attempt: Column, most: int, **kinds: bool) -> Column:
    """Is a failed call to be made again: fewer than ``most`` attempts, and an error of a kind that is not switched off?"""
    low = F.lower(F.coalesce(message, F.lit("")))
    wanted = [pattern for kind, pattern in RETRY_KINDS.items() if kinds.get(kind, True)]
    return (attempt < most) & (low.rlike("|".join(wanted)) if wanted else F.lit(False))
