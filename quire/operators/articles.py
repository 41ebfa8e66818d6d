"""Filters and checks of articles (title and content)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, contains_any, lower_each, strip
from quire.operators.filters import ODD, gathered, is_set, packed, places

#: Words in the titles of tables of contents, of cover pages and of advertisements.
TOC_WORDS = ("contents", "table of contents", "toc", "目录", "目次", "もくじ", "contenido", "índice", "sommaire")
COVER_WORDS = ("cover", "front cover", "back cover", "copyright", "publication info", "封面", "版权", "出版信息")
AD_WORDS = ("广告", "广告：", "Advertisement", "AD:", "Sponsored", "赞助")
PAGE_MARKS = (" p.", " pp.", "页")

#: How a text begins that was cut.
CUT_BEGINNINGS = ("less", "ness", "ment", "tion", "sion", "ing", "ed", "er", "est", "ly", "ful", "able", "ible", "ous", "ive", "al", "ic", "ant", "ent")
JOINING_WORDS = ("and", "but", "or", "nor", "yet", "so", "because", "although", "though", "since", "unless", "while", "was", "were", "been", "being", "having", "doing")
SMALL_WORDS = tuple(
    "the that this which what who where when why how it he she they we as if in on at to for by from with of "
    "a an is are have has do does did will would should could may might must can shall".split()
)


def page_lines(content: Column) -> Column:
    """How many lines are a number or name a page."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(rf"^{SPACE}*[0-9]+{SPACE}*\z") | contains_any(x, PAGE_MARKS)))


def is_article(title: Column, content: Column, max_lines: int = 30, page_share: float = 0.3, empty: bool = False) -> Column:
    """Not a table of contents, a cover, or (unless ``empty``) without title and content."""
    low = lower_each(strip(F.coalesce(title, F.lit(""))))
    body = F.coalesce(content, F.lit(""))
    n = F.size(F.split(body, "\n"))
    listing = (body != "") & (n < max_lines) & (page_lines(body) > n * page_share)
    return (F.lit(empty) | (low != "") | (strip(body) != "")) & ~contains_any(low, TOC_WORDS) & ~contains_any(low, COVER_WORDS) & ~listing


def drop_non_articles(df: DataFrame, title: str = "title", content: str = "content", empty: bool = False) -> DataFrame:
    return df.where(is_article(F.col(title), F.col(content), empty=empty))


def drop_empty(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Rows with a title or a content."""
    return df.where((strip(F.coalesce(F.col(title), F.lit(""))) != "") | (strip(F.coalesce(F.col(content), F.lit(""))) != ""))


def drop_short(df: DataFrame, content: str = "content", min_chars: int = 50) -> DataFrame:
    return df.where(F.length(strip(F.col(content))) >= min_chars)


def ad_reason(title: Column, words: Sequence[str] = AD_WORDS, whole_words: bool = False) -> Column:
    """The first advertisement word in a title, whatever its case, else null; ``whole_words`` asks for word ends around it."""
    low = F.lower(title)
    if whole_words:
        return F.coalesce(*(F.when(low.rlike(rf"(?U)(?<!\w)\Q{w.lower()}\E(?!\w)"), F.lit(w)) for w in words))
    return F.coalesce(*(F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words))


def drop_ads(df: DataFrame, title: str = "title", words: Sequence[str] = AD_WORDS, whole_words: bool = False) -> DataFrame:
    return df.where(ad_reason(F.col(title), words, whole_words).isNull())


def start_quality(content: Column) -> Column:
    """Does a text begin as if cut: ok, cut, likely_cut, maybe_cut or odd."""
    words = F.filter(F.split(content, r"\s+"), lambda x: x != "")
    first = F.regexp_replace(F.lower(F.get(words, F.lit(0))), "[.,!?;:]+$", "")
    second = F.get(words, F.lit(1))
    small = F.when(second.rlike(r"^\p{Lu}"), "ok").otherwise("maybe_cut")
    return (
        F.when(content.isNull() | (F.length(content) < 50) | first.isNull() | ~content.rlike(r"^\p{Ll}"), "ok")
        .when(first.rlike(f"^({'|'.join(CUT_BEGINNINGS)})"), "cut")
        .when(first.isin(*JOINING_WORDS), "likely_cut")
        .when(first.isin(*SMALL_WORDS), small)
        .when(F.length(first) >= 4, "odd")
        .otherwise("ok")
    )


def content_head(content: Column) -> Column:
    """What two contents are compared by."""
    return strip(F.lower(F.left(content, F.lit(500))))


def is_content_duplicate(a: Column, b: Column) -> Column:
    """Is one head the other's beginning, or part of it?"""
    x, y = content_head(a), content_head(b)
    n = F.least(F.length(x), F.length(y))
    return (n > 0) & ((F.left(x, n) == F.left(y, n)) | F.when(F.length(x) < F.length(y), F.contains(y, x)).otherwise(F.contains(x, y)))


def outline_problems(name: Column, kind: Column, summary: Column) -> Column:
    """What is wrong with an outline, as an array."""
    return F.array_compact(
        F.array(
            F.when(strip(F.coalesce(name, F.lit(""))) == "", "no name"),
            F.when(contains_any(F.lower(F.coalesce(summary, F.lit(""))), ("error", "failed")), "error mark"),
            F.when(F.coalesce(F.lower(kind), F.lit("unknown")) == "unknown", "type unknown"),
        )
    )


def renumbered(df: DataFrame, file: str, order: str, title: str, not_in_toc: str, words: Sequence[str] = AD_WORDS) -> DataFrame:
    """Each file's articles that are in its contents and no advertisement, with a new ``number`` from 1 and the file's ``n_removed``.

    The page, its contents and its side bar are rendered from these rows, so all of them are numbered alike.
    """
    marked = df.withColumn("_keep", ~F.coalesce(F.col(not_in_toc), F.lit(False)) & ad_reason(F.col(title), words).isNull())
    gone = marked.groupBy(file).agg(F.count_if(~F.col("_keep")).alias("n_removed"))
    number = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return marked.where("_keep").drop("_keep").withColumn("number", number).join(gone, file)


def with_content(df: DataFrame, content: str = "content") -> DataFrame:
    """The articles that a page is made of: those whose content is not blank."""
    return df.where(strip(F.coalesce(F.col(content), F.lit(""))) != "")


#: The lengths of the beginnings by which heads are looked up in longer ones.
LEADS = (1, 2, 3, 4, 5, 6, 7, 8, 16, 32, 64, 128, 256, 480)


def anchors(heads: pd.Series, lead: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, key, place``: for each stretch of ``lead`` characters of a head (with ``own`` only the one it begins with), the run of half
    that length with the least hash, the first one on ties. So equal stretches give the same key at the same place within them.

    Of a long lead few different runs remain: about four for each of a head's parts of that length.
    """
    sizes = heads.str.len().to_numpy()
    wide = max(int(sizes.max()), lead)
    codes = np.zeros((len(heads), wide), "<u4")
    for i, head in enumerate(heads):
        c = np.frombuffer(head.encode("utf-32-le", "surrogatepass"), "<u4")
        codes[i, : len(c)] = c
    run = lead if lead < 8 or lead == LEADS[-1] else lead // 2
    if own:
        codes = codes[:, :lead]
    key = codes.astype(np.uint64) + np.uint64(1)
    n = 1  # hashes of runs of n characters, doubled as long as they fit, and then of two that overlap
    while n < run:
        step = min(n, run - n)
        key = (key[:, : key.shape[1] - step] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) ^ (key[:, step:] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * step) >> np.uint64(7))
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        n += step
    key = (key * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1023) | np.arange(key.shape[1], dtype=np.uint64)
    span, n = lead - run + 1, 1
    while n < span:
        step = min(n, span - n)
        key = np.minimum(key[:, : key.shape[1] - step], key[:, step:])
        n += step
    at = np.arange(key.shape[1])
    fits = at[None, :] <= (sizes - lead)[:, None]
    fits[:, 1:] &= key[:, 1:] != key[:, :-1]
    rows, windows = np.nonzero(fits)
    found = key[rows, windows]
    return rows, (found >> np.uint64(10)).astype(np.int64), (found & np.uint64(1023)).astype(np.int16)


def _spots(keys: np.ndarray, seeds: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter for each anchor of a file (by its seed) and a lead."""
    return places(keys.view(np.uint64) + np.uint64(lead * int(ODD[0]) & (1 << 64) - 1), seeds.view(np.uint64))


def anchor_filter(short: DataFrame, file: str) -> np.ndarray | None:
    """The filter of the anchors of the beginnings of heads (file, head, leads); none if there are no heads."""

    @F.pandas_udf("array<bigint>")
    def own(heads: pd.Series, leads: pd.Series, seeds: pd.Series) -> pd.Series:
        out = pd.Series([[]] * len(heads), dtype=object)
        for lead, some in leads.groupby(leads):
            rows, keys, _ = anchors(heads[some.index], int(lead), own=True)
            at = some.index[rows]
            for i, *spots in zip(at, *_spots(keys, seeds[at].to_numpy(), int(lead)), strict=True):
                out[i] = spots
        return out

    bits = short.select(F.lit("heads").alias("of"), F.explode(own(F.col("head"), F.col("leads")[0], F.xxhash64(file))).alias("bit"))
    return gathered(packed(bits, "of")).get("heads")


def _anchored(heads: DataFrame, file: str, own: bool, bits: np.ndarray | None = None) -> DataFrame:
    """``file, id, size, lead, key, place`` of heads (file, id, head, leads): anchors() for all leads, or for the one of the head's length.

    With a filter only the anchors that it lets through.
    """
    kind = dict(heads.dtypes)[file]
    shared = None if bits is None else heads.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
                ids, texts = b.column(1), b.column(2).to_pandas()
                wanted, seeds = b.column(3).to_pylist(), b.column(4).to_numpy()
                size = texts.str.len().to_numpy()
                for lead in sorted({x for some in wanted for x in some}):
                    some = np.flatnonzero([lead in x for x in wanted] & (size >= lead))
                    if len(some):
                        rows, keys, at = anchors(texts.iloc[some], lead, own)
                        if shared is not None:
                            first, second = _spots(keys, seeds[some][rows], lead)
                            may = np.flatnonzero(is_set(shared.value, first))
                            may = may[is_set(shared.value, second[may])]
                            rows, keys, at = rows[may], keys[may], at[may]
                        of = pa.array(some[rows])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(of), ids.take(of), pa.array(size[some][rows].astype(np.int16)), pa.array(np.full(len(rows), lead, np.int16)), pa.array(keys), pa.array(at)],
                            [file, "id", "size", "lead", "key", "place"],
                        )

    return heads.select(file, "id", "head", "leads", F.xxhash64(file)).mapInArrow(run, f"{file} {kind}, id long, size short, lead short, key long, place short")


def head_classes(df: DataFrame, file: str, order: str, content: str) -> DataFrame:
    """``file, head, first, n_rows, n_longer``: classes of a file's equal heads, and how many longer heads begin with or hold each.

    Heads are made distinct first. A head that lies in a longer one has its beginning there, and with it the beginning's anchor: heads
    meet by anchors alone, as numbers, and those whose places and lengths allow it are compared. Nothing is left out. Of the anchors
    within heads only those go on that a filter of all beginnings' anchors lets through; it is gathered by a job of its own.
    """
    heads = df.withColumn("head", content_head(F.col(content))).where("head != ''").groupBy(file, "head").agg(F.min(order).alias("first"), F.count("*").alias("n_rows"))
    named = heads.withColumn("id", F.xxhash64("head"))
    n = F.length("head")
    own = F.element_at(F.filter(F.array(*map(F.lit, LEADS)), lambda x: x <= n), -1)
    longest = F.broadcast(named.agg(F.max(n).alias("_longest")))  # one row
    short = named.crossJoin(longest).where(n < F.col("_longest")).drop("_longest").withColumn("leads", F.array(own))
    asked = F.broadcast(short.agg(F.collect_set(F.col("leads")[0]).alias("leads")))  # LEADS at most
    inner = _anchored(short, file, True).select(file, F.col("id").alias("_s"), F.col("size").alias("_n"), "lead", "key", F.col("place").alias("_o"))
    bits = anchor_filter(short, file)
    outer = _anchored(named.where(F.lit(bits is not None) & (n > 1)).crossJoin(asked), file, False, bits)
    start = F.col("place") - F.col("_o")
    pairs = outer.join(inner, [file, "lead", "key"]).where((F.col("_n") < F.col("size")) & (start >= 0) & (start + F.col("_n") <= F.col("size"))).select(file, "id", "_s").distinct()
    shorts = short.select(file, F.col("id").alias("_s"), F.col("head").alias("_short"))
    found = pairs.join(shorts, [file, "_s"]).join(named.select(file, "id", "head"), [file, "id"]).where((F.length("_short") < n) & F.contains("head", "_short"))
    longer = found.groupBy(file, F.col("_s").alias("id")).agg(F.count("*").alias("n_longer"))
    return named.join(longer, [file, "id"], "left").fillna(0, ["n_longer"]).select(file, "head", "first", "n_rows", "n_longer")
