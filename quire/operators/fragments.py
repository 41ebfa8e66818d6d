"""Fragments of articles that were read in overlapping page batches, put together again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.similarity import best_window
from quire.functions.text import comparable

def dedup_text(content: str, min_chars: int = 20) -> str:
    """A text without repeated paragraphs; of two that begin alike a much longer one takes the place of the other."""
    kept: list[str] = []
    keys: dict[str, int] = {}
    heads: dict[str, dict[str, None]] = {}  # keys by their beginning, in the order in which they came
    for part in re.split(r"\n\s*\n", content):
        part = part.strip()
        if not part:
            continue
        key = re.sub(r"\s+", " ", re.sub("…", "...", re.sub("[–—-]", "-", part.lower()))).strip()
        if len(key) < min_chars:
            kept.append(part)
            continue
        if key in keys:
            continue
        near = heads.setdefault(key[:min_chars], {})
        like = next((k for k in near if len(k) > 50 and k[: min(100, len(k), len(key))] == key[: min(100, len(k), len(key))]), None)
        if like is None:
            keys[key] = len(kept)
            near[key] = None
            kept.append(part)
        elif len(key) > 1.5 * len(like):
            keys[key] = at = keys.pop(like)
            del near[like]
            near[key] = None
            kept[at] = part
    return "\n\n".join(kept)


def _ascii(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]+", "", text.lower())).strip()


def fold_contents(contents: list[str]) -> str:
    """The contents of one article's fragments in order, as one text.

    A fragment that is much longer and holds its forerunner's beginning takes its place; else what it shares with the
    forerunner's end (150 down to 21 characters) is cut off; then repeated paragraphs go.
    """
    parts: list[str] = []
    for content in (c.strip() for c in contents):
        if not content:
            continue
        before = parts[-1] if parts else ""
        if before and len(content) > 1.5 * len(before) and best_window(_ascii(before[:300]), _ascii(content)) >= 0.85:
            parts[-1] = content
            continue
        shared = next((n for n in range(min(150, len(before), len(content)), 20, -1) if before.endswith(content[:n])), 0) if before else 0
        rest = content[shared:].strip() if shared else content
        if rest:
            parts.append(rest)
    return dedup_text("\n\n".join(parts))


def title_groups(fragments: DataFrame, file: str, key: str, order: list[str]) -> DataFrame:
    """``file, key, group_no``: the group of each title key that is not empty, by a file's keys in order: the first one that was opened
    by a key that equals it, holds it or lies in it; else it opens one.

    A key's group is settled by its first fragment, so keys alone pass the rule, one row each, in the order of a file; what a
    task keeps between them are the keys that opened a group of that file.
    """
    first = fragments.where(F.col(key) != "").groupBy(file, key).agg(F.min(F.struct(*order)).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, []
        for b in batches:
            out = []
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != now:
                    now, opened = name, []
                at = next((i for i, o in enumerate(opened) if o in k or k in o), None)
                if at is None:
                    at = len(opened)
                    opened.append(k)
                out.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [file, key, "group_no"])

    rows = first.repartition(file).sortWithinPartitions(file, "_at").select(F.col(file).cast("string"), key)
    return rows.mapInArrow(run, f"{file} string, {key} string, group_no int")


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Articles of each file from its fragments (file_id, batch_idx, frag_seq, title, subtitle, authors, content, not_in_toc, pages).

    Fragments without title are articles of their own, and a fragment that is alone in its group keeps its content as it is; the
    contents of others are folded. An article is outside the table of contents if any fragment is. Its images (an array
    of names, if that column is there) are those of its fragments one after the other. No task holds more than an article.
    """
    if "images" not in fragments.columns:
        fragments = fragments.withColumn("images", F.lit(None).cast("array<string>"))
    keyed = fragments.withColumn("_key", F.coalesce(comparable(F.col("title")), F.lit(""))).withColumn("file_id", F.col("file_id").cast("string"))
    groups = title_groups(keyed, "file_id", "_key", ["batch_idx", "frag_seq"]).select(F.col("file_id").alias("_f"), F.col("_key").alias("_k"), "group_no")
    own = F.when(F.col("_key") == "", F.struct("batch_idx", "frag_seq"))  # of an article without title
    placed = keyed.join(groups, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("_key") == F.col("_k")), "left").withColumn("_own", own)
    order = F.struct("batch_idx", "frag_seq")
    text = lambda c: F.min_by(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", order)).alias(c)
    page = lambda c: F.when(F.col(c) != 0, F.col(c))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("batch_idx", "frag_seq", c.alias("v")))), lambda x: x["v"])
    by = placed.groupBy("file_id", "group_no", "_own").agg(
        F.max_by(F.coalesce("title", F.lit("")), F.struct(F.length(F.coalesce("title", F.lit(""))).alias("n"), (-F.col("batch_idx")).alias("b"), (-F.col("frag_seq")).alias("s"))).alias("title"),
        text("subtitle"),
        text("authors"),
        in_order(F.coalesce("content", F.lit(""))).alias("_parts"),
        F.bool_or(F.coalesce("not_in_toc", F.lit(False))).alias("not_in_toc"),
        F.min(page("start_page")).cast("int").alias("start_page"),
        F.max(page("end_page")).cast("int").alias("end_page"),
        F.flatten(in_order(F.coalesce("images", F.array().cast("array<string>")))).alias("images"),
        F.count("*").cast("int").alias("n_fragments"),
    )

    @F.pandas_udf("string")
    def fold(parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else fold_contents(list(p)) for p in parts], dtype=object)

    several = F.col("n_fragments") > 1
    folded = by.withColumn("_folded", fold(F.when(several, F.col("_parts"))))
    return folded.select("file_id", "title", "subtitle", "authors", F.coalesce("_folded", F.get("_parts", F.lit(0))).alias("content"), "not_in_toc", "start_page", "end_page", "images", "n_fragments")


def join_batches(batches: list[DataFrame], keys: list[str], batch: str, order: str, value: str) -> DataFrame:
    """Rows of all batches whose ``value`` is there, with ``number``: their place in the order of (batch, order)."""
    rows = reduce(lambda a, b: a.unionByName(b), batches).where(F.col(value).isNotNull())
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(keys).orderBy(batch, order)))


def totals(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``n_fragments, n_chars, mean_chars`` of what was extracted."""
    n = F.length(F.col(content))
    return df.groupBy(keys).agg(F.count("*").alias("n_fragments"), F.sum(n).alias("n_chars"), F.round(F.avg(n), 4).alias("mean_chars"))
