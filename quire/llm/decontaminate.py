"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask says which of the tokens from a position on are hashed; the others may differ. Every position of a document and of
a benchmark item gives a hash by each mask, and equal hashes of one mask are a hit. Along a run of hits on one diagonal
(document position less item position) only the first counts. Around it the item is laid over the document and tokens
are compared one to one: the document holds the item if in some ``window`` item tokens on end (all of a shorter item)
the share of equal ones is ``min_share`` or more. So substituted words are tolerated.

Every overlap that the comparison accepts at the default window and share has a hit: items of 11 tokens or more have three
masks of weight five at all positions, which leave out any two of 11 tokens somewhere; an item of 10 tokens or fewer has
masks of its own length, at its first token alone, that leave out any token that may differ (none of up to four). Only
masks that some item calls for are hashed.

The document side is one scan: tokens are exploded, hashed and probed in it, and only hits leave it. The benchmark's seeds
are broadcast if a count of what they carry proves them small, ``broadcast_tokens`` at most; beyond it hashes alone are
shuffled to the seeds (a join of two plain shuffles, whose hot seeds adaptive execution splits), and documents that hit are
read again.

Tokens are runs of letters and digits, lower-cased. Cases: null texts and items without tokens match nothing; an item of one
token is held by every document with that token; repeated documents and items match as often as they stand there, a row
for each (document, item); null ids are kept; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token positions that each mask of the longer items keeps. Fixed masks of weight five; any two share few offsets.
MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 5, 7), (0, 2, 3, 6, 7))
#: The most tokens of an item that has masks of its own.
SHORT = 10


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``size`` tokens, SHORT at most: its tokens in groups, and each mask leaves out as many whole
    groups as tokens may differ, so that some mask leaves out whichever do."""
    free = size - -(-size * 4 // 5)
    if not free:
        return [tuple(range(size))]
    n = free + 2
    edges = [size * k // n for k in range(n + 1)]
    groups = [range(a, z) for a, z in zip(edges, edges[1:], strict=False)]
    return [tuple(i for k, g in enumerate(groups) if k not in out for i in g) for out in combinations(range(n), free)]


def masks_for(sizes) -> list[tuple[int, tuple[int, ...], int]]:
    """(number, kept positions, item size or 0) of the masks that items of these sizes call for."""
    out = [(k, kept, 0) for k, kept in enumerate(MASKS) if any(n > SHORT for n in sizes)]
    for n in sorted({n for n in sizes if 0 < n <= SHORT}):
        out += [(100 * n + k, kept, n) for k, kept in enumerate(short_masks(n))]
    return out


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def split_tokens(text: Column) -> Column:
    """As tokens(), without a lambda, which would stop code generation; an empty string may stand at either end."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def seed(mask: tuple[int, tuple[int, ...], int], words: Column, at: Column, size: Column) -> Column:
    """The hash of the tokens that a mask keeps from ``at`` on; null where it does not fit."""
    number, kept, _ = mask
    return F.when((at >= 0) & (at + kept[-1] < size), F.xxhash64(F.lit(number), *(F.get(words, at + k) for k in kept)))


def seeds(items: DataFrame, masks: list) -> DataFrame:
    """``h, before, mask, item_pos, item_id, item`` for each mask and position of the items; ``before`` is the seed one to the left."""
    n, at, words = F.size("item"), F.col("item_pos"), F.col("item")
    each = []
    for mask in masks:
        number, _, own = mask
        fits = (n == own) & (at == 0) if own else n > SHORT
        each.append(F.struct(F.when(fits, seed(mask, words, at, n)).alias("h"), (F.lit(None).cast("long") if own else seed(mask, words, at - 1, n)).alias("before"), F.lit(number).alias("mask")))
    rows = items.select("item_id", "item", F.posexplode("item").alias("item_pos", "_"))
    return rows.select("item_id", "item", "item_pos", F.explode(F.array(*each)).alias("s")).select("s.*", "item_pos", "item_id", "item").where("h is not null")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, min_share: float = 0.8, broadcast_tokens: int = 4_000_000) -> DataFrame:
    """A row per document and item that it holds: ``doc_id, mark, item_id, n_tokens, n_equal, token_start``.

    ``mark`` hashes the text; ``n_equal`` of the item's ``n_tokens`` tokens are equal where it fits best, from the document's token
    ``token_start`` on (below zero where the item begins before the document).
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text)).alias("item"))
    items = items.where(F.size("item") > 0)
    sizes = [r.n for r in items.select(F.least(F.size("item"), F.lit(SHORT + 1)).alias("n")).distinct().collect()]  # at most SHORT + 1
    masks = masks_for(sizes or [SHORT + 1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), split_tokens(F.col(text_col)).alias("words"))
    key = ["doc_id", "mark", "item_id", "shift"]
    n, pos, shift, size = F.size("words"), F.col("pos"), F.col("shift"), F.size("item")
    # An empty text may stand before the first token; it is no token of the document's.
    blank = (F.get(F.col("words"), F.lit(0)) == "").cast("int")
    part = [(shift - blank).alias("token_start"), F.greatest(F.lit(0), -shift).alias("low"), F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(n, shift + size) - F.greatest(shift, F.lit(0)))).alias("part"), "item"]
    at_each = rows.select("doc_id", "mark", "words", F.posexplode_outer("words").alias("pos", "_")).select(
        "doc_id", "mark", "words", "pos", F.explode(F.array(*(seed(m, F.col("words"), pos, n) for m in masks))).alias("h")
    )
    weight = items.agg(F.coalesce(F.sum(F.size("item") * F.size("item")), F.lit(0))).first()[0]  # a seed carries its item
    if weight * len(masks) <= broadcast_tokens:
        # One stage of generated code: of a document's exploded rows only those that hit, cut to the item, leave it.
        found = at_each.join(F.broadcast(seeds(items, masks)), "h")
        prior = F.coalesce(F.lit(None).cast("long"), *(F.when(F.col("mask") == m[0], seed(m, F.col("words"), pos - 1, n)) for m in masks if not m[2]))
        first = found.where(~F.coalesce(prior == F.col("before"), F.lit(False)))
        laid = first.select("doc_id", "mark", "item_id", (pos - F.col("item_pos")).alias("shift"), "words", "item").select(*key, *part)
    else:
        found = at_each.select("doc_id", "mark", "pos", "h").join(seeds(items, masks).select("h", "item_pos", "item_id"), "h")
        hits = found.select("doc_id", "mark", "item_id", (pos - F.col("item_pos")).alias("shift")).distinct()
        with_words = hits.join(rows, hits.doc_id.eqNullSafe(rows.doc_id) & (hits.mark == rows.mark)).select(hits["*"], "words")
        laid = with_words.join(items, with_words.item_id.eqNullSafe(items.item_id)).select(with_words["*"], "item").select(*key, *part)
    once = laid.groupBy(key).agg(*(F.any_value(c).alias(c) for c in ("token_start", "low", "part", "item")))
    width = F.least(F.lit(window), size)
    equal = F.transform("part", lambda x, i: F.coalesce(x == F.get(F.col("item"), F.col("low") + i), F.lit(False)).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e)
    judged = once.where(F.size("part") >= width).select("doc_id", "mark", "item_id", "token_start", size.alias("n_tokens"), width.alias("width"), equal.alias("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda k: total(F.slice(F.col("equal"), k, F.col("width")))))
    held = judged.where(best >= F.ceil(F.col("width") * min_share)).select("doc_id", "mark", "item_id", "n_tokens", "token_start", total(F.col("equal")).alias("n_equal"))
    top = held.groupBy("doc_id", "mark", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.max(F.struct("n_equal", (-F.col("token_start")).alias("left"))).alias("t"))
    longs = {"n_tokens": F.col("n_tokens"), "n_equal": F.col("t.n_equal"), "token_start": -F.col("t.left")}
    return top.select("doc_id", "mark", "item_id", *(c.cast("long").alias(k) for k, c in longs.items()))


def clean(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = matches(docs, benchmark, **kwargs).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad._id) & (F.xxhash64(docs.text) == bad._mark), "left_anti")
