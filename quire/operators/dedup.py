"""Paragraph and article deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.similarity import SIMILAR, STOP_WORDS, WEIGHTS, Title, score_titles
from quire.functions.text import paragraph_key, strip, title_key


def dedup_paragraphs(df: DataFrame, key: str, text: str, separator: str = "\n\n", min_chars: int = 20, long: int = 2000) -> DataFrame:
    """Drop exact repeats of a paragraph inside one text; shorter ones than ``min_chars`` always stay.

    Most texts are done per row on arrays, without a shuffle: a paragraph stays if its key's first position is its own. That
    takes time with the square of the paragraphs, so texts of over ``long`` paragraphs are exploded and ranked instead.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, F.split(F.col(text), separator).alias("_parts"))
    short = rows.where(F.size("_parts") <= long).withColumn("_keys", F.transform("_parts", paragraph_key))
    kept = F.filter(
        F.arrays_zip(F.col("_parts").alias("part"), F.col("_keys").alias("key"), F.sequence(F.lit(1), F.size("_parts")).alias("i")),
        lambda x: (F.length(x["key"]) < min_chars) | (F.array_position(F.col("_keys"), x["key"]) == x["i"]),
    )
    by_array = short.select(key, kept.alias("_kept")).select(key, F.col("_kept.part").alias("_kept"))
    each = rows.where(F.size("_parts") > long).withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.posexplode("_parts").alias("_i", "_part")).withColumn("_key", paragraph_key(F.col("_part")))
    first = F.row_number().over(Window.partitionBy("_row", "_key").orderBy("_i")) == 1
    parts = F.array_sort(F.collect_list(F.struct("_i", "_part")))
    by_rank = each.withColumn("_first", first).where(F.col("_first") | (F.length("_key") < min_chars)).groupBy(key, "_row").agg(F.transform(parts, lambda p: p["_part"]).alias("_kept"))
    both = by_array.unionByName(by_rank.select(key, "_kept"))
    return both.select(key, F.size("_kept").cast("long").alias("n_kept"), F.array_join("_kept", separator).alias("content"))


def _titled(title: str) -> Column:
    return strip(F.coalesce(F.col(title), F.lit("")))


def similar_titles(titles: DataFrame, file: str, order: str, title: str, threshold: float = SIMILAR, last: str | None = None) -> DataFrame:
    """``file, first, second, score`` of all pairs of different titles of a file that score ``threshold`` or more; first stands before.

    ``titles`` has a row for each title of a file. Such a score needs keywords that overlap by a share that the weights give: 0.28 at
    0.82 for a title with very many stop words beside its keywords, 0.6 for one without. So two such titles have one of their rarest keywords in common: the first ones
    of each, in one order from rare to common, as many as the share leaves (prefix filtering), and the places of the first one in
    common leave room for the overlap. Titles of stop words alone meet by these. Lengths are asked next, then words, and Python works out
    the rest where these leave it open. No pair is left out.

    With ``last``, up to which order the title comes again, there is a ``back`` too: the score, or zero, with the first title as the later one,
    worked out where it is one, and pairs come that reach ``threshold`` either way.
    """
    room = sum(w for k, w in WEIGHTS.items() if k != "keywords")
    share = max(0.0, (threshold - room) / WEIGHTS["keywords"])
    key = title_key(F.col(title))
    words = F.array_distinct(F.filter(F.split(key, " "), lambda x: x != ""))
    keyed = titles.select(file, F.col(order).alias("_o"), F.col(last or order).alias("_last"), key.alias("_t"), F.length(key).alias("_len"), words.alias("_words")).withColumn("_kw", F.array_except("_words", F.array(*map(F.lit, STOP_WORDS))))
    asked = F.when(F.size("_kw") > 0, F.col("_kw")).otherwise(F.array(F.concat(F.lit("= "), F.array_join("_words", " "))))
    n, stop = F.size(asked), F.size("_words") - F.size("_kw")
    # Of n keywords in common with all of s stop words, a share x gives (x n + s) / (n + s) of the words at most.
    own = (threshold - room + WEIGHTS["words"] - WEIGHTS["words"] * stop / (n + stop)) / (WEIGHTS["keywords"] + WEIGHTS["words"] * n / (n + stop))
    each = keyed.where("_len > 0").select(file, "_o", "_len", n.alias("_n"), F.greatest(F.lit(share), own).alias("_x"), F.explode(asked).alias("_k"))
    counts = each.groupBy(file, "_k").count()
    ranked = each.join(counts, [file, "_k"]).groupBy(file, "_o", "_len", "_n", "_x").agg(F.array_sort(F.collect_list(F.struct("count", "_k"))).alias("_r"))
    kept = F.slice("_r", 1, F.greatest(F.col("_n") - F.ceil(F.col("_n") * F.col("_x") - 1e-9).cast("int") + 1, F.lit(1)))
    blocks = ranked.select(file, "_o", "_len", "_n", "_x", F.posexplode(kept).alias("_i", "_b")).select(file, "_o", "_len", "_n", "_x", "_i", F.xxhash64("_b._k").alias("_k"))
    side = lambda o, x: blocks.select(file, "_k", F.col("_o").alias(o), *(F.col(c).alias(f"{c}{x}") for c in ("_len", "_n", "_x", "_i")))
    x = F.greatest("_xa", "_xb")
    sized = (F.col("first") < F.col("second")) & (F.least("_na", "_nb") >= x * F.greatest("_na", "_nb") - 1e-9)
    fits = F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) >= x / (1 + x) * (F.col("_na") + F.col("_nb")) - 1e-9  # places from 0
    short, long = F.least("_lena", "_lenb"), F.greatest("_lena", "_lenb")
    chars = WEIGHTS["contained"] + WEIGHTS["levenshtein"] * short / long + WEIGHTS["sequence"] * 2 * short / (short + long)
    near = chars + WEIGHTS["words"] + WEIGHTS["keywords"] >= threshold - 1e-9
    pairs = side("first", "a").join(side("second", "b"), [file, "_k"]).where(sized & fits & near).select(file, "first", "second").distinct()
    side = lambda o, x: keyed.select(file, F.col("_o").alias(o), *(F.col(c).alias(f"{c}{x}") for c in ("_t", "_len", "_words", "_kw", "_last")))
    both = pairs.join(side("first", "a"), [file, "first"]).join(side("second", "b"), [file, "second"])
    jaccard = lambda c: F.size(F.array_intersect(f"{c}a", f"{c}b")) / F.greatest(F.size(F.array_union(f"{c}a", f"{c}b")), F.lit(1))
    most = WEIGHTS["words"] * jaccard("_words") + WEIGHTS["keywords"] * jaccard("_kw") + chars
    most = F.when(F.size("_kwa") + F.size("_kwb") == 0, 1.0).otherwise(most)  # equal keys score 1 without keywords too

    @F.pandas_udf("score double, back double")
    def score(x: pd.Series, y: pd.Series, again: pd.Series) -> pd.DataFrame:
        titles = [(Title(p), Title(q), r) for p, q, r in zip(x, y, again, strict=True)]
        return pd.DataFrame([(score_titles(q, p, threshold), score_titles(p, q, threshold) if r else 0.0) for p, q, r in titles], columns=["score", "back"], dtype=float)

    left = both.where(most >= threshold - 1e-9).select(file, "first", "second", "_ta", "_tb", (F.col("_lasta") > F.col("second")).alias("_again"))
    # Each pair is there once; grouped, the scores are a shuffle's rows, which all that read them share.
    scored = left.select(file, "first", "second", "_again", score("_ta", "_tb", "_again").alias("_s")).groupBy(file, "first", "second").agg(F.max(F.struct("_s.score", "_s.back", "_again")).alias("_s")).select(file, "first", "second", "_s.*")
    if last:
        return scored.where(F.greatest("score", "back") >= threshold)
    return scored.where(F.col("score") >= threshold).select(file, "first", "second", "score")


def _classes(titles: DataFrame, pairs: DataFrame, file: str) -> DataFrame:
    """``file, at, root, score`` of each title that is not its class's first: the class of the first title before it that opened one.

    Sequential within a file: the titles that have a similar one before them pass in order, as numbers, and what is kept between
    them are the numbers of those that opened no class. All other titles open one.
    """
    near = pairs.groupBy(file, F.col("second").alias("at")).agg(F.array_sort(F.collect_list(F.struct("first", "score"))).alias("near"))
    kind = dict(titles.dtypes)[file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, set()
        for b in batches:
            files, ats, roots, scores = [], [], [], []
            for name, at, before in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if name != now:
                    now, members = name, set()
                opened = next((x for x in before if x["first"] not in members), None)
                if opened:
                    members.add(at)
                    files.append(name)
                    ats.append(at)
                    roots.append(opened["first"])
                    scores.append(opened["score"])
            yield pa.RecordBatch.from_arrays([pa.array(files, b.schema.field(0).type), pa.array(ats, pa.int64()), pa.array(roots, pa.int64()), pa.array(scores, pa.float64())], [file, "at", "root", "score"])

    rows = near.repartition(file).sortWithinPartitions(file, "at").select(file, F.col("at").cast("long"), F.transform("near", lambda x: F.struct(x["first"].cast("long").alias("first"), x["score"].alias("score"))).alias("near"))
    return rows.mapInArrow(run, f"{file} {kind}, at long, root long, score double")


def title_classes(df: DataFrame, file: str, order: str, title: str, threshold: float = SIMILAR) -> DataFrame:
    """``file, title, at, root, score, n_similar`` of each different title of a file, without white space around it.

    ``at`` is the order of its first row and ``root`` that of the title that names its class: of the titles before it that are similar and
    name one, the first, with which it scores ``score``; else itself, with 1. ``n_similar`` other titles of the file are similar.

    Scores hang on keys (title_key()) alone, so titles of one key are scored as one, by the first of them, and counted by their number:
    all of them have the class that the first one has. Only where a pair of keys is similar one way round are titles told apart.
    """
    titles = df.where(_titled(title) != "").groupBy(file, _titled(title).alias("title")).agg(F.min(F.col(order).cast("long")).alias("at")).withColumn("_key", title_key(F.col("title")))
    lone = F.when(F.col("at").isNotNull(), F.col(file).isNull() | (F.col("_key") == "")).otherwise(F.lit(False))  # similar to none; asked of groups, not of rows
    some = titles.where(~lone)
    keys = some.groupBy(file, "_key").agg(F.min("at").alias("_at"), F.max("at").alias("_last"), F.count("*").alias("_size"))
    pairs = similar_titles(keys, file, "_at", "_key", threshold, "_last")
    ahead, back = F.col("score") >= threshold, ~F.col("_again") | (F.col("back") >= threshold)
    sizes = keys.select(file, F.col("_at").alias("_other"), "_size")
    ends = pairs.where(ahead & back).select(file, F.inline(F.array(F.struct(F.col("first").alias("_at"), F.col("second").alias("_other")), F.struct(F.col("second").alias("_at"), F.col("first").alias("_other")))))
    whole = ends.join(sizes, [file, "_other"]).groupBy(file, "_at").agg(F.sum("_size").alias("_near"))
    members = some.join(keys.select(file, "_key", "_at"), [file, "_key"]).select(file, "_at", "at")
    side = lambda first, at: members.select(file, F.col("_at").alias(first), F.col("at").alias(at))
    one_way = pairs.where(ahead != back).join(side("first", "_a"), [file, "first"]).join(side("second", "_b"), [file, "second"]).where(F.when(ahead, F.col("_a") < F.col("_b")).otherwise(F.col("_b") < F.col("_a")))
    counted = one_way.select(file, F.explode(F.array("_a", "_b")).alias("at")).groupBy(file, "at").agg(F.count("*").alias("_more"))
    joining = pairs.where(ahead).select(file, "first", "second", "score")
    classes = _classes(keys, joining, file).withColumnRenamed("at", "_at")
    groups = keys.join(classes, [file, "_at"], "left").join(whole, [file, "_at"], "left").select(file, "_key", F.coalesce("root", "_at").alias("root"), F.coalesce("score", F.lit(1.0)).alias("score"), (F.coalesce("_near", F.lit(0)) + F.col("_size") - 1).alias("_near"))
    found = some.join(groups, [file, "_key"]).join(counted, [file, "at"], "left")
    out = found.select(file, "title", "at", "root", "score", (F.col("_near") + F.coalesce("_more", F.lit(0))).alias("n_similar"))
    return out.unionByName(titles.where(lone).select(file, "title", "at", F.col("at").alias("root"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("n_similar")))


def _untitled(rows: DataFrame, file: str, min_untitled: int) -> DataFrame:
    """``file, at`` of the articles without title that stay: those of enough content whose head is that of no article kept so far.

    ``rows`` (file, at, root or null, length, head) pass in the order of their file; what is kept between them is the head of
    the article that each class has so far, 500 characters.
    """
    kind = dict(rows.dtypes)[file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            files, ats = [], []
            for name, at, root, size, stripped, head in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if name != now:
                    now, held = name, {}
                head = (head or "").lower().strip()
                if root is not None:
                    if root not in held or size > held[root][0]:
                        held[root] = size, head
                elif stripped >= min_untitled and not any(same_head(head, h) for _, h in held.values()):
                    held["untitled", at] = size, head
                    files.append(name)
                    ats.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(files, b.schema.field(0).type), pa.array(ats, pa.int64())], [file, "at"])

    return rows.repartition(file).sortWithinPartitions(file, "at").select(file, "at", "root", "size", "stripped", "head").mapInArrow(run, f"{file} {kind}, at long")


def same_head(a: str, b: str) -> bool:
    """Is one head the other's beginning, or inside it?"""
    n = min(len(a), len(b))
    return n > 0 and (a[:n] == b[:n] or (a in b if len(a) < len(b) else b in a))


def dedup_articles(df: DataFrame, file: str, order: str, title: str, content: str, threshold: float = SIMILAR, min_untitled: int = 200) -> DataFrame:
    """Each file's articles without those that repeat another one; rows keep their columns.

    Of a class of similar titles the row of the longest content stays, the first one on ties. An article without title goes if its
    content begins like that of an article that the rows before it left, or is short. Only titles, numbers and, in files
    with articles without title, heads of contents pass through a file's sequence; articles are picked by a window over their class.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    rows = df.where((_titled(title) != "") | (strip(text) != ""))
    classes = title_classes(rows, file, order, title, threshold).select(F.col(file).alias("_f"), F.col("title").alias("_title"), F.col("root").alias("_root"))
    placed = rows.join(classes, rows[file].eqNullSafe(F.col("_f")) & (_titled(title) == F.col("_title")), "left").select(*rows.columns, "_root")
    best = Window.partitionBy(file, "_root").orderBy(F.length(text).desc(), order)
    titled = placed.where("_root is not null").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(rows.columns)
    blank = rows.where(_titled(title) == "")
    seen = placed.join(blank.select(F.col(file).alias("_f")).distinct(), F.col(file).eqNullSafe(F.col("_f")), "left_semi")
    heads = seen.select(file, F.col(order).cast("long").alias("at"), F.col("_root").alias("root"), F.length(text).alias("size"), F.length(strip(text)).alias("stripped"), F.left(text, F.lit(500)).alias("head"))
    kept = _untitled(heads, file, min_untitled).select(F.col(file).alias("_f"), F.col("at").alias("_at"))
    return titled.unionByName(blank.join(kept, blank[file].eqNullSafe(F.col("_f")) & (F.col(order).cast("long") == F.col("_at")), "left_semi").select(rows.columns))
