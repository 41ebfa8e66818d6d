"""Similarity of titles. Only the sequence part needs Python; the rest are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import comparable, title_key

#: Words that are no keywords, and the parts' weights.
STOP_WORDS = tuple("a an the in on at to for of with by from as is are was were be been if do we have s not like they re us it".split())
WEIGHTS = {"levenshtein": 0.25, "words": 0.20, "sequence": 0.25, "contained": 0.05, "keywords": 0.25}
SIMILAR = 0.82


def _words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda x: x != ""))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def word_jaccard(a: Column, b: Column) -> Column:
    return _jaccard(_words(a), _words(b))


def keyword_jaccard(a: Column, b: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return _jaccard(F.array_except(_words(a), stop), F.array_except(_words(b), stop))


def containment(a: Column, b: Column) -> Column:
    """Length ratio where the shorter lies in the longer, else zero; equal lengths count as one."""
    la, lb = F.length(a), F.length(b)
    return (
        F.when(la == lb, 1.0)
        .when((la < lb) & F.contains(b, a), la / F.greatest(lb, F.lit(1)))
        .when((lb < la) & F.contains(a, b), lb / F.greatest(la, F.lit(1)))
        .otherwise(0.0)
    )


def levenshtein_share(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - _edits(a, b) / longest)


def _edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of long texts, which takes less time than the built-in function's table."""

    @F.pandas_udf("int")
    def edits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="Int32")

    return edits(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks; it is not symmetric."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([matching_ratio(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def hybrid(first: Column, second: Column) -> Column:
    """The weighted similarity of two titles: 0 where one has no words, 1 where their keys are equal."""
    return hybrid_of_keys(title_key(first), title_key(second))


def hybrid_of_keys(a: Column, b: Column) -> Column:
    """hybrid() of two titles' keys; as columns they are worked out once, not for each part."""
    parts = {"levenshtein": levenshtein_share(a, b), "words": word_jaccard(a, b), "sequence": sequence_ratio(a, b), "contained": containment(a, b), "keywords": keyword_jaccard(a, b)}
    score = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(score)


def is_similar(first: Column, second: Column, threshold: float = SIMILAR) -> Column:
    """Do two titles score ``threshold`` or more? Costly parts run only where they can decide."""
    blank = (F.coalesce(first, F.lit("")) == "") | (F.coalesce(second, F.lit("")) == "")

    @F.pandas_udf("boolean")
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and score_titles(Title(p), Title(q), threshold) >= threshold for p, q in zip(x, y, strict=True)], dtype=bool)

    return ~blank & ((F.trim(first) == F.trim(second)) | reaches(first, second))


def matching_ratio(a: str, b: str, cells: int = 1 << 20) -> float:
    """Twice the characters in matching blocks over all characters: difflib's ratio, for texts of some hundred characters.

    The lengths of equal runs that end at each pair of places are worked out once, a row or column at a time; the longest run inside
    a pair of stretches is then the largest entry of that part of the table, cut to the part. Longer texts, and those of which
    difflib leaves out frequent characters, go to difflib.
    """
    if a == b or not a or not b:
        return 1.0 if a == b else 0.0
    if len(b) >= 200 or len(a) * len(b) > cells:
        return SequenceMatcher(None, a, b).ratio()
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    runs = (short[:, None] == long[None, :]).astype(np.int32)
    for i in range(1, len(short)):
        runs[i, 1:] *= runs[i - 1, :-1] + 1
    if short is y:
        runs = np.ascontiguousarray(runs.T)
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        part = runs[i0:i1, j0:j1]
        if i0 or j0:  # runs that began before the part
            part = np.minimum(part, np.minimum(np.arange(1, i1 - i0 + 1, dtype=np.int32)[:, None], np.arange(1, j1 - j0 + 1, dtype=np.int32)[None, :]))
        at = int(part.argmax())  # the first one in order
        i, j = divmod(at, j1 - j0)
        n = int(part[i, j])
        if not n:
            continue
        total += n
        i, j = i0 + i + 1, j0 + j + 1  # past the run's end
        if i0 < i - n and j0 < j - n:
            todo.append((i0, i - n, j0, j - n))
        if i < i1 and j < j1:
            todo.append((i, i1, j, j1))
    return 2.0 * total / (len(a) + len(b))


def best_window(sample: str, content: str) -> float:
    """The best share of equal characters over all windows of the sample's length."""
    n = len(sample)
    if not n or len(content) < n:
        return 0.0
    if sample in content:
        return 1.0
    x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (sample, content))
    windows = np.lib.stride_tricks.sliding_window_view(y, n)
    step = max(1, (1 << 22) // n)
    return max(float((windows[k : k + step] == x).mean(axis=1).max()) for k in range(0, len(windows), step))


def fuzzy_contains(sample: Column, content: Column, threshold: float = 0.9) -> Column:
    """Does the content hold the sample, up to a share of other characters, after normalising both?"""

    @F.pandas_udf("boolean")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([bool(p) and bool(q) and best_window(p, q) >= threshold for p, q in zip(x, y, strict=True)], dtype=bool)

    return found(comparable(sample), comparable(content))


class Title:
    """A title's key, words and keywords, for scoring it against many others."""

    def __init__(self, text: str):
        self.key = " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())
        self.words = set(self.key.split())
        self.keywords = self.words.difference(STOP_WORDS)


def score_titles(x: Title, y: Title, least: float = 0.0) -> float:
    """hybrid() of two titles. Where the parts that cost little already keep it below ``least``, zero: the share of matching
    blocks, and then the edit distance, are worked out only where they can decide."""
    a, b = x.key, y.key
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    both, either = len(x.words & y.words), len(x.words | y.words)
    keys = len(x.keywords | y.keywords)
    got = WEIGHTS["words"] * both / either + WEIGHTS["keywords"] * (len(x.keywords & y.keywords) / keys if keys else 0.0)
    open_weight = WEIGHTS["levenshtein"] * short / long + WEIGHTS["sequence"] * 2 * short / (short + long)
    if got + WEIGHTS["contained"] + open_weight < least - 1e-9:
        return 0.0
    inside = (a in b) if len(a) < len(b) else (b in a)
    got += WEIGHTS["contained"] * (short / long if inside or short == long else 0.0)
    if got + open_weight < least - 1e-9:
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    if got + WEIGHTS["levenshtein"] * short / long + WEIGHTS["sequence"] * matcher.quick_ratio() < least - 1e-9:
        return 0.0
    got += WEIGHTS["levenshtein"] * (1 - edit_distance(a, b) / long)
    if got + WEIGHTS["sequence"] * matcher.quick_ratio() < least - 1e-9:
        return 0.0
    return got + WEIGHTS["sequence"] * matching_ratio(a, b)


def score_text(first: str, second: str) -> float:
    """hybrid() for two texts, for folds that run per file."""
    return score_titles(Title(first), Title(second))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time: its steps up and down are the bits of two numbers (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places, bit = dict.fromkeys(b, 0), 1
    for c in a:
        if c in places:
            places[c] |= bit
        bit <<= 1
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = places[c]
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more = (more << 1) | 1
        eq |= down
        up, down = ((less << 1) | ~(eq | more)) & full, more & eq & full
    return distance
