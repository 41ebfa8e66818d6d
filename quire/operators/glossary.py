"""Glossaries: reading, and replacing terms in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip

#: Names of a glossary's two columns.
SOURCE_NAMES = ("en", "EN", "English", "english", "source", "source_term")
TARGET_NAMES = ("zh", "ZH", "Chinese", "chinese", "target", "target_term")

URL = re.compile(r"\[[^\]]*\]\([^)\s]+\)|(?:https?|ftp)://[^\s<>\"']+|www\.[^\s<>\"']+|\bdoi:\s*\S+|\b10\.\d{4,}/\S+", re.I)
#: A glossary's terms are collected, up to so many.
MAX_TERMS = 100_000


def read_glossary(df: DataFrame, order: str) -> DataFrame:
    """``source_term, target_term, ord`` from a table with columns named in one of the usual ways; the last of equal terms wins."""
    source = next(c for c in SOURCE_NAMES if c in df.columns)
    target = next(c for c in TARGET_NAMES if c in df.columns)
    pairs = df.select(strip(F.col(source)).alias("source_term"), strip(F.col(target)).alias("target_term"), F.col(order).alias("ord")).where("source_term != '' and target_term != ''")
    return pairs.groupBy("source_term").agg(F.max_by("target_term", "ord").alias("target_term"), F.max("ord").alias("ord"))


def read_glossaries(tables: list[DataFrame], order: str) -> DataFrame:
    """One glossary from several tables, such as the sheets of several files: the first two columns of each, whatever their names.

    The last of equal terms wins, over the tables in order and each table's own ``order``.
    """
    rows = []
    for n, df in enumerate(tables):
        source, target = [c for c in df.columns if c != order][:2]
        rows.append(df.select(strip(F.col(source).cast("string")).alias("source_term"), strip(F.col(target).cast("string")).alias("target_term"), F.struct(F.lit(n).alias("t"), F.col(order).cast("long").alias("o")).alias("ord")))
    every = reduce(lambda a, b: a.unionByName(b), rows).where("source_term != '' and target_term != ''")
    last = every.groupBy("source_term").agg(F.max_by("target_term", "ord").alias("target_term"), F.max("ord").alias("_o"))
    return last.select("source_term", "target_term", (F.col("_o.t").cast("long") * (1 << 40) + F.col("_o.o")).alias("ord"))


def folded(text: str) -> str:
    """A text in which whatever equals a term whatever its case is equal to the term folded likewise."""
    return text.casefold().replace("i\u0307", "i").replace("ı", "i")


class Terms:
    """A glossary's terms in the order in which they are replaced, and an automaton that finds which ones a text has."""

    def __init__(self, terms: list[tuple[str, str]], whole_word: bool, ignore_case: bool):
        import ahocorasick

        self.terms, self.flags = terms, re.I * ignore_case
        self.fold = folded if ignore_case else str
        self.form = r"\b{}\b" if whole_word else "{}"
        self.automaton = ahocorasick.Automaton()
        for k, (source, _) in enumerate(terms):
            found = self.automaton.get(self.fold(source), [])
            self.automaton.add_word(self.fold(source), [*found, k])
        if terms:
            self.automaton.make_automaton()

    def after(self, text: str, k: int) -> list[int]:
        """Terms from the k-th on that the text may hold, in order."""
        return sorted({n for _, ns in self.automaton.iter(self.fold(text)) for n in ns if n >= k}) if self.terms else []

    def found(self, text: str) -> int:
        """Places of each term, taken on its own, outside the urls of a text; those of different terms may overlap."""
        bare = URL.sub("\x00", text)
        return sum(sum(1 for _ in re.finditer(self.form.format(re.escape(self.terms[k][0])), bare, self.flags)) for k in self.after(bare, 0))

    def replace(self, text: str) -> tuple[str, int]:
        """A text with terms replaced one after the other, and how many; urls stay as they are.

        Only terms that occur are tried; what a replacement brings in is looked through for the terms that follow it.
        """
        urls: list[str] = []

        def hide(m):
            urls.append(m[0])
            return f"\x00{len(urls) - 1}\x00"

        text, hits = URL.sub(hide, text), 0
        todo = self.after(text, 0)
        while todo:
            k = todo.pop(0)
            source, target = self.terms[k]
            text, n = re.subn(self.form.format(re.escape(source)), lambda _, t=target: t, text, flags=self.flags)
            hits += n
            if n:
                todo = self.after(text, k + 1)
        return re.sub(r"\x00(\d+)\x00", lambda m: urls[int(m[1])], text), hits


def replace_terms(text: str, terms: list[tuple[str, str]], whole_word: bool, ignore_case: bool) -> tuple[str, int]:
    """Terms.replace() of one text; ``terms`` come longest first."""
    return Terms(terms, whole_word, ignore_case).replace(text)


def apply_glossary(df: DataFrame, column: str, glossary: DataFrame, whole_word: bool = False, ignore_case: bool = True) -> DataFrame:
    """``df`` with the column's terms replaced, their number in ``hits``, and in ``found`` the places of terms before any is replaced,
    of which one that shares characters with another may be gone when its turn comes; at most MAX_TERMS terms."""
    rows = glossary.select("source_term", "target_term", "ord").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a glossary of over {MAX_TERMS} terms")
    terms = [(r.source_term, r.target_term) for r in sorted(rows, key=lambda r: (-len(r.source_term), r.ord))]

    @F.pandas_udf("text string, hits int, found int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Terms(terms, whole_word, ignore_case)
        for texts in parts:
            yield pd.DataFrame([(*known.replace(t), known.found(t)) if t is not None else (None, 0, 0) for t in texts], columns=["text", "hits", "found"]).astype({"hits": "int32", "found": "int32"})

    done = df.withColumn("_done", run(F.col(column)))
    return done.withColumn(column, F.col("_done.text")).withColumns({"hits": F.col("_done.hits"), "found": F.col("_done.found")}).drop("_done")
