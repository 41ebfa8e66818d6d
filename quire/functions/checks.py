"""Checks of what models and caches give back, as columns that name what is wrong, or null."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import LEAKS, TRUNCATED, contains_any, is_error_answer, is_html, strip, translation_kind

#: How models announce a translation instead of giving it.
ANNOUNCEMENTS = ("I will translate", "Here is the translation", "Translation:", "The translated text is", "I'll help you translate")
#: Fixed value: labels that models put before a translation.
LABELS = r"(?i)^(?:译文|翻译|【译文】|【翻译】|\[译文\]|\[翻译\]|Translation|以下是翻译|翻译如下|翻译结果)[：:\s]+"
#: What an outline may say.
LANGUAGES = ("English", "Russian", "Chinese")
JOURNAL_TYPES = ("multi-article-magazine", "single-research-paper", "mixed", "unknown", "long-document-with-chapters")
SUMMARY_ERRORS = ("Outline extraction failed", "No context summary available")
OUTLINE_FIELDS = ("journal_name", "issue_number", "language", "journal_type", "content_summary")


def strip_label(c: Column, quotes: Sequence[tuple[str, str]] = (('"', '"'), ("「", "」"), ("『", "』"), ("《", "》"))) -> Column:
    """Without one label before it, and without the first kind of quotes that stand around it."""
    bare = F.regexp_replace(strip(c), LABELS, "")
    around = [F.when(F.startswith(bare, F.lit(a)) & F.endswith(bare, F.lit(b)), F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))) for a, b in quotes]
    return strip(F.coalesce(*around, bare))


def alike(a: str | None, b: str | None, limit: float) -> bool:
    """Is the matching-blocks ratio above ``limit``? Its cheap upper bounds are asked first."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > limit and m.quick_ratio() > limit and m.ratio() > limit


def is_alike(a: Column, b: Column, limit: Column) -> Column:
    """alike() of two columns; null is never alike."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([alike(*v) for v in zip(x, y, n, strict=True)], dtype=bool)

    return run(a, b, limit)


def repeats(c: Column, sizes: Sequence[int] = (20, 30, 50), times: int = 3, first: int = 200) -> Column:
    """Does one of the parts that begin in the first ``first`` characters stand in the text ``times`` times or more?

    Where a longer part does, its beginning of the least size does, so that only this size is looked for. Each such part holds one of the blocks
    of half its size that begin at fixed steps, which then stand there as often: texts without such a block have no part.
    """
    n, size = F.length(c), min(sizes)
    block = max(1, size // 2)
    step = size - block + 1
    often = lambda i, k: (n - F.length(F.replace(c, F.substring(c, i + 1, F.lit(k)), F.lit("")))) >= times * k
    last = F.least(F.lit(first), n - size) - 1
    blocks = F.exists(F.sequence(F.lit(0), F.lit(first + size - block), F.lit(step)), lambda i: often(i, block))
    parts = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: often(i, size))
    return (n > 100) & F.when((last >= 0) & blocks, parts).otherwise(F.lit(False))


def translation_fault(original: Column, translated: Column) -> Column:
    """What is wrong with a translation, in this order: empty, leak, untranslated, too_long, repetition, meta; else null."""
    kind = translation_kind(original)
    exempt = kind["is_url_only"] | kind["is_contact"] | kind["is_copyright"] | kind["is_target_language"]
    rigid = kind["is_html_table"] | kind["is_structured"]
    bare = lambda c: F.regexp_replace(c, "[ \n]", "")
    compared = F.when(~exempt & (F.length(bare(original)) > 50), bare(original))
    same = is_alike(compared, bare(translated), F.when(rigid, 0.98).otherwise(0.9))
    head = F.lower(F.left(translated, F.lit(50)))
    return (
        F.when(strip(F.coalesce(translated, F.lit(""))) == "", "empty")
        .when(contains_any(translated, LEAKS), "leak")
        .when(same, "untranslated")
        .when(F.length(translated) > F.length(original) * F.when(F.length(original) < 20, 10).otherwise(5), "too_long")
        .when(~rigid & repeats(translated), "repetition")
        .when(contains_any(head, [a.lower() for a in ANNOUNCEMENTS]), "meta")
    )


def retry_reason(content: Column, kind: str = "general") -> Column:
    """Why an answer must be asked for again: error, empty, incomplete, and for html or json invalid; else null."""
    blank = strip(F.coalesce(content, F.lit(""))) == ""
    out = F.when(~blank & is_error_answer(content), "error").when(blank, "empty").when(content.rlike(f"(?i){TRUNCATED}"), "incomplete")
    if kind == "html":
        return out.when(~is_html(content), "invalid")
    if kind == "json":
        return out.when(~F.coalesce(F.json_array_length(content) > 0, F.lit(False)), "invalid")
    return out


def outline_fault(outline: Column) -> Column:
    """Why an outline (a struct of OUTLINE_FIELDS) is invalid; null fields are missing ones."""
    absent = F.array_compact(F.array(*(F.when(outline[f].isNull(), F.lit(f)) for f in OUTLINE_FIELDS)))
    return (
        F.when(outline.isNull(), "no outline")
        .when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ", ")))
        .when(strip(outline["journal_name"]) == "", "name is blank")
        .when(contains_any(outline["content_summary"], SUMMARY_ERRORS), "summary is an error")
        .when(~outline["language"].isin(*LANGUAGES), "language")
        .when(~outline["journal_type"].isin(*JOURNAL_TYPES), "type")
        .when(outline["journal_type"] == "unknown", "type is unknown")
    )


def caption_text(c: Column) -> Column:
    """A caption that is a json array of strings or a plain string, as one string."""
    parts = F.from_json(c, "array<string>")
    return F.when(F.startswith(c, F.lit("[")) & parts.isNotNull(), F.array_join(parts, " ")).otherwise(c)


def in_language(df: DataFrame, columns: Sequence[str], suffix: str, required: Sequence[str] = ()) -> DataFrame:
    """Each column's translation (its name and ``suffix``) where it is not empty, else the original; a required one must be there."""
    for c in required:
        if c + suffix not in df.columns:
            raise ValueError(f"no column {c}{suffix}")

    def pick(c: str) -> Column:
        translated = F.nullif(F.col(c + suffix), F.lit(""))
        if c in required:
            return F.coalesce(translated, F.raise_error(F.lit(f"{c}{suffix} is empty")).cast("string"))
        return F.coalesce(translated, F.col(c), F.lit("")) if c + suffix in df.columns else F.coalesce(F.col(c), F.lit(""))

    return df.withColumns({c: pick(c) for c in columns})


def color_richness(pixels: Column, side: int = 50) -> Column:
    """Different colours of a thumbnail's RGB bytes, over its pixels; a half where there are none."""
    n = F.floor(F.length(pixels) / 3).cast("int")
    colours = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.hex(F.substring(pixels, i * 3 + 1, F.lit(3)))))  # strings are hashed, bytes would be compared in pairs
    return F.when(n > 0, F.size(colours) / float(side * side)).otherwise(0.5)


def extraction_strategy(expected: Column, found: Column, last_length: Column, share: float = 0.9, least: int = 100) -> Column:
    """How a text document's articles are to be read, after its whole was: whole, by_contents or by_segments.

    The whole stands if it gave ``share`` of the articles that the contents list, or, without a list, if its last one is
    longer than ``least``.
    """
    listed = F.coalesce(expected, F.lit(0)) > 0
    enough = F.when(listed, found >= expected * share).otherwise((found > 0) & (F.coalesce(last_length, F.lit(0)) > least))
    return F.when(enough, "whole").when(listed, "by_contents").otherwise("by_segments")


def cover_choice(confidence: Column, chosen: Column, largest: Column) -> dict[str, Column]:
    """A model's cover: taken when it is sure (0.6) or fairly sure (0.2), else the largest image."""
    sure = F.coalesce(confidence, F.lit(0.0))
    how = F.when(chosen.isNull() | (sure < 0.2), "largest").when(sure >= 0.6, "sure").otherwise("fair")
    return {"how": how, "cover": F.when(how == "largest", largest).otherwise(chosen)}


def batch_decision(articles: Column, with_images: Column, notes_read: Column, described: Column, placed: Column, filled: Column) -> Column:
    """What to do with a batch's cached articles: reuse, annotate (its images alone) or extract.

    ``articles`` counts them, ``with_images`` those that have an image list and ``filled`` those whose list is not empty;
    ``notes_read`` says how the images' table was read (null: it is not there); ``described`` and ``placed`` count the
    images that a model described and that rules placed.
    """
    done = (described > 0) | (placed > 0)
    return (
        F.when((F.coalesce(articles, F.lit(0)) == 0) | (with_images == 0), "extract")
        .when(notes_read.isNull(), "annotate")
        .when(~notes_read, "extract")
        .when(done & ((filled > 0) | (described > 0)), "reuse")
        .otherwise("annotate")
    )


#: Settings that are checked, with kind, least and greatest value, and how grave a fault is.
SETTINGS = (
    *((name, "key", None, None, "error") for name in ("PDF_API_KEY", "TRANSLATION_API_KEY", "HTML_API_KEY")),
    *((name, "int", 1, None, "error") for name in ("MAX_WORKERS", "TRANSLATION_MAX_WORKERS", "MAX_CONCURRENT_PDF_FILES", "PDF_MAX_TOKENS", "TRANSLATION_MAX_TOKENS", "DOCX_MAX_TOKENS", "OUTLINE_PAGES_PER_SEGMENT", "PAGES_PER_BATCH")),
    ("MAX_RETRIES", "int", 0, None, "error"),
    ("TRANSLATION_CONTENT_MAX_CHARS", "int", 100, None, "error"),
    ("PAGES_PER_BATCH", "most", None, 50, "warning"),
    *((name, "pair", 0, None, "error") for name in ("PDF_API_TIMEOUT", "TRANSLATION_TIMEOUT", "HTML_TIMEOUT")),
    *((name, "real", 0, 2, "warning") for name in ("PDF_TEMPERATURE", "TRANSLATION_TEMPERATURE", "HTML_TEMPERATURE")),
    *((name, "real", 0, 1, "error") for name in ("TITLE_SIMILARITY_THRESHOLD", "CONTENT_DUPLICATE_THRESHOLD")),
)
PLACEHOLDER = "your-api-key-here"


def setting_faults(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, severity, name`` for every setting (name, value as text) of a configuration that breaks a rule.

    Keys must be there and be filled in; other settings are checked where they are there. Pairs are ``a,b`` of numbers above
    zero; pages that overlap must be fewer than a batch has.
    """
    spark = settings.sparkSession
    rules = F.broadcast(spark.createDataFrame([(n, k, None if a is None else float(a), None if z is None else float(z), s) for n, k, a, z, s in SETTINGS], "name string, kind string, low double, high double, severity string"))
    number = F.expr("try_cast(value AS double)")
    whole = F.col("value").rlike(r"^\s*[+-]?\d+\s*$")
    outside = (number < F.coalesce("low", F.lit(float("-inf")))) | (number > F.coalesce("high", F.lit(float("inf"))))
    pair = F.split("value", ",")
    sides = F.transform(pair, lambda x: F.coalesce(x.try_cast("double") > 0, F.lit(False)))
    bad = (
        F.when(F.col("kind") == "int", ~whole | outside)
        .when(F.col("kind") == "real", number.isNull() | outside)
        .when(F.col("kind") == "most", F.coalesce(outside, F.lit(False)))
        .when(F.col("kind") == "pair", (F.size(pair) != 2) | ~F.forall(sides, lambda x: x))
    )
    checked = settings.join(rules.where("kind != 'key'"), "name").where(F.col("value").isNotNull() & F.coalesce(bad, F.lit(True))).select(*keys, "severity", "name")
    needed = [(name, grave) for name, kind, _, _, grave in SETTINGS if kind == "key"]
    is_filled = (F.trim("value") != "") & (F.col("value") != PLACEHOLDER)
    filled = {name: F.coalesce(F.bool_or((F.col("name") == name) & is_filled), F.lit(False)).alias(f"_{name}") for name, _ in needed}
    of = lambda name: F.max(F.when(F.col("name") == name, number))
    each = settings.groupBy(*keys).agg(*filled.values(), of("OVERLAP_PAGES").alias("_overlap"), of("PAGES_PER_BATCH").alias("_batch"))
    fault = lambda bad, severity, name: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("name")))
    faults = [fault(~F.col(f"_{name}"), grave, name) for name, grave in needed]
    wide = fault((F.col("_overlap") < 0) | (F.col("_overlap") >= F.col("_batch")), "error", "OVERLAP_PAGES")
    return checked.unionByName(each.select(*keys, F.inline(F.array_compact(F.array(*faults, wide)))))
