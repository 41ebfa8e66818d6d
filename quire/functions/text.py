"""Text columns: normalisation, cleaning, validity checks. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^\s+|\s+$"

#: White space as html and the SQL twins have it: without the vertical tab.
SPACE = r"[\t\n\f\r ]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, BLANK, "")


def trim_spaces(c: Column) -> Column:
    """Without spaces of any width at either end; tabs and line ends stay, as with the SQL twins' trim()."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def lower_each(c: Column) -> Column:
    """Lower case, a character for a character: no final form of sigma and no mark left of a dotted I."""
    return F.lower(F.translate(c, "\u03a3\u0130", "\u03c3i"))


def upper_each(c: Column) -> Column:
    """Upper case, a character for a character: those that would become several stay, as ß."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


def chain(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """regexp_replace once for each (pattern, replacement)."""
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def first_contained(c: Column, words: Sequence[str]) -> Column:
    """The first of ``words`` that the column contains, else null."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words))


def null_if_missing(c: Column) -> Column:
    """Trimmed text; null where it is the word null."""
    t = strip(c)
    return F.when(F.lower(t) != "null", t)


#: Characters that compare as equal.
DASHES = "[–—―‒−－-]"
QUOTES = "[\"„‟❝❞«»‹›]"
ELLIPSES = "[…⋯]"


def comparable(c: Column) -> Column:
    """Lower-cased ASCII with one kind of dash, quote and white space, for comparing fragments."""
    steps = [(DASHES, "-"), (QUOTES, '"'), (ELLIPSES, "..."), (r"[^\x00-\x7F]+", ""), (r"\s+", " ")]
    return F.trim(chain(F.lower(c), steps))


def paragraph_key(c: Column) -> Column:
    """A paragraph's key: lower case, one kind of dash, white space collapsed."""
    return F.trim(chain(F.lower(c), [("[–—-]", "-"), ("…", "..."), (r"\s+", " ")]))


def title_key(c: Column) -> Column:
    """A title's key: lower case, punctuation to spaces, collapsed."""
    return F.trim(chain(F.lower(c), [(r"[^\p{L}\p{N}_\s]", " "), (r"\s+", " ")]))


#: Labels and quotes that models put around a translation.
TRANSLATION_PREFIXES = (
    r"^译文[：:]\s*",
    r"^翻译[：:]\s*",
    r"^【译文】\s*",
    r"^【翻译】\s*",
    r"^\[译文\]\s*",
    r"^\[翻译\]\s*",
    r"^Translation[:\s]+",
    r"^Translated text[:\s]+",
    r"^以下是翻译[：:]\s*",
    r"^翻译如下[：:]\s*",
    r"^翻译结果[：:]\s*",
)
QUOTE_PAIRS = (('"', '"'), ("「", "」"), ("『", "』"), ("《", "》"))


def clean_translation(c: Column) -> Column:
    """Without labels before and a pair of quotes around it."""
    out = chain(strip(c), [(f"(?i){p}", "") for p in TRANSLATION_PREFIXES])
    for a, b in QUOTE_PAIRS:
        quoted = F.startswith(out, F.lit(a)) & F.endswith(out, F.lit(b)) & (F.length(out) > 1)
        out = F.when(quoted, F.substring(out, F.lit(2), F.length(out) - 2)).otherwise(out)
    return strip(out)


#: What an error answer looks like.
ERROR_PATTERNS = (
    r"""^\s*\{\s*["']error["']""",
    r'"error"\s*:\s*\{',
    r'"error"\s*:\s*"[^"]{10,}',
    r'"code"\s*:\s*"(insufficient_quota|insufficient_user_quota|auth_error|invalid_api_key)"',
    r"400\s+bad\s+request",
    r"401\s+unauthorized",
    r"403\s+forbidden",
    r"404\s+not\s+found",
    r"429\s+too\s+many\s+requests",
    r"500\s+internal\s+server\s+error",
    r"502\s+bad\s+gateway",
    r"503\s+service\s+unavailable",
    r"504\s+gateway\s+timeout",
)
TRUNCATED = r"\[truncated\]"


def is_error_answer(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(f"(?i){p}") for p in ERROR_PATTERNS))


def translation_problem(original: Column, translated: Column) -> Column:
    """Why a translation is invalid, or null: error, empty, incomplete, identical, prefix."""
    t = strip(translated)
    return (
        F.when(translated.isNull() | (translated == "") | is_error_answer(translated), "error")
        .when(t == "", "empty")
        .when(translated.rlike(f"(?i){TRUNCATED}"), "incomplete")
        .when(t == strip(original), "identical")
        .when(F.startswith(original, t), "prefix")
    )


#: Prompt marks that must not be in a translation.
LEAKS = ("【参考上下文", "【不要翻译", "【待翻译", "【请直接输出", "上文:", "下文:", "章节:", "摘要:", "关键词:", "===============")


def count_of(c: Column, part: str) -> Column:
    """How often ``part`` stands in the text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def translation_kind(original: Column) -> dict[str, Column]:
    """Flags of texts to which the translation checks do not apply."""
    low, t = F.lower(original), strip(original)
    n_words = F.size(F.filter(F.split(original, r"\s+"), lambda x: x != ""))
    cjk = F.length(F.regexp_replace(original, "[^一-鿿]", ""))
    site = F.startswith(t, F.lit("http")) | F.startswith(t, F.lit("www.")) | contains_any(original, (".com", ".org"))
    return {
        "is_html_table": contains_any(low, ("<table>", "<td>", "<tr>")),
        "is_structured": (count_of(original, "@") >= 2) | (count_of(original, "http") >= 2) | (count_of(original, "$") >= 3),
        "is_url_only": site & (n_words <= 3),
        "is_contact": F.contains(original, F.lit("@")) & ((count_of(original, ":") >= 2) | F.contains(original, F.lit("+")) & (F.length(original) < 200)),
        "is_copyright": F.startswith(t, F.lit("©")) | F.startswith(t, F.lit("BY:")) | F.contains(original, F.lit("All rights reserved")),
        "is_target_language": cjk / F.greatest(F.length(t), F.lit(1)) > 0.3,
    }


def mask_words(c: Column, words: Sequence[str], mask: str = "***") -> Column:
    """Every one of ``words`` as the mask; the list is the caller's, none are built in."""
    if not words:
        return c
    body = "|".join("".join(f"\\{x}" if not x.isalnum() else x for x in w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(c, f"(?iu){body}", mask)


def ellipsis(c: Column, limit: int = 50) -> Column:
    """A text longer than ``limit`` cut to it, dots included."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def journal_name(c: Column) -> Column:
    """A journal's name from a file name: leading number and trailing part after a dash go."""
    base = F.regexp_replace(c, r"^\d+[-_]", "")
    short = F.regexp_replace(base, "-[^-]*$", "")
    return F.when(F.length(short) > 5, short).otherwise(base)


def scrub_controls(c: Column) -> Column:
    """Without the characters that XML forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F]", "")


def is_garbage(c: Column) -> Column:
    """Ten characters or more, of which over 80 % are control characters."""
    n = F.length(c)
    return (n >= 10) & ((n - F.length(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))) > n * 0.8)


def error_key(c: Column) -> Column:
    """A message without its numbers and repeat count, for grouping."""
    return strip(chain(c, [(r"\s*\(x\d+\)?$", ""), (r"\d+", "{n}"), (r"\s+", " ")]))


def without_elements(c: Column, tags: Sequence[str]) -> Column:
    """Html without the elements of these tags and what they hold."""
    return chain(c, [(f"(?is)<{t}\\b.*?</{t}>", "") for t in tags])


def is_html(c: Column) -> Column:
    return F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")) & c.rlike("(?i)<(p|div|span|h[1-6]|ul|ol|li|table|article|section)\\b")


def inject_css(page: Column, css: str, mark: str) -> Column:
    """Style rules before the first ``</style>``, unless the page holds ``mark``."""
    at = F.locate("</style>", page)
    added = F.concat(F.substring(page, F.lit(1), at - 1), F.lit(css), F.substring(page, at, F.length(page)))
    return F.when((at > 0) & ~F.contains(page, F.lit(mark)), added).otherwise(page)


#: A transparent pixel.
PIXEL = "data:image/gif;base64,R0lGODlhAQABAPAAAAAAAAAAACH5BAEAAAAALAAAAAABAAEAAAICRAEAOw=="


def data_uri(extension: Column, content: Column) -> Column:
    """A data uri of binary content; one transparent pixel where there is none."""
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml"}
    mime = F.coalesce(*(F.when(F.lower(extension) == k, v) for k, v in kinds.items()), F.lit("image/png"))
    return F.when(content.isNotNull(), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))).otherwise(PIXEL)
