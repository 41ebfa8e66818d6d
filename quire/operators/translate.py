"""Translation behind a client that the caller gives, with typed results and a cache."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonio import parse
from quire.functions.text import ERROR_PATTERNS, QUOTE_PAIRS, TRANSLATION_PREFIXES, TRUNCATED
from quire.operators.glossary import Terms

RESULT = "status string, translated_text string, error_category string, error_message string, retry_count int"

#: So many texts are translated before their results are put into Arrow.
SLICE = 500

#: A client takes texts and gives translations; it may raise.
Client = Callable[[list[str]], list[str]]


def digit_client(texts: list[str]) -> list[str]:
    """A stand-in for a model: it writes 3 for e."""
    return [t.replace("e", "3") for t in texts]


def error_category(e: Exception) -> str:
    """The class of a client's error by its message."""
    low = f"{type(e).__name__} {e}".lower()
    kinds = (("timeout", ("timeout", "timed out")), ("rate_limit", ("429", "rate limit", "too many")), ("auth", ("401", "403", "auth")), ("client", ("400", "404", "bad request")), ("server", ("500", "502", "503", "504", "server")), ("network", ("connection", "network")), ("json_parse", ("json",)))
    return next((k for k, marks in kinds if any(m in low for m in marks)), "unknown")


def chunks(text: str, limit: int = 8000) -> list[str]:
    """Parts of a text of at most ``limit`` characters that join to it, cut at blank lines; one block may be longer."""
    out, now = [], ""
    for part in re.split(r"(\n\s*\n)", text):
        if now and len(now) + len(part) > limit:
            out.append(now)
            now = ""
        now += part
    return [*out, now] if now or not out else out


def one(text: str | None, client: Client, tries: int, limit: int, prepare: Callable[[str], str] | None = None, insist: Client | None = None) -> tuple:
    """A text's result.

    An answer that is not valid, or that is the text again once cleaned, is asked for again, by ``insist`` if there is one; a text over
    ``limit`` goes in parts, each of which stays as it was if no answer to it has words.
    """
    if text is None or not text.strip():
        return "empty_input", None, "validation", "empty input", 0
    prepare = prepare or (lambda t: t)
    if len(text) > limit:
        return "success", "\n\n".join(_part(t, client, tries, prepare) for t in chunks(text, limit)), None, None, 0
    last = None
    for n in range(tries):
        try:
            said = "".join((insist if insist and n else client)([prepare(text)]))
        except Exception as e:  # the client's errors become rows
            last = "llm_error", None, error_category(e), str(e), n + 1
            continue
        problem = answer_problem(text, said)
        done = cleaned(said) if problem is None else ""
        if problem is not None:
            last = "validation_failed", None, "validation", problem, n + 1
        elif done == text.strip():
            last = "identical_to_source", None, "identical", "identical", n + 1
        else:
            return "success", done, None, None, n
    return last or ("llm_error", None, "unknown", "no tries", 0)


def _part(text: str, client: Client, tries: int, prepare: Callable[[str], str]) -> str:
    for _ in range(tries):
        try:
            done = cleaned("".join(client([prepare(text)])))
        except Exception:  # noqa: S112  as the client's other failures, it leads to the next try
            continue
        if done:
            return done
    return text


def answer_problem(text: str, said: str | None) -> str | None:
    """Why an answer is invalid, as text.translation_problem() has it for columns."""
    if not said or any(re.search(p, said, re.IGNORECASE) for p in ERROR_PATTERNS):
        return "error"
    bare = said.strip()
    if not bare:
        return "empty"
    if re.search(TRUNCATED, said, re.IGNORECASE):
        return "incomplete"
    if bare == text.strip():
        return "identical"
    return "prefix" if text.startswith(bare) else None


def cleaned(said: str) -> str:
    """An answer without labels before and a pair of quotes around it, as text.clean_translation() has it for columns."""
    out = said.strip()
    for p in TRANSLATION_PREFIXES:
        out = re.sub(p, "", out, flags=re.IGNORECASE)
    for a, b in QUOTE_PAIRS:
        if len(out) > 1 and out.startswith(a) and out.endswith(b):
            out = out[1:-1]
    return out.strip()


def results(rows: Iterable[tuple]) -> pa.Array:
    """Tuples as one() gives them, as an array of RESULT."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32() if n == "retry_count" else pa.string()) for n, c in zip(names, columns, strict=True)], names)


def translate_column(
    df: DataFrame, column: str, client: Client, tries: int = 3, limit: int = 8000, result: str = "result", terms: list[tuple[str, str]] | None = None, whole_word: bool = True, insist: Client | None = None
) -> DataFrame:
    """``df`` with a result struct for a text column; a failing client gives a status, never a failed task.

    ``terms``, a glossary of bounded size, longest first, are put into a text before the client sees it. ``insist`` is asked instead of the client
    where an answer was refused: the same model with a prompt that says so.
    """
    @F.arrow_udf(RESULT)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Terms(terms, whole_word, True) if terms else None
        prepare = (lambda t: known.replace(t)[0]) if known else None
        for texts in parts:  # few of a batch's texts at a time are Python objects
            yield pa.concat_arrays([results(one(t, client, tries, limit, prepare, insist) for t in texts.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(texts)), SLICE)])

    return df.withColumn(result, run(F.col(column)))


def legacy_text(result: Column) -> Column:
    """A result as the text that older tables hold: the translation, or a mark."""
    return F.when(result["status"] == "success", result["translated_text"]).otherwise(F.concat(F.lit("["), result["status"], F.lit("]")))


def is_failed(text: Column) -> Column:
    """Does an older table's text stand for a failure?"""
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | text.rlike(r"^\[(llm_error|validation_failed|identical_to_source|empty_input)\]")


def cache_hits(rows: DataFrame, cache: DataFrame, keys: list[str], value: str = "translated") -> DataFrame:
    """``rows`` with the cache's value and ``hit``: whether it has one for all keys that is not blank."""
    valid = cache.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "").select(*keys, value).dropDuplicates(keys)
    return rows.join(valid, keys, "left").withColumn("hit", F.col(value).isNotNull())


def translate_missing(rows: DataFrame, cache: DataFrame, keys: list[str], column: str, client: Client, **kwargs) -> DataFrame:
    """Every row's translation: the cache's where it has one, the client's for the others alone."""
    split = cache_hits(rows, cache, keys)
    ready = split.where("hit").select(*rows.columns, F.lit("success").alias("status"), "translated")
    new = translate_column(split.where("not hit").select(rows.columns), column, client, **kwargs)
    return ready.unionByName(new.select(*rows.columns, F.col("result.status").alias("status"), F.col("result.translated_text").alias("translated")))


def cache_counts(cache: DataFrame, keys: list[str], translated: str, fragment: str) -> DataFrame:
    """How many valid translations and html fragments a cache has."""
    good = F.coalesce(~is_failed(F.col(translated)), F.lit(False))
    return cache.groupBy(keys).agg(F.count_if(good).alias("n_translations"), F.count_if(F.coalesce(F.col(fragment), F.lit("")) != "").alias("n_fragments"))


#: An article client takes four fields and gives an answer with all of them as json; a field client takes one text.
FIELDS = ("title", "subtitle", "authors", "content")


def article_stub(fields: dict[str, str]) -> str:
    """A stand-in: the fields with 3 for e; an incomplete answer for content 1 and none for 2."""
    if fields["content"] == "2":
        raise TimeoutError("timed out")
    done = {k: v.replace("e", "3") for k, v in fields.items() if not (fields["content"] == "1" and k == "authors")}
    return f"```json\n{json.dumps(done)}\n```"


def field_stub(texts: list[str], fields: dict[str, str] | None = None) -> list[str]:
    if fields and fields["content"] == "1":
        raise ConnectionError("network")
    return [t.replace("e", "3") for t in texts]


def translate_articles(df: DataFrame, article_client: Callable[[dict], str], field_client: Callable[..., list[str]], suffix: str = "_zh") -> DataFrame:
    """``df`` with its four fields translated, and ``how``: by one call for the ``article``, or by ``fields`` where its answer lacks one.

    A field whose own call fails, or gives the text back, is null; an empty field stays empty.
    """
    names = [f + suffix for f in FIELDS]

    def one(fields: dict[str, str]) -> tuple:
        try:
            said = json.loads(parse(article_client(fields), "object") or "{}")
            if all(isinstance(said.get(f), str) for f in FIELDS) and all(said[f].strip() or not fields[f].strip() for f in FIELDS):
                return (*(said[f] for f in FIELDS), "article")
        except Exception:  # noqa: S110  the client's errors lead to single fields
            pass
        out = []
        for f in FIELDS:
            if not fields[f].strip():
                out.append("")
                continue
            try:
                done = "".join(field_client(chunks(fields[f]), fields))
            except Exception:
                done = ""
            out.append(done if done.strip() and done.strip() != fields[f].strip() else None)
        return (*out, "fields")

    @F.pandas_udf(", ".join(f"{n} string" for n in [*names, "how"]))
    def run(title: pd.Series, subtitle: pd.Series, authors: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [one(dict(zip(FIELDS, (x or "" for x in r), strict=True))) for r in zip(title, subtitle, authors, content, strict=True)]
        return pd.DataFrame(rows, columns=[*names, "how"], dtype=object)

    return df.withColumn("_t", run(*FIELDS)).select(*df.columns, "_t.*")


def with_quality(client: Client, fallback: Client, passes: Callable[[str, str], bool], tries: int = 3) -> Client:
    """A client that asks again while a translation does not pass, the last time the fallback; what never passes stays as it was.

    Three texts on end that come back unchanged stop the asking: the client is then taken to be out of order.
    """

    def run(texts: list[str]) -> list[str]:
        out, unchanged = [], 0
        for t in texts:
            done = t
            for n in range(tries if unchanged < 3 else 0):
                said = (client if n + 1 < tries else fallback)([t])[0]
                if passes(t, said):
                    done = said
                    break
            unchanged = unchanged + 1 if done == t else 0
            out.append(done)
        return out

    return run


def command(tool: str, file: Column, folder: Column, options: dict[str, Column], glossary: Column, modes: Column, translated_first: bool = True, watermark: bool = False) -> Column:
    """The arguments of an external translator for each file; options without value are left out."""
    known = [F.when(v.isNotNull(), F.array(F.lit(f"--{k}"), v)) for k, v in options.items()]
    one, both = F.array_contains(modes, "translated_only"), F.array_contains(modes, "bilingual")
    marks = [
        F.when(glossary.isNotNull(), F.array(F.lit("--glossary-files"), glossary)),
        F.when(one & ~both, F.array(F.lit("--no-dual"))).when(both & ~one, F.array(F.lit("--no-mono"))),
        F.when(both & F.lit(translated_first), F.array(F.lit("--dual-translate-first"))),
        F.when(both & F.lit(not watermark), F.array(F.lit("--no-watermark"))),
    ]
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.lit(tool), F.lit("--files"), file, F.lit("--output"), folder), *(F.coalesce(p, none) for p in [*known, *marks]))


def translate_images(df: DataFrame, key: str, images: str, fields: tuple[str, ...], client: Client, suffix: str = "_zh", **kwargs) -> DataFrame:
    """``key, images``: each row's nested images with their text fields translated beside the originals; what fails keeps its text.

    Texts are translated as rows of their own, so that a call sees one text and no row holds more than its images.
    """
    each = df.select(key, F.posexplode(images).alias("_i", "_image"))
    texts = each.select(key, "_i", "_image", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_image.{f}").alias("text")) for f in fields))).alias("_t")).select(key, "_i", "_image", "_t.*")
    done = translate_column(texts, "text", client, **kwargs).withColumn("_said", F.coalesce("result.translated_text", "text"))
    by = done.groupBy(key, "_i").agg(F.first("_image").alias("_image"), F.map_from_entries(F.collect_list(F.struct("field", "_said"))).alias("_m"))
    image = F.col("_image")
    for f in fields:
        image = image.withField(f + suffix, F.col("_m")[f])
    rows = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", image.alias("image")))).alias("_r"))
    return rows.select(key, F.transform("_r", lambda x: x["image"]).alias(images))
