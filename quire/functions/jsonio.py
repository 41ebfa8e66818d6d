"""Json in the answers of models: finding, mending and checking it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def first_balanced(text: str) -> str | None:
    """The object or array that opens first of those that close, mindful of strings and escapes.

    One pass for all brackets: a value that closes counts once nothing that opened before it can close any more.
    """
    stack: list[tuple[str, int]] = []
    quoted = escaped = False
    best: tuple[int, int] | None = None
    for at, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"' and stack:
            quoted = True
        elif c in "[{":
            stack.append(("]" if c == "[" else "}", at))
        elif c in "]}" and stack:
            want, start = stack.pop()
            if want != c:  # what is open can close no more
                if best:
                    break
                stack.clear()
            else:
                if best is None or start < best[0]:
                    best = (start, at + 1)
                if not stack:
                    break
    return text[best[0] : best[1]] if best else None


def mend(text: str) -> str:
    """Without control characters, and with stray backslashes doubled."""
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in '"\\/bfnrtu' else "\\\\" + m[1], clean)


def mended(text: Column) -> Column:
    """mend() of a column: valid pairs are marked with a character that was cleaned away before, and stay."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    marked = F.regexp_replace(clean, r'\\(["\\/bfnrtu])', "\x01$1")
    pairs = F.regexp_replace(marked, r"(?<!\x01)\\(.)", r"\\\\$1")
    return F.regexp_replace(pairs, "\x01", r"\\")


def parse(text: str | None, kind: str) -> str | None:
    """A model's answer as json text of a kind (array or object), or null.

    Tried in turn: a fenced block, the whole, the first balanced value, and each of these mended. One object stands for an
    array of it, and an array's first object for an object.
    """
    if not text:
        return None
    tried = [*FENCE.findall(text)[:1], text.strip(), first_balanced(text)]
    for candidate in (f(t) for f in (lambda x: x, mend) for t in tried if t):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if kind == "array" and isinstance(value, dict):
            value = [value]
        if kind == "object" and isinstance(value, list):
            value = next((v for v in value if isinstance(v, dict)), None)
        if isinstance(value, list if kind == "array" else dict):
            return json.dumps(value, ensure_ascii=False)
    return None


def parsed(answer: Column, kind: str = "array") -> Column:
    """parse() as a column, for from_json."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([parse(t, kind) for t in texts], dtype=object)

    return run(answer)


def answer_content(response: Column) -> dict[str, Column]:
    """Content, end reason and status of an api response of either of two shapes."""
    get = lambda path: F.get_json_object(response, path)
    content = F.coalesce(get("$.choices[0].message.content"), get("$.candidates[0].content.parts[0].text"))
    reason = F.coalesce(get("$.choices[0].finish_reason"), F.lower(get("$.candidates[0].finishReason")))
    status = (
        F.when(get("$.error").isNotNull(), "error")
        .when(content.isNull() | (F.trim(content) == ""), "empty")
        .when(reason.isin("length", "max_tokens"), "truncated")
        .otherwise("ok")
    )
    return {"content": content, "finish_reason": reason, "status": status}


def four_fields(answer: Column) -> Column:
    """A fenced or plain object with title, subtitle, authors and content as a struct; null where one is missing."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?i)^\s*```(json)?", ""), r"```\s*$", ""))
    value = F.from_json(bare, "title string, subtitle string, authors string, content string")
    return F.when(value["title"].isNotNull() & value["subtitle"].isNotNull() & value["authors"].isNotNull() & value["content"].isNotNull(), value)


def is_array(answer: Column) -> Column:
    return F.coalesce(F.json_array_length(answer) > 0, F.lit(False))


def mask_secrets(headers: Column) -> Column:
    """A map of headers with the values of secret ones masked."""
    secret = lambda k: F.lower(k).rlike("authorization|api-?key|token|cookie")
    return F.transform_values(headers, lambda k, v: F.when(secret(k), F.concat(F.left(v, F.lit(4)), F.lit("***"))).otherwise(v))


def parse_with_repair(text: str | None, kind: str, repair, tries: int = 2) -> str | None:
    """parse(); what cannot be read is given to ``repair`` (a model that takes a text and gives one), at most ``tries`` times."""
    found = parse(text, kind)
    for _ in range(tries):
        if found is not None or not text:
            break
        try:
            text = repair(text)
        except Exception:  # the model's errors use up a try
            continue
        found = parse(text, kind)
    return found


def repaired(answer: Column, repair, kind: str = "array", tries: int = 2) -> Column:
    """parse_with_repair() as a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_with_repair(t, kind, repair, tries) for t in texts], dtype=object)

    return run(answer)
