"""Queries of checks, caches, sessions and small rules that the other modules do not cover."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import checks, jsonio, text
from quire.operators import articles, fragments, images, metrics, placing, progress, prompts, render, retries, tables, translate
from quire.operators.archive import inventory
from quire.plans.registry import query
from quire.sources.tables import table


def sql_list(words) -> str:
    """Words as the body of an SQL list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pick(key: str, *values: str | None) -> Column:
    """One of the texts by a number, in turn."""
    n = F.pmod(F.col(key), F.lit(len(values)))
    out = F.when(n == 0, F.lit(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(n == k, F.lit(v))
    return out.cast("string")


def sql_pick(key: str, *values: str | None) -> str:
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


# Articles


@query(
    "kept_articles",
    r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 5 = 0 THEN ' ' || left(text, CAST(doc_id % 70 AS INTEGER)) ELSE text END AS content FROM documents),
    s AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS c FROM d)
    SELECT doc_id, length(c) >= 50 AS long_enough, (regexp_replace(title, '^\s+|\s+$', '', 'g') <> '' OR c <> '') AS not_empty FROM s
    """,
)
def kept_articles(spark, sf_dir):
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.left("text", (F.col("doc_id") % 70).cast("int")))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), content.alias("content"))
    keep = lambda df, name: df.select("doc_id", F.lit(True).alias(name))
    out = docs.select("doc_id").join(keep(articles.drop_short(docs), "long_enough"), "doc_id", "left").join(keep(articles.drop_empty(docs), "not_empty"), "doc_id", "left")
    return out.fillna(False)


@query(
    "ads_dropped",
    f"""
    WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Our sponsored ' ELSE '' END || p_name || CASE WHEN p_partkey % 11 = 0 THEN ' AD: now' ELSE '' END AS title FROM part)
    SELECT p_partkey, title FROM t WHERE NOT list_bool_or(list_transform([{sql_list(articles.AD_WORDS)}], lambda w: contains(lower(title), lower(w))))
    """,
)
def ads_dropped(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 9 == 0, "Our sponsored ").otherwise(""), "p_name", F.when(k % 11 == 0, " AD: now").otherwise(""))
    return articles.drop_ads(table(spark, sf_dir, "part").select("p_partkey", title.alias("title")))


@query(
    "numbered_without_ads",
    """
    WITH t AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Sponsored ' ELSE '' END || p_name AS title, p_size % 13 = 0 AS not_in_toc FROM part),
    k AS (SELECT *, NOT not_in_toc AND NOT contains(lower(title), 'sponsored') AS keep FROM t)
    SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS number, (SELECT count(*) FROM k x WHERE x.p_brand = k.p_brand AND NOT x.keep) AS n_removed
    FROM k WHERE keep
    """,
)
def numbered_without_ads(spark, sf_dir):
    title = F.concat(F.when(F.col("p_partkey") % 9 == 0, "Sponsored ").otherwise(""), "p_name")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", title.alias("title"), (F.col("p_size") % 13 == 0).alias("not_in_toc"))
    return articles.renumbered(rows, "p_brand", "p_partkey", "title", "not_in_toc").select("p_brand", "p_partkey", "number", "n_removed")


@query(
    "pages_with_content",
    """
    SELECT source, count(*) AS n, CAST(count_if(doc_id % 7 = 0) AS BIGINT) AS n_not_in_toc FROM documents WHERE doc_id % 10 <> 3 AND regexp_replace(text, '\\s', '', 'g') <> '' GROUP BY source
    """,
)
def pages_with_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 7 == 0).alias("not_in_toc"), F.when(F.col("doc_id") % 10 == 3, " \n").otherwise(F.col("text")).alias("content"))
    return articles.with_content(docs).groupBy("source").agg(F.count("*").alias("n"), F.count_if("not_in_toc").alias("n_not_in_toc"))


@query(
    "outline_problems",
    f"""
    WITH o AS (SELECT o_orderkey, {sql_pick("o_orderkey", "Journal", "  ", None)} AS name, {sql_pick("o_orderkey // 3", "mixed", "Unknown", None)} AS kind, {sql_pick("o_orderkey // 9", "fine", "Extraction FAILED", None)} AS summary FROM orders)
    SELECT o_orderkey, concat_ws(',', CASE WHEN trim(coalesce(name, '')) = '' THEN 'no name' END, CASE WHEN contains(lower(coalesce(summary, '')), 'failed') THEN 'error mark' END,
           CASE WHEN lower(coalesce(kind, 'unknown')) = 'unknown' THEN 'type unknown' END) AS problems FROM o
    """,
)
def outline_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"a": F.floor(F.col("o_orderkey") / 3), "b": F.floor(F.col("o_orderkey") / 9)})
    found = articles.outline_problems(pick("o_orderkey", "Journal", "  ", None), pick("a", "mixed", "Unknown", None), pick("b", "fine", "Extraction FAILED", None))
    return rows.select("o_orderkey", F.array_join(found, ",").alias("problems"))


@query(
    "outline_validity",
    f"""
    WITH o AS (SELECT o_orderkey, {sql_pick("o_orderkey", "Journal", " ", None, "J", "K")} AS n, {sql_pick("o_orderkey // 5", "English", "Klingon", None)} AS l, {sql_pick("o_orderkey // 15", "mixed", "unknown", "other")} AS t,
               {sql_pick("o_orderkey // 45", "fine", "No context summary available", None)} AS s FROM orders)
    SELECT o_orderkey, CASE WHEN n IS NULL OR l IS NULL OR s IS NULL THEN 'missing ' || concat_ws(', ', CASE WHEN n IS NULL THEN 'journal_name' END, CASE WHEN l IS NULL THEN 'language' END, CASE WHEN s IS NULL THEN 'content_summary' END)
           WHEN trim(n) = '' THEN 'name is blank' WHEN contains(s, 'No context summary available') THEN 'summary is an error' WHEN l NOT IN ('English', 'Russian', 'Chinese') THEN 'language'
           WHEN t = 'other' THEN 'type' WHEN t = 'unknown' THEN 'type is unknown' END AS fault FROM o
    """,
)
def outline_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({k: F.floor(F.col("o_orderkey") / n) for k, n in (("a", 5), ("b", 15), ("c", 45))})
    outline = F.struct(
        pick("o_orderkey", "Journal", " ", None, "J", "K").alias("journal_name"), F.lit("1").alias("issue_number"), pick("a", "English", "Klingon", None).alias("language"),
        pick("b", "mixed", "unknown", "other").alias("journal_type"), pick("c", "fine", "No context summary available", None).alias("content_summary"),
    )
    return rows.select("o_orderkey", checks.outline_fault(outline).alias("fault"))


# Translations


SHORT = "string_split(text, chr(10))[1]"


def variants() -> dict[str, Column]:
    """An original (a document's first line) and something said to be its translation."""
    n, title = F.col("doc_id") % 9, F.split_part("text", F.lit("\n"), F.lit(1))
    original = F.when(n == 5, F.left(title, F.lit(9))).when(n == 8, F.concat(F.lit("<td>"), title, F.lit("</td>"))).otherwise(title)
    made = (
        F.when(n == 0, " \n")
        .when(n == 1, F.concat(F.lit("上文: "), title))
        .when(n == 2, F.replace(title, F.lit(" "), F.lit("  ")))
        .when(n == 3, F.repeat(F.reverse(F.left(title, F.lit(30))), 40))
        .when(n == 4, F.concat(F.lit("Here is the Translation "), F.left(title, F.lit(20))))
        .when(n == 5, F.lit("z" * 95))
        .when(n == 6, F.concat(F.lit("q" * 130), F.left(title, F.lit(5))))
        .when(n == 7, F.lit("x y"))
        .otherwise(F.lit("w" * 120))
    )
    return {"original": original, "translated": made}


@query("translation_quality")
def translation_quality(spark, sf_dir):
    """Its twin would need the matching-blocks ratio; the tests hold it against a plain version."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *(c.alias(k) for k, c in variants().items()))
    return rows.select("doc_id", checks.translation_fault(F.col("original"), F.col("translated")).alias("fault"))


@query(
    "repeated_parts",
    """
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN left(text, 160) || right(text, 30) || left(text, 90) || left(text, 80) ELSE left(text, 700) END AS t FROM documents),
    p AS (SELECT doc_id, t, length(t) > 100 AND list_bool_or(list_transform([20, 30, 50], lambda s: coalesce(list_bool_or(list_transform(range(0, least(200, length(t) - s)), lambda i: length(t) - length(replace(t, substr(t, i + 1, s), '')) >= 3 * s)), false))) AS repeated FROM d)
    SELECT doc_id, repeated FROM p
    """,
)
def repeated_parts(spark, sf_dir):
    """The repetition check alone, over beginnings of texts, as a model's short outputs are."""
    t = F.col("text")
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.left(t, F.lit(160)), F.right(t, F.lit(30)), F.left(t, F.lit(90)), F.left(t, F.lit(80)))).otherwise(F.left(t, F.lit(700)))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("t")).select("doc_id", checks.repeats(F.col("t")).alias("repeated"))


@query(
    "translation_kinds",
    r"""
    WITH d AS (
      SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '<table><TR>' || text WHEN 1 THEN 'a@b ' || text || ' http://x http://y' WHEN 2 THEN ' https://one.com two' WHEN 3 THEN 'E: a@b T: +1 ' || left(text, 20)
             WHEN 4 THEN ' © ' || text WHEN 5 THEN left(text, 5) || '译文翻译结果' ELSE text END AS t FROM documents),
    s AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS n FROM d)
    SELECT doc_id, contains(lower(t), '<table>') OR contains(lower(t), '<td>') OR contains(lower(t), '<tr>') AS is_html_table,
           length(t) - length(replace(t, '@', '')) >= 2 OR length(t) - length(replace(t, 'http', '')) >= 8 OR length(t) - length(replace(t, '$', '')) >= 3 AS is_structured,
           (starts_with(b, 'http') OR starts_with(b, 'www.') OR contains(t, '.com') OR contains(t, '.org')) AND n <= 3 AS is_url_only,
           contains(t, '@') AND (length(t) - length(replace(t, ':', '')) >= 2 OR contains(t, '+') AND length(t) < 200) AS is_contact,
           starts_with(b, '©') OR starts_with(b, 'BY:') OR contains(t, 'All rights reserved') AS is_copyright,
           (length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g'))) / greatest(length(b), 1) > 0.3 AS is_target_language FROM s
    """,
)
def translation_kinds(spark, sf_dir):
    n, t = F.col("doc_id") % 7, F.col("text")
    made = (
        F.when(n == 0, F.concat(F.lit("<table><TR>"), t)).when(n == 1, F.concat(F.lit("a@b "), t, F.lit(" http://x http://y"))).when(n == 2, F.lit(" https://one.com two"))
        .when(n == 3, F.concat(F.lit("E: a@b T: +1 "), F.left(t, F.lit(20)))).when(n == 4, F.concat(F.lit(" © "), t)).when(n == 5, F.concat(F.left(t, F.lit(5)), F.lit("译文翻译结果"))).otherwise(t)
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))
    return rows.select("doc_id", *(c.alias(k) for k, c in text.translation_kind(F.col("t")).items()))


@query(
    "strip_labels",
    r"""
    WITH d AS (SELECT doc_id, ' ' || CASE doc_id % 4 WHEN 0 THEN 'translation: ' WHEN 1 THEN '翻译结果： ' WHEN 2 THEN '【译文】 :' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN '「' || left(text, 40) || '」' WHEN 1 THEN '"《' || left(text, 40) || '》"' ELSE left(text, 40) END AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^(译文|翻译|【译文】|【翻译】|\[译文\]|\[翻译\]|translation|Translation|以下是翻译|翻译如下|翻译结果)[：:\s]+', '') AS b FROM d)
    SELECT doc_id, regexp_replace(CASE WHEN (left(b, 1) = '"' AND right(b, 1) = '"') OR (left(b, 1) = '「' AND right(b, 1) = '」') OR (left(b, 1) = '『' AND right(b, 1) = '』') OR (left(b, 1) = '《' AND right(b, 1) = '》') THEN substr(b, 2, length(b) - 2) ELSE b END, '^\s+|\s+$', '', 'g') AS bare FROM b
    """,
)
def strip_labels(spark, sf_dir):
    head = F.left("text", F.lit(40))
    n, m = F.col("doc_id") % 4, F.col("doc_id") % 3
    label = F.when(n == 0, "translation: ").when(n == 1, "翻译结果： ").when(n == 2, "【译文】 :").otherwise("")
    said = F.when(m == 0, F.concat(F.lit("「"), head, F.lit("」"))).when(m == 1, F.concat(F.lit('"《'), head, F.lit('》"'))).otherwise(head)
    return table(spark, sf_dir, "documents").select("doc_id", checks.strip_label(F.concat(F.lit(" "), label, said)).alias("bare"))


ANSWERS = ('{"error": "no quota left for this"}', "", " ", "half of it [TRUNCATED]", "<p>fine</p>", '[{"a": 1}]', "[]", "plain")


@query(
    "retry_reasons",
    f"""
    WITH a AS (SELECT event_id, {sql_pick("event_id", *ANSWERS)} AS a FROM events),
    g AS (SELECT event_id, a, CASE WHEN event_id % 8 = 0 THEN 'error' WHEN trim(a) = '' THEN 'empty' WHEN event_id % 8 = 3 THEN 'incomplete' END AS general FROM a)
    SELECT event_id, general, coalesce(general, CASE WHEN event_id % 8 <> 4 THEN 'invalid' END) AS html, coalesce(general, CASE WHEN event_id % 8 <> 5 THEN 'invalid' END) AS json FROM g
    """,
)
def retry_reasons(spark, sf_dir):
    a = pick("event_id", *ANSWERS)
    return table(spark, sf_dir, "events").select("event_id", checks.retry_reason(a).alias("general"), checks.retry_reason(a, "html").alias("html"), checks.retry_reason(a, "json").alias("json"))


@query(
    "failed_translations",
    f"""
    WITH a AS (SELECT event_id, {sql_pick("event_id", "done", "", None, "[llm_error]", "[other] x", "[identical_to_source] y")} AS t, {sql_pick("event_id // 6", "success", "llm_error", "empty_input")} AS status FROM events)
    SELECT event_id, trim(coalesce(t, '')) = '' OR starts_with(t, '[llm_error]') OR starts_with(t, '[identical_to_source]') AS failed, CASE WHEN status = 'success' THEN t ELSE '[' || status || ']' END AS legacy FROM a
    """,
)
def failed_translations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.floor(F.col("event_id") / 6))
    t = pick("event_id", "done", "", None, "[llm_error]", "[other] x", "[identical_to_source] y")
    result = F.struct(pick("n", "success", "llm_error", "empty_input").alias("status"), t.alias("translated_text"))
    failed = F.coalesce(translate.is_failed(t), F.lit(False))
    return rows.select("event_id", failed.alias("failed"), translate.legacy_text(result).alias("legacy"))


@query(
    "language_columns",
    f"""
    WITH a AS (SELECT o_orderkey, o_orderpriority AS title, {sql_pick("o_orderkey", "标题", "", None)} AS title_zh, {sql_pick("o_orderkey", "authors", None)} AS authors FROM orders)
    SELECT o_orderkey, CASE WHEN coalesce(title_zh, '') <> '' THEN title_zh ELSE title END AS title, coalesce(authors, '') AS authors, '内容' AS content FROM a
    """,
)
def language_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), pick("o_orderkey", "标题", "", None).alias("title_zh"), pick("o_orderkey", "authors", None).alias("authors"), F.lit("c").alias("content"), F.lit("内容").alias("content_zh"))
    return checks.in_language(rows, ["title", "authors", "content"], "_zh", ["content"]).select("o_orderkey", "title", "authors", "content")


@query("caption_texts", f"SELECT event_id, {sql_pick('event_id', 'one two', 'plain', '', None, '[broken')} AS caption FROM events")
def caption_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", checks.caption_text(pick("event_id", '["one", "two"]', "plain", "[]", None, "[broken")).alias("caption"))


@query(
    "task_results",
    """
    WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text, CASE WHEN turn % 2 = 0 THEN 'text_zh' ELSE 'list_items_zh' END AS field FROM conversations),
    r AS (SELECT *, left(replace(text, 'e', '3'), 30) AS done FROM t)
    SELECT conv_id, field, string_agg(done, '|' ORDER BY i) AS translated, string_agg('page_' || conv_id || '_task_' || i || '_' || field, '|' ORDER BY i) AS ids FROM r GROUP BY conv_id, field
    """,
)
def task_results(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    tasks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_idx"), n.alias("task_idx"), "text", F.when(F.col("turn") % 2 == 0, "text_zh").otherwise("list_items_zh").alias("field"))
    results = tasks.select("page_idx", "task_idx", F.left(F.replace("text", F.lit("e"), F.lit("3")), F.lit(30)).alias("translated"))
    by = retries.assign_results(tasks, results, ["page_idx"], "task_idx", item=["page_idx"])
    return by.select(F.col("page_idx").alias("conv_id"), "field", F.array_join("translated", "|").alias("translated"), F.array_join("text_ids", "|").alias("ids"))


@query(
    "still_failed",
    "SELECT event_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def still_failed(spark, sf_dir):
    failed = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return retries.still_failed(table(spark, sf_dir, "events"), failed, "user_id").select("event_id")


@query(
    "mended_json",
    r"""
    WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"p":"C:\\dir\x' || event_id || '"}' WHEN 1 THEN '{"p":"a\\\d\"' || chr(2) || '"}' WHEN 2 THEN '\u0041 \\\\ \q\\' ELSE props END AS t FROM events),
    c AS (SELECT event_id, regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS c FROM t),
    m AS (SELECT event_id, regexp_replace(c, '\\(["\\/bfnrtu])', chr(1) || '\1', 'g') AS m FROM c)
    SELECT event_id, replace(regexp_replace(replace(m, chr(1) || '\', chr(1) || chr(2)), '\\(.)', '\\\\\1', 'g'), chr(1) || chr(2), '\\') AS x FROM m
    """.replace("AS x FROM m", "AS half FROM m").replace("SELECT event_id, replace(regexp_replace", "SELECT event_id, replace(replace(regexp_replace").replace("'\\\\') AS half", "'\\\\'), chr(1), '\\') AS mended"),
)
def mended_json(spark, sf_dir):
    n = F.col("event_id") % 4
    t = F.when(n == 0, F.concat(F.lit('{"p":"C:\\\\dir\\x'), "event_id", F.lit('"}'))).when(n == 1, '{"p":"a\\\\\\d\\"\x02"}').when(n == 2, "\\u0041 \\\\\\\\ \\q\\\\").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", jsonio.mended(t).alias("mended"))


@query(
    "json_answers",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'T' || event_id END AS title, event_id % 4 = 1 AS is_list FROM events
    """,
)
def json_answers(spark, sf_dir):
    k = F.col("event_id").cast("string")
    whole = F.concat(F.lit('```json\n{"title": "T'), k, F.lit('", "subtitle": "", "authors": "a", "content": "c"}\n```'))
    fields = jsonio.four_fields(F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, '{"title": "x"}').otherwise("no json"))
    lists = pick("event_id", "[]", '[{"a": 1}]', "{}", None)
    return table(spark, sf_dir, "events").select("event_id", fields["title"].alias("title"), jsonio.is_array(lists).alias("is_list"))


@query(
    "parsed_answers",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'x' || event_id WHEN 2 THEN 'C:\\d' END AS v FROM events
    """,
)
def parsed_answers(spark, sf_dir):
    k, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    said = (
        F.when(n == 0, F.concat(F.lit('Sure: ```json\n[{"v": "'), k, F.lit('"}]\n``` done')))
        .when(n == 1, F.concat(F.lit('I say { [ "v" } and then {"v": "x'), k, F.lit('"} or so')))
        .when(n == 2, F.lit('{"v": "C:\\d"}'))
        .otherwise("nothing")
    )
    value = F.get_json_object(jsonio.parsed(said, "array"), "$[0].v")
    return table(spark, sf_dir, "events").select("event_id", value.alias("v"))


@query("masked_headers", "SELECT event_id, 'Bear***' AS auth, 'X-Api-Key' AS name, CAST(event_id AS VARCHAR) AS plain FROM events")
def masked_headers(spark, sf_dir):
    headers = F.create_map(F.lit("Authorization"), F.lit("Bearer abc"), F.lit("X-Api-Key"), F.concat(F.lit("sk-"), "event_id"), F.lit("Accept"), F.col("event_id").cast("string"))
    masked = jsonio.mask_secrets(headers)
    name = F.get(F.map_keys(F.map_filter(masked, lambda k, v: F.endswith(v, F.lit("***")) & (k != "Authorization"))), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", masked["Authorization"].alias("auth"), name.alias("name"), masked["Accept"].alias("plain"))


# Images and tables


@query(
    "path_dedup",
    f"""
    WITH i AS (SELECT event_id, {sql_pick("event_id // 2", "", None)} AS none, CASE WHEN event_id % 5 < 4 THEN event_type || (event_id % 500) ELSE {sql_pick("event_id", "", None)} END AS path FROM events)
    SELECT event_id FROM i QUALIFY coalesce(path, '') = '' OR row_number() OVER (PARTITION BY path ORDER BY event_id) = 1
    """,
)
def path_dedup(spark, sf_dir):
    path = F.when(F.col("event_id") % 5 < 4, F.concat("event_type", F.col("event_id") % 500)).otherwise(pick("event_id", "", None))
    return images.dedup_by_path(table(spark, sf_dir, "events").select("event_id", path.alias("path")), "path", "event_id").select("event_id")


@query(
    "figure_numbers",
    """
    WITH i AS (SELECT user_id, event_id, event_type || (event_id % 9) AS path FROM events),
    f AS (SELECT user_id, path, min(event_id) AS event_id FROM i GROUP BY ALL)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS figure FROM f
    """,
)
def figure_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.col("event_id") % 9).alias("path"))
    return images.number_figures(rows, ["user_id"], "path", "event_id").select("user_id", "event_id", "figure")


@query(
    "attached_images",
    """
    WITH a AS (SELECT n_regionkey, n_nationkey, n_name, min(n_nationkey) OVER (PARTITION BY n_regionkey, n_name) AS first FROM nation),
    i AS (SELECT c_custkey, n_regionkey AS f, n_name AS t FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 1 AND c_custkey % 3 <> 0 AND c_custkey % 10 <> 0)
    SELECT n_nationkey, concat_ws(',', 'own', (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM i WHERE f = a.n_regionkey AND t = a.n_name AND a.first = a.n_nationkey)) AS images FROM a
    """,
)
def attached_images(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = nation.select("n_regionkey", "n_nationkey", F.col("n_name").alias("title"), F.array(F.lit("own")).alias("images"))
    k = F.col("c_custkey")
    pictures = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", "c_custkey", F.when(k % 10 != 0, F.col("n_name")).alias("belongs_to_article"), (k % 4).cast("int").alias("page"), F.when(k % 3 == 0, 100).otherwise(90000).alias("size"), F.lit(500).alias("width"), F.lit(400).alias("height"), F.lit(0.5).alias("color_richness"), k.cast("string").alias("name")
    )
    return images.attach_to_titles(rows, pictures, "n_regionkey", "n_nationkey", "c_custkey", "name").select("n_nationkey", F.array_join("images", ",").alias("images"))


@query(
    "image_captions",
    """
    SELECT event_id, event_type || ' a b' AS by_name, 'Page ' || (event_id % 30) || ', top' AS by_place, '' AS bare,
           CASE WHEN event_id % 3 = 0 THEN '<figure><img src="p&amp;q"><figcaption>a &lt; b</figcaption></figure>' WHEN event_id % 3 = 1 THEN '<figure><img src="p&amp;q"><figcaption></figcaption></figure>'
           ELSE '<figure><img src="p&amp;q"><figcaption>Figure 7 (Page ' || (event_id % 30) || ', top)</figcaption></figure>' END AS figure FROM events
    """,
)
def image_captions(spark, sf_dir):
    name, page, n = F.concat("event_type", F.lit("_a--b.png")), (F.col("event_id") % 30).cast("string"), F.col("event_id") % 3
    figure = render.figure(F.lit("p&q"), F.when(n == 0, "a < b"), n == 1, F.lit("7"), page, F.lit("top"))
    how = {"by_name": "filename", "by_place": "position_based", "bare": "none"}
    return table(spark, sf_dir, "events").select("event_id", *(images.caption(s, name, page, F.lit("top")).alias(k) for k, s in how.items()), figure.alias("figure"))


@query(
    "data_uris",
    f"""
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '{text.PIXEL}' ELSE
           'data:' || {sql_pick("p_partkey", "image/jpeg", "image/png", "image/svg+xml", "image/png")} || ';base64,' || base64(encode(p_name)) END AS uri FROM part
    """,
)
def data_uris(spark, sf_dir):
    content = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name").cast("binary"))
    uri = text.data_uri(pick("p_partkey", "JPG", "png", "svg", "xyz"), content)
    return table(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"))


@query(
    "table_anchors",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS y0, l_quantity + 1 AS y1, CASE WHEN l_linenumber % 2 = 0 THEN 'Table ' || l_linenumber || ' of ' || l_returnflag ELSE 'line ' || l_linenumber END AS t FROM lineitem),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0 DESC, y1 DESC, t DESC) AS r FROM b WHERE y1 <= 24),
    z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, y1, t) AS r FROM b WHERE y0 >= 26),
    u AS (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY r DESC) AS s, arg_min(CASE WHEN starts_with(t, 'Table') THEN t END, -r) FILTER (starts_with(t, 'Table')) AS c FROM a WHERE r <= 2 GROUP BY 1),
    d AS (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY r) AS s, arg_min(t, r) FILTER (starts_with(t, 'Table')) AS c FROM z WHERE r <= 2 GROUP BY 1)
    SELECT o.l_orderkey, coalesce(u.s, '') AS anchor_before, coalesce(d.s, '') AS anchor_after, coalesce(d.c, u.c) AS caption
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN u USING (l_orderkey) LEFT JOIN d USING (l_orderkey)
    """,
)
def table_anchors(spark, sf_dir):
    t = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Table "), "l_linenumber", F.lit(" of "), "l_returnflag")).otherwise(F.concat(F.lit("line "), "l_linenumber"))
    block = F.struct(F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 1).alias("y1"), t.alias("text"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks"))
    return by.select("l_orderkey", *(c.alias(k) for k, c in tables.anchors(F.col("blocks"), F.lit(24), F.lit(26)).items()))


@query(
    "color_richness",
    """
    WITH p AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 6 AS n FROM p)
    SELECT doc_id, CASE WHEN n > 0 THEN len(list_distinct(list_transform(range(0, n), lambda i: substr(h, i * 6 + 1, 6)))) / 2500 ELSE 0.5 END AS richness FROM n
    """,
)
def color_richness(spark, sf_dir):
    """The bytes of texts stand for pixels."""
    return table(spark, sf_dir, "documents").select("doc_id", checks.color_richness(F.col("text").cast("binary")).alias("richness"))


@query(
    "image_prompts",
    """
    SELECT n_regionkey, '| # | name | page | vertical | horizontal | KB |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || r || ' | ' || n_name || ' | ' || (n_nationkey % 9) || ' | top | left | ' || (n_nationkey * 2) || '.0 |', chr(10) ORDER BY r) AS listed,
           CAST(max(n_nationkey % 9 * 10 + 5) AS INTEGER) AS widest FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY n_regionkey
    """,
)
def image_prompts(spark, sf_dir):
    k = F.col("n_nationkey")
    image = F.struct("n_nationkey", F.col("n_name").alias("name"), (k % 9).alias("page"), F.lit("top").alias("vertical_position"), F.lit("left").alias("horizontal_position"), (k * 2048).alias("size"))
    size = prompts.box_size(F.lit(0), F.lit(None).cast("int"), F.array(F.lit(5.0), F.lit(0.0), ((k % 9) * 10 + 10).cast("double"), F.lit(7.0)))
    by = table(spark, sf_dir, "nation").withColumn("w", size["width"]).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(image)).alias("i"), F.max("w").alias("widest"))
    return by.select("n_regionkey", prompts.image_table(F.col("i")).alias("listed"), "widest")


@query("prompt_choice", f"SELECT o_orderkey, {sql_pick('o_orderkey', 'in English', 'по-русски', 'any', 'any')} AS prompt FROM orders")
def prompt_choice(spark, sf_dir):
    known = {"English": "in English", "Russian": "по-русски"}
    return table(spark, sf_dir, "orders").select("o_orderkey", prompts.language_prompt(known, pick("o_orderkey", "ENGLISH", "russian", "Latin", None), "any").alias("prompt"))


@query(
    "cover_bands",
    """
    WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size / 50.0 END AS s, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS m FROM part)
    SELECT p_partkey, CASE WHEN m IS NULL OR coalesce(s, 0) < 0.2 THEN 'largest' WHEN s >= 0.6 THEN 'sure' ELSE 'fair' END AS how, CASE WHEN m IS NULL OR coalesce(s, 0) < 0.2 THEN 'big' ELSE m END AS cover FROM c
    """,
)
def cover_bands(spark, sf_dir):
    k = F.col("p_partkey")
    found = checks.cover_choice(F.when(k % 5 > 0, F.col("p_size") / 50.0), F.when(k % 7 > 0, F.col("p_name")), F.lit("big"))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in found.items()))


@query(
    "extraction_strategies",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS e, p_partkey % 40 AS n, p_partkey % 200 AS l FROM part)
    SELECT p_partkey, CASE WHEN coalesce(e, 0) > 0 THEN CASE WHEN n / e >= 0.9 THEN 'whole' ELSE 'by_contents' END WHEN n > 0 AND l > 100 THEN 'whole' ELSE 'by_segments' END AS strategy FROM p
    """,
)
def extraction_strategies(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", checks.extraction_strategy(F.when(k % 3 > 0, F.col("p_size")), k % 40, k % 200).alias("strategy"))


@query(
    "batch_decisions",
    f"""
    WITH b AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_orderkey // 4 % 2 AS w, {sql_pick("o_orderkey // 8", "true", "false", None)} AS r, o_orderkey // 24 % 2 AS d, o_orderkey // 48 % 2 AS p, o_orderkey // 96 % 2 AS f FROM orders)
    SELECT o_orderkey, CASE WHEN a = 0 OR w = 0 THEN 'extract' WHEN r IS NULL THEN 'annotate' WHEN r = 'false' THEN 'extract' WHEN d + p > 0 AND d + f > 0 THEN 'reuse' ELSE 'annotate' END AS decision FROM b
    """,
)
def batch_decisions(spark, sf_dir):
    n = lambda d, m: F.floor(F.col("o_orderkey") / d) % m
    rows = table(spark, sf_dir, "orders").withColumn("n", F.floor(F.col("o_orderkey") / 8))
    return rows.select("o_orderkey", checks.batch_decision(n(1, 4), n(4, 2), pick("n", "true", "false", None).cast("boolean"), n(24, 2), n(48, 2), n(96, 2)).alias("decision"))


# Files, caches and sessions


@query(
    "file_kinds",
    """
    WITH f AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'a.md' WHEN 1 THEN 'b.JSON' WHEN 2 THEN 'c.Png' WHEN 3 THEN 'd.htm' WHEN 4 THEN 'e.docx' WHEN 5 THEN 'f' ELSE 'g.tex' END AS p, p_partkey FROM part)
    SELECT CASE p WHEN 'a.md' THEN 'markdown' WHEN 'b.JSON' THEN 'json' WHEN 'c.Png' THEN 'image' WHEN 'd.htm' THEN 'html' WHEN 'e.docx' THEN 'docx' WHEN 'f' THEN 'other' ELSE 'latex' END AS kind, count(*) AS n, min(p_partkey || '/' || p) AS first_path FROM f GROUP BY 1
    """,
)
def file_kinds(spark, sf_dir):
    names = ("a.md", "b.JSON", "c.Png", "d.htm", "e.docx", "f", "g.tex")
    paths = table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit("/"), pick("p_partkey", *names)).alias("path"))
    return inventory(paths, examples=1).select("kind", "n", F.get("paths", F.lit(0)).alias("first_path"))


@query(
    "file_union",
    "SELECT 'pdf' AS kind, 'in/' || doc_id || '.pdf' AS path FROM documents UNION ALL SELECT 'docx', 'in/' || page_id || '.docx' FROM pages",
)
def file_union(spark, sf_dir):
    from quire.sources.files import union_kinds

    pdf = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), "doc_id", F.lit(".pdf")).alias("path"))
    docx = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), "page_id", F.lit(".docx")).alias("path"))
    return union_kinds({"pdf": pdf, "docx": docx})


@query(
    "batches_joined",
    """
    WITH r AS (SELECT user_id, event_id, event_id % 3 AS batch FROM events WHERE event_type <> 'error')
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY batch, event_id) AS INTEGER) AS number FROM r
    """,
)
def batches_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("batch"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("article"))
    return fragments.join_batches([rows.where("batch = 0"), rows.where("batch = 1"), rows.where("batch = 2")], ["user_id"], "batch", "event_id", "article").select("user_id", "event_id", "number")


@query(
    "cache_counts",
    f"""
    WITH c AS (SELECT o_custkey % 100 AS file, {sql_pick("o_orderkey", "done", "", "[llm_error]", "also")} AS t, {sql_pick("o_orderkey // 4", "<p/>", None, "")} AS f FROM orders)
    SELECT file, CAST(count_if(t IN ('done', 'also')) AS BIGINT) AS n_translations, CAST(count_if(coalesce(f, '') <> '') AS BIGINT) AS n_fragments FROM c GROUP BY file
    """,
)
def cache_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("n", F.floor(F.col("o_orderkey") / 4))
    cache = rows.select((F.col("o_custkey") % 100).alias("file"), pick("o_orderkey", "done", "", "[llm_error]", "also").alias("content_zh"), pick("n", "<p/>", None, "").alias("html"))
    return translate.cache_counts(cache, ["file"], "content_zh", "html")


@query(
    "fragment_totals",
    "SELECT source, count(*) AS n_fragments, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY source",
)
def fragment_totals(spark, sf_dir):
    return fragments.totals(table(spark, sf_dir, "documents"), ["source"], "text")


SESSION_TEXT = """'{"session_id": "s' || (o_custkey % 40) || '-' || o_orderkey || '", "files": ["in\\\\f' || o_orderkey || '.pdf", "in/none.pdf"], "file_progress": {"in/f' || o_orderkey || '.pdf": {"status": "x", "error": null, "issues": ["i"], "stages": {"extraction": ' || s || ', "translation": "failed"}}}}'"""


@query(
    "session_stages",
    f"""
    WITH s AS (SELECT *, {sql_pick("o_orderkey", '"completed"', '{"status": "processing", "completed_count": 1}')} AS s FROM orders),
    j AS (SELECT o_orderkey, {SESSION_TEXT} AS j FROM s)
    SELECT j->>'$.session_id' AS session_id, 'in/f' || o_orderkey || '.pdf' AS file, stage, CASE WHEN stage = 'translation' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'processing' END AS status
    FROM j, (VALUES ('extraction'), ('translation')) v(stage)
    """,
)
def session_stages(spark, sf_dir):
    """Sessions as json texts, a stage being a text or an object."""
    s = pick("o_orderkey", '"completed"', '{"status": "processing", "completed_count": 1}')
    rows = table(spark, sf_dir, "orders").withColumn("s", s).select(F.expr(SESSION_TEXT.replace("\\\\", "\\\\\\\\")).alias("json"))
    return progress.session_files(rows)[1]


STATES_SQL = """
    f AS (SELECT o_custkey % 50 AS session, o_orderkey AS file, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END AS issues, CASE WHEN o_orderkey % 5 = 0 THEN 'broke' END AS error FROM orders),
    v AS (SELECT o_orderkey AS file, i, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' WHEN o_orderkey % 4 = 1 THEN 'pending' WHEN o_orderkey % 11 = i THEN 'failed' WHEN o_orderkey % 13 = i THEN 'processing' WHEN o_orderkey % 4 = 2 AND i < o_orderkey % 9 THEN 'completed' ELSE 'pending' END AS status FROM orders, range(0, 11) r(i)),
    n AS (SELECT file, count_if(status = 'completed') AS c, count_if(status = 'failed') AS x, count_if(status = 'processing') AS p FROM v GROUP BY 1),
    st AS (SELECT session, file, issues, c, x, p, CASE WHEN c = 11 THEN 'completed' WHEN c + p > 0 THEN 'partial' WHEN error IS NOT NULL THEN 'failed' ELSE 'pending' END AS base, issues > 0 OR x > 0 AS flawed FROM f JOIN n USING (file)),
    s AS (SELECT session, file, c, x, p, CASE WHEN base IN ('completed', 'partial') THEN base || CASE WHEN flawed THEN '_with_issues' ELSE '_no_issues' END ELSE base END AS state FROM st)
"""


def file_states(spark, sf_dir):
    k, i = F.col("o_orderkey"), F.col("i")
    orders = table(spark, sf_dir, "orders")
    files = orders.select((F.col("o_custkey") % 50).alias("session"), k.alias("file"), F.when(k % 6 == 0, 2).otherwise(0).alias("n_issues"), F.when(k % 5 == 0, "broke").alias("error"))
    status = F.when(k % 4 == 0, "completed").when(k % 4 == 1, "pending").when(k % 11 == i, "failed").when(k % 13 == i, "processing").when((k % 4 == 2) & (i < k % 9), "completed").otherwise("pending")
    named = F.array(*map(F.lit, progress.STAGES))
    stages = orders.select("o_orderkey", "o_custkey", F.posexplode(named).alias("i", "stage")).select((F.col("o_custkey") % 50).alias("session"), k.alias("file"), "stage", status.alias("status"))
    return progress.file_rollup(files, stages, ["session", "file"])


@query("file_states", "WITH " + STATES_SQL + "SELECT session, file, state FROM s")
def file_states_query(spark, sf_dir):
    return file_states(spark, sf_dir).select("session", "file", "state")


@query(
    "progress_rollup",
    "WITH "
    + STATES_SQL
    + "SELECT session, count(*) AS n_files, "
    + ", ".join(f"CAST(count_if(state = '{s}') AS BIGINT) AS n_{s}" for s in progress.FILE_STATES)
    + """, CAST(count_if(state IN ('partial_no_issues', 'partial_with_issues', 'pending')) AS BIGINT) AS n_incomplete,
    round(100 * count_if(starts_with(state, 'completed')) / count(*), 4) AS percent, bool_and(state = 'completed_no_issues') AS done FROM s GROUP BY session""",
)
def progress_rollup(spark, sf_dir):
    return progress.session_rollup(file_states(spark, sf_dir), "session")


@query("files_to_resume", "WITH " + STATES_SQL + "SELECT session, file, CASE WHEN file % 8 = 1 THEN 'failed' WHEN c + x + p > 0 THEN 'unfinished' ELSE 'not_started' END AS why FROM s WHERE NOT starts_with(state, 'completed')")
def files_to_resume(spark, sf_dir):
    rows = file_states(spark, sf_dir).withColumn("status", F.when(F.col("file") % 8 == 1, "failed").otherwise("partial"))
    return progress.to_resume(rows).select("session", "file", "why")


@query(
    "stage_to_run",
    "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F')",
)
def stage_to_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    files = orders.select("o_custkey", "o_orderkey", F.concat(F.lit("in/"), "o_orderkey").alias("path"))
    stages = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.concat(F.lit("in\\"), "o_orderkey").alias("path"), F.lit("excel_original").alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return progress.unfinished(files, stages, ["o_custkey"], "path", "excel_original").select("o_orderkey")


@query(
    "setting_faults",
    """
    WITH s AS (SELECT p_partkey AS k, p_size AS n, p_retailprice AS r FROM part),
    f AS (
      SELECT k, 'error' AS severity, 'MAX_WORKERS' AS name FROM s WHERE n < 10 UNION ALL
      SELECT k, 'error', 'MAX_WORKERS' FROM s WHERE false UNION ALL
      SELECT k, 'warning', 'PAGES_PER_BATCH' FROM s WHERE n + 10 > 50 UNION ALL
      SELECT k, 'error', 'TITLE_SIMILARITY_THRESHOLD' FROM s WHERE r / 950 > 1 UNION ALL
      SELECT k, 'error', 'PDF_API_TIMEOUT' FROM s WHERE k % 4 < 2 UNION ALL
      SELECT k, 'error', 'HTML_API_KEY' FROM s WHERE k % 3 < 2 UNION ALL
      SELECT k, 'error', 'PDF_API_KEY' FROM s UNION ALL
      SELECT k, 'error', 'OVERLAP_PAGES' FROM s WHERE 30 >= n + 10)
    SELECT k, severity, name FROM f
    """,
)
def setting_faults(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    values = {
        "MAX_WORKERS": F.when(n < 10, (n - 10).cast("string")).otherwise(n.cast("string")), "PAGES_PER_BATCH": (n + 10).cast("string"), "OVERLAP_PAGES": F.lit("30"), "TITLE_SIMILARITY_THRESHOLD": (F.col("p_retailprice") / 950).cast("string"),
        "PDF_API_TIMEOUT": pick("p_partkey", "10", "10,0", "10,20.5", "1,1"), "HTML_API_KEY": pick("p_partkey", "", "your-api-key-here", "sk-1"), "TRANSLATION_API_KEY": F.lit("sk-2"),
    }
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).alias("name", "value"))
    return checks.setting_faults(rows, ["k"])


@query(
    "log_rows",
    """
    SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS kind, CASE WHEN event_type = 'error' THEN 'failed ' || user_id END AS error FROM events
    """,
)
def log_rows(spark, sf_dir):
    ok = F.col("event_type") != "error"
    row = metrics.log_row(ok, F.lit("request"), F.concat(F.lit("failed "), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", row.alias("r")).select("event_id", "r.ok", "r.kind", "r.error")


@query(
    "spacing_cleaned",
    """
    SELECT doc_id, '<h3>' || left(replace(replace(text, '<', ' '), chr(10), ' '), 30) || '</h3><p>b</p><br><ul><li>x</li></ul><p>y</p>' AS html FROM documents
    """,
)
def spacing_cleaned(spark, sf_dir):
    title = F.left(F.replace(F.replace("text", F.lit("<"), F.lit(" ")), F.lit("\n"), F.lit(" ")), F.lit(30))
    page = F.concat(F.lit("<h3>"), title, F.lit("</h3> <br/>\n<p> </p><div>&nbsp;</div><p>b</p><br><ul><li>x</li></ul>\n\n<p></p><p>y</p>"))
    return table(spark, sf_dir, "documents").select("doc_id", render.tight_spacing(page).alias("html"))


@query(
    "archive_reports",
    """
    SELECT p_partkey, '# ' || p_name || chr(10) || '- pages: ' || (p_size % 9) || chr(10) || '- markdown: ' || CASE WHEN p_size % 2 = 0 THEN '2 lines, ' || (length(p_name) + 2) || ' characters' ELSE 'none' END || chr(10) || '- json: ' || CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'none' END || chr(10) ||
           '- images: ' || (p_size % 4) || chr(10) || '- tables: ' || CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'no' END || chr(10) || '- formulas: no' AS report FROM part
    """,
)
def archive_reports(spark, sf_dir):
    from quire.operators.archive import report

    n = F.col("p_size")
    made = report(F.col("p_name"), n % 9, F.when(n % 2 == 0, F.concat("p_name", F.lit("\nx"))), F.when(n % 3 == 0, '[{"type": "table"}]'), n % 4)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("report"))


@query(
    "command_lines",
    """
    SELECT p_partkey, 'tool --files ' || p_name || ' --output out --qps ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' --glossary-files g.csv' ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN ' --no-dual' WHEN 1 THEN ' --no-mono --dual-translate-first --no-watermark' ELSE ' --dual-translate-first --no-watermark' END AS argv FROM part
    """,
)
def command_lines(spark, sf_dir):
    n = F.col("p_partkey")
    modes = F.when(n % 3 == 0, F.array(F.lit("translated_only"))).when(n % 3 == 1, F.array(F.lit("bilingual"))).otherwise(F.array(F.lit("bilingual"), F.lit("translated_only")))
    argv = translate.command("tool", F.col("p_name"), F.lit("out"), {"qps": F.col("p_size").cast("string")}, F.when(n % 2 == 0, "g.csv"), modes)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(argv, " ").alias("argv"))


@query(
    "covers_found",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a/' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'b/' || o_orderkey END AS cover FROM orders
    """,
)
def covers_found(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.select("o_orderkey", F.concat(F.lit("a/"), "o_orderkey").alias("first"), F.concat(F.lit("b/"), "o_orderkey").alias("second"))
    there = orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("a/"), "o_orderkey").alias("path")).union(orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("b/"), "o_orderkey").alias("path")))
    return images.first_existing(wanted, there, ["first", "second"], "cover").select("o_orderkey", "cover")


@query(
    "articles_or_placeholder",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '<p>' || o_orderkey || '</p>' ELSE '<div class="article missing">' || o_orderpriority || '</div>' END AS html, o_orderkey % 3 = 0 AS made FROM orders
    """,
)
def articles_or_placeholder(spark, sf_dir):
    html = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<p>"), "o_orderkey", F.lit("</p>"))).when(F.col("o_orderkey") % 3 == 1, " ")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), html.alias("html"))
    return render.or_placeholder(rows).select("o_orderkey", "html", "made")


@query(
    "translated_articles",
    """
    WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, doc_id % 3 AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 1 THEN NULL ELSE replace(title, 'e', '3') END AS title_zh, CASE WHEN n = 0 THEN 'article' ELSE 'fields' END AS how FROM t WHERE replace(title, 'e', '3') <> title AND regexp_replace(title, '\\s', '', 'g') <> ''
    """,
)
def translated_articles(spark, sf_dir):
    """Four fields in one call; where its answer lacks one, field by field; a client that fails on some titles."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    rows = rows.where((F.replace("title", F.lit("e"), F.lit("3")) != F.col("title")) & (F.regexp_replace("title", r"\s", "") != ""))
    out = translate.translate_articles(rows.select("doc_id", "title", F.lit("").alias("subtitle"), F.lit("").alias("authors"), (F.col("doc_id") % 3).cast("string").alias("content")), translate.article_stub, translate.field_stub)
    return out.select("doc_id", "title_zh", "how")


@query(
    "image_fields",
    """
    SELECT l_orderkey, string_agg(l_linenumber || ':' || replace(l_returnflag, 'N', 'no'), ',' ORDER BY l_linenumber, l_returnflag) AS images FROM lineitem GROUP BY l_orderkey
    """,
)
def image_fields(spark, sf_dir):
    image = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("description"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(image)).alias("images"))
    changed = placing.map_images(F.col("images"), lambda x: {"description": F.replace(x["description"], F.lit("N"), F.lit("no"))})
    return by.select("l_orderkey", F.array_join(F.transform(changed, lambda x: F.concat(x["n"], F.lit(":"), x["description"])), ",").alias("images"))


# Blocks, parts and calls


@query(
    "page_blocks",
    """
    WITH b AS (SELECT event_id, event_id % 5 AS n, event_type || ' <' || event_id || '>' AS t FROM events), e AS (SELECT *, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM b)
    SELECT event_id, CASE n WHEN 0 THEN '<h3>' || x || '</h3>' WHEN 1 THEN '<p>' || x || '</p>' WHEN 2 THEN '<ul><li>' || x || '</li><li>b</li></ul>' WHEN 3 THEN '<p>cap</p>' || t ELSE '<figure><img src="a.png"><figcaption>cap</figcaption></figure>' END AS html FROM e
    """,
)
def page_blocks(spark, sf_dir):
    n, t = F.col("event_id") % 5, F.concat("event_type", F.lit(" <"), "event_id", F.lit(">"))
    kind = F.when(n < 2, "text").when(n == 2, "list").when(n == 3, "table").otherwise("image")
    html = render.block(kind, t, F.when(n == 0, 2), F.array(t, F.lit("b")), F.lit("a.png"), F.lit("cap"))
    return table(spark, sf_dir, "events").select("event_id", html.alias("html"))


@query(
    "side_bars",
    """
    WITH t AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, n_name FROM nation)
    SELECT n_regionkey, count(*) AS n_articles, '<nav class="table-of-contents"><ul>' || string_agg('<li class="toc-item"><a href="#article-' || n || '">' || n_name || '</a></li>', '' ORDER BY n) || '</ul></nav>' AS side_bar FROM t GROUP BY n_regionkey
    """,
)
def side_bars(spark, sf_dir):
    return render.side_bar(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query(
    "merged_markdown",
    """
    SELECT conv_id, count(*) AS n_parts, string_agg(CASE WHEN turn % 4 < 3 AND trim(left(text, 60)) <> '' THEN trim(left(text, 60)) END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id
    """,
)
def merged_markdown(spark, sf_dir):
    from quire.operators.archive import merge_markdown

    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 < 3, F.left("text", F.lit(60))).alias("markdown"))
    return merge_markdown(parts, "conv_id", "turn", "markdown")


@query(
    "rekeyed_pages",
    """
    WITH p AS (SELECT event_id, user_id, event_id % 3 AS part, event_id % 7 AS page FROM events),
    s AS (SELECT user_id, part, max(page) + 1 AS n FROM p GROUP BY ALL),
    o AS (SELECT user_id, part, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
    SELECT event_id, CAST(page + off AS BIGINT) AS page FROM p JOIN o USING (user_id, part)
    """,
)
def rekeyed_pages(spark, sf_dir):
    from quire.operators.archive import rekey_pages

    pages = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("part"), (F.col("event_id") % 7).alias("page"))
    return rekey_pages(pages, "user_id", "part", "page").select("event_id", "page")


@query(
    "retry_decisions",
    """
    SELECT event_id, event_id % 5 < 3 AND event_id % 4 IN (0, 1, 2) AS every_kind, event_id % 5 < 3 AND event_id % 4 IN (0, 2) AS no_timeouts, least(0.5 * power(3, event_id % 6), 60) AS delay FROM events
    """,
)
def retry_decisions(spark, sf_dir):
    from quire.functions import numeric

    message, attempt = pick("event_id", "HTTP 503", "Request timed out", "network unreachable", "no such field"), F.col("event_id") % 5
    return table(spark, sf_dir, "events").select("event_id", numeric.should_retry(message, attempt, 3).alias("every_kind"), numeric.should_retry(message, attempt, 3, timeout=False).alias("no_timeouts"), numeric.engine_backoff(F.col("event_id") % 6 + 1, 0.5, 3.0).alias("delay"))


@query(
    "run_rates",
    """
    WITH s AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END AS s FROM orders)
    SELECT o_orderpriority, count(*) AS n, CAST(count_if(s = 'success') AS BIGINT) AS n_success, CAST(count_if(s = 'partial') AS BIGINT) AS n_partial, CAST(count_if(s = 'failed') AS BIGINT) AS n_failed,
           round(100 * count_if(s = 'success') / count(*), 4) AS percent_success, round(100 * count_if(s = 'partial') / count(*), 4) AS percent_partial, round(100 * count_if(s = 'failed') / count(*), 4) AS percent_failed FROM s GROUP BY o_orderpriority
    """,
)
def run_rates(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    return metrics.run_summary(table(spark, sf_dir, "orders").withColumn("status", status), ["o_orderpriority"], "status")


@query(
    "glossary_union",
    """
    WITH t AS (SELECT trim(p_name) AS source_term, p_brand AS target_term, 0 AS t, p_partkey AS o FROM part UNION ALL SELECT n_name, 'N' || n_nationkey, 1, n_nationkey FROM nation UNION ALL SELECT p_name, p_type, 2, p_partkey FROM part WHERE p_size = 7)
    SELECT source_term, arg_max(target_term, t * 1000000000 + o) AS target_term FROM t GROUP BY source_term
    """,
)
def glossary_union(spark, sf_dir):
    from quire.operators.glossary import read_glossaries

    part = table(spark, sf_dir, "part")
    sheets = [
        part.select(F.concat(F.lit(" "), "p_name").alias("English"), "p_brand", F.col("p_partkey").alias("row")),
        table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("N"), "n_nationkey").alias("x"), F.col("n_nationkey").alias("row")),
        part.where("p_size = 7").select(F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_partkey").alias("row")),
    ]
    return read_glossaries(sheets, "row").select("source_term", "target_term")


@query(
    "repaired_answers",
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS VARCHAR) END AS v FROM events",
)
def repaired_answers(spark, sf_dir):
    """A stand-in for a model closes what is open; other texts it cannot mend."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v": "'), "event_id", F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"v": "'), "event_id")).otherwise("no")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(jsonio.repaired(said, lambda t: t + '"}', "object", 1), "$.v").alias("v"))


@query(
    "gap_merge",
    r"""
    WITH RECURSIVE b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[.!?。！？]+\s*$', '') ELSE text END AS text FROM conversations),
    o AS (SELECT *, lead(text) OVER w AS after, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    n AS (SELECT *, coalesce((ends_with(regexp_replace(text, '\s+$', ''), '-') OR (trim(text) <> '' AND NOT regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?。！？]$'))) AND after <> '', false) AS goes FROM o),
    walk AS (
      SELECT conv_id, rn, goes AS opens FROM n WHERE rn = 1
      UNION ALL
      SELECT n.conv_id, n.rn, n.goes AND NOT walk.opens FROM walk JOIN n ON n.conv_id = walk.conv_id AND n.rn = walk.rn + 1),
    m AS (SELECT n.conv_id, n.turn, n.text, n.after, walk.opens, coalesce(lag(walk.opens) OVER (PARTITION BY n.conv_id ORDER BY n.rn), false) AS second FROM n JOIN walk USING (conv_id, rn))
    SELECT conv_id, turn, CASE WHEN opens THEN rtrim(text) || ' ' || ltrim(after) ELSE text END AS text, opens AS merged FROM m WHERE NOT second
    """,
)
def gap_merge(spark, sf_dir):
    """Blocks in columns that lie far apart: whatever has no sentence end goes on."""
    from quire.operators import layout

    cut = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r"[.!?。！？]+\s*$", "")).otherwise(F.col("text"))
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("text"), F.lit(100.0).alias("gap"))
    return layout.merge_adjacent(blocks, ["conv_id"], "turn", "text", "gap").select("conv_id", "turn", "text", "merged")


@query(
    "translated_images",
    """
    SELECT p_brand, string_agg(p_name || '>' || replace(p_name, 'e', '3') || '/' || replace(p_type, 'e', '3'), ',' ORDER BY p_partkey) AS images FROM part GROUP BY p_brand
    """,
)
def translated_images(spark, sf_dir):
    image = F.struct("p_partkey", F.col("p_name").alias("caption"), F.col("p_type").alias("description"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(image)).alias("images"))
    done = translate.translate_images(rows, "p_brand", "images", ("caption", "description"), translate.digit_client)
    return done.select("p_brand", F.array_join(F.transform("images", lambda x: F.concat(x["caption"], F.lit(">"), x["caption_zh"], F.lit("/"), x["description_zh"])), ",").alias("images"))


@query(
    "marked_stages",
    """
    WITH s AS (SELECT o_custkey, o_orderkey % 3 AS stage, CASE WHEN o_orderkey % 2 = 0 THEN 'in_progress' ELSE 'completed' END AS status, o_orderkey AS updated_at FROM orders)
    SELECT o_custkey, stage, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM s GROUP BY ALL
    """,
)
def marked_stages(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", (k % 3).alias("stage"), F.when(k % 2 == 0, "in_progress").otherwise("completed").alias("status"), k.alias("updated_at"))
    return progress.mark(rows.where("updated_at < 500"), rows.where("updated_at >= 500"), ["o_custkey"])
