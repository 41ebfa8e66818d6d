"""Queries over ``conversations`` (a conversation stands for a page of text blocks) and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup, text
from quire.operators import layout
from quire.plans.registry import query
from quire.sources.tables import table

#: The pattern of a page's nodes as an SQL string.
NODE_SQL = "'" + markup.NODE.replace("'", "''") + "'"

PAGE = ["conv_id"]


@query(
    "neighbor_context",
    """
    SELECT conv_id, turn, right(lag(text) OVER w, 500) AS before, left(lead(text) OVER w, 500) AS after
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    """,
)
def neighbor_context(spark, sf_dir):
    return layout.neighbours(table(spark, sf_dir, "conversations"), PAGE, "turn", "text").select("conv_id", "turn", "before", "after")


#: Blocks without their end marks on every other turn, so that some go on.
CUT_SQL = r"""
    b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[.!?,;:]+\s*$', '') ELSE lower(left(text, 1)) || substr(text, 2) END AS text FROM conversations),
    o AS (
      SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM b),
    f AS (
      SELECT *, coalesce((ends_with(trim(text), '-') OR (NOT regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?。！？,;:]$') AND trim(text) <> '' AND regexp_matches(regexp_replace(after, '^\s+', ''), '^\p{Ll}'))) AND after <> '', false) AS goes FROM o)
"""


def cut_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations")
    cut = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r"[.!?,;:]+\s*$", "")).otherwise(F.concat(F.lower(F.left("text", F.lit(1))), F.substring("text", 2, 1 << 30)))
    return blocks.select("conv_id", "turn", "role", cut.alias("text"))


@query(
    "adjacent_merge",
    "WITH RECURSIVE "
    + CUT_SQL
    + r""",
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM f),
    walk AS (
      SELECT conv_id, rn, goes AS opens FROM n WHERE rn = 1
      UNION ALL
      SELECT n.conv_id, n.rn, n.goes AND NOT walk.opens FROM walk JOIN n ON n.conv_id = walk.conv_id AND n.rn = walk.rn + 1),
    m AS (SELECT n.conv_id, n.turn, n.text, n.after, walk.opens, coalesce(lag(walk.opens) OVER (PARTITION BY n.conv_id ORDER BY n.rn), false) AS second FROM n JOIN walk USING (conv_id, rn))
    SELECT conv_id, turn, CASE WHEN opens THEN rtrim(text) || ' ' || ltrim(after) ELSE text END AS text, opens AS merged FROM m WHERE NOT second
    """,
)
def adjacent_merge(spark, sf_dir):
    return layout.merge_adjacent(cut_blocks(spark, sf_dir), PAGE, "turn", "text").select("conv_id", "turn", "text", "merged")


@query(
    "translation_validity",
    r"""
    WITH p AS (
      SELECT conv_id, turn, text AS original, CASE turn % 5 WHEN 1 THEN left(text, 20) WHEN 2 THEN text WHEN 3 THEN ' [Truncated] ' || text WHEN 4 THEN '{"error": {"code": 1}}' ELSE lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS translated FROM conversations),
    s AS (SELECT *, regexp_replace(translated, '^\s+|\s+$', '', 'g') AS t, regexp_replace(original, '^\s+|\s+$', '', 'g') AS o FROM p)
    SELECT conv_id, turn, CASE WHEN translated IS NULL OR translated = '' OR regexp_matches(translated, '(?i)^\s*\{\s*["'']error["'']|"error"\s*:\s*\{') THEN 'error'
        WHEN t = '' THEN 'empty' WHEN regexp_matches(translated, '(?i)\[truncated\]') THEN 'incomplete' WHEN t = o THEN 'identical' WHEN starts_with(original, t) THEN 'prefix' END AS problem,
      length(original) - length(replace(original, '@', '')) >= 2 OR (length(original) - length(replace(original, 'http', ''))) / 4 >= 2 OR length(original) - length(replace(original, '$', '')) >= 3 AS is_structured,
      starts_with(o, '©') OR starts_with(o, 'BY:') OR contains(original, 'All rights reserved') AS is_copyright
    FROM s
    """,
)
def translation_validity(spark, sf_dir):
    from pyspark.sql import Window

    own = F.col("text")
    answer = (
        F.when(F.col("turn") % 5 == 1, F.left(own, F.lit(20)))
        .when(F.col("turn") % 5 == 2, own)
        .when(F.col("turn") % 5 == 3, F.concat(F.lit(" [Truncated] "), own))
        .when(F.col("turn") % 5 == 4, '{"error": {"code": 1}}')
        .otherwise(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    )
    rows = table(spark, sf_dir, "conversations").withColumn("translated", answer)
    kinds = text.translation_kind(own)
    return rows.select("conv_id", "turn", text.translation_problem(own, F.col("translated")).alias("problem"), kinds["is_structured"].alias("is_structured"), kinds["is_copyright"].alias("is_copyright"))


@query(
    "translation_cleanup",
    r"""
    WITH t AS (
      SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Translation: ' || text WHEN 1 THEN '"' || text || '"' WHEN 2 THEN '译文：「' || text || '」' ELSE '  ' || text || '  ' END AS t FROM conversations),
    p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^译文[：:]\s*', ''), '(?i)^Translation[:\s]+', '') AS t FROM t),
    q AS (SELECT conv_id, turn, CASE WHEN length(t) > 1 AND starts_with(t, '"') AND ends_with(t, '"') THEN substr(t, 2, length(t) - 2) ELSE t END AS t FROM p),
    r AS (SELECT conv_id, turn, CASE WHEN length(t) > 1 AND starts_with(t, '「') AND ends_with(t, '」') THEN substr(t, 2, length(t) - 2) ELSE t END AS t FROM q)
    SELECT conv_id, turn, regexp_replace(t, '^\s+|\s+$', '', 'g') AS cleaned FROM r
    """,
)
def translation_cleanup(spark, sf_dir):
    own, k = F.col("text"), F.col("turn") % 4
    dirty = F.when(k == 0, F.concat(F.lit("Translation: "), own)).when(k == 1, F.concat(F.lit('"'), own, F.lit('"'))).when(k == 2, F.concat(F.lit("译文：「"), own, F.lit("」"))).otherwise(F.concat(F.lit("  "), own, F.lit("  ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_translation(dirty).alias("cleaned"))


@query(
    "layout_render",
    r"""
    WITH r AS (
      SELECT conv_id, turn, CASE WHEN role = 'system' THEN '<h2>' || e || '</h2>' WHEN role = 'user' THEN '<p>' || e || '</p>' ELSE '<li>' || e || '</li>' END AS part
      FROM (SELECT conv_id, turn, role, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM conversations))
    SELECT conv_id, count(*) AS n_blocks, string_agg(part, chr(10) ORDER BY turn) AS html FROM r GROUP BY conv_id
    """,
)
def layout_render(spark, sf_dir):
    from quire.operators.render import escape, joined

    body = escape(F.col("text"))
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
    part = F.when(F.col("role") == "system", wrap("h2")).when(F.col("role") == "user", wrap("p")).otherwise(wrap("li"))
    rows = table(spark, sf_dir, "conversations").withColumn("part", part)
    return joined(rows, PAGE, "turn", "part", "html", "\n").withColumnRenamed("n_articles", "n_blocks")


@query(
    "translation_tasks",
    """
    WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' AND text <> '')
    SELECT conv_id, turn, 'page_' || conv_id || '_task_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '_text' AS task_id FROM t
    """,
)
def translation_tasks(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    lists = {c: none for c in ("list_items", "image_caption", "image_footnote", "table_caption", "table_footnote")}
    items = table(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "system", "footer").otherwise("text")).withColumns(lists)
    return layout.tasks(items, PAGE, "turn").select("conv_id", "turn", "task_id")


@query(
    "split_back",
    """
    WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
    j AS (SELECT *, a || ' ' || b AS whole, CAST(floor((length(a) + 1 + length(b)) * length(a) / (length(a) + length(b))) AS INTEGER) AS n FROM t WHERE b IS NOT NULL AND length(a) + length(b) > 0)
    SELECT conv_id, turn, trim(left(whole, n)) AS head, trim(substr(whole, n + 1)) AS tail FROM j
    """,
)
def split_back(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null and length(text) + length(b) > 0")
    head, tail = layout.split_back(F.col("text"), F.col("b"), F.concat("text", F.lit(" "), "b"))
    return rows.select("conv_id", "turn", head.alias("head"), tail.alias("tail"))


@query(
    "html_strip",
    r"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<aside\b.*?</aside>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<script\b.*?</script>', '', 'g') AS html,
      contains(html, '<') AND contains(html, '>') AND regexp_matches(html, '(?i)<(p|div|span|h[1-6]|ul|ol|li|table|article|section)\b') AS valid FROM pages
    """,
)
def html_strip(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.without_elements(html, ("aside", "nav", "script")).alias("html"), text.is_html(html).alias("valid"))


@query(
    "css_injection",
    """
    SELECT page_id, CASE WHEN contains(html, '</style>') AND NOT contains(html, '.quire') THEN replace(left(html, instr(html, '</style>') - 1) || '.quire{color:red}' || substr(html, instr(html, '</style>')), '', '') ELSE html END AS html FROM pages
    """,
)
def css_injection(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.inject_css(F.col("html"), ".quire{color:red}", ".quire").alias("html"))


@query(
    "word_mask",
    f"""
    SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, {NODE_SQL}), lambda x: CASE WHEN starts_with(x, '<') AND x <> '<' THEN x ELSE regexp_replace(x, '(?i)onti|the', '***', 'g') END), '') AS html FROM pages
    """,
)
def word_mask(spark, sf_dir):
    """Words masked in the texts of all pages; tags, attributes, scripts, styles and comments stay as they are."""
    return table(spark, sf_dir, "pages").select("page_id", markup.map_text(F.col("html"), lambda x: text.mask_words(x, ["the", "onti"])).alias("html"))


@query(
    "page_nodes",
    f"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, {NODE_SQL}) AS nodes FROM pages),
    r AS (SELECT page_id, unnest(nodes) AS node, unnest(range(len(nodes))) AS n FROM t),
    g AS (SELECT *, lower(regexp_extract(node, '^</?([A-Za-z][^\\s/>]*)', 1)) AS tag FROM r),
    k AS (SELECT *, CASE WHEN NOT starts_with(node, '<') OR node = '<' THEN 'text' WHEN starts_with(node, '</') THEN 'close' WHEN tag IN ('', 'script', 'style') THEN 'other'
            WHEN tag IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') OR ends_with(node, '/>') THEN 'void' ELSE 'open' END AS kind FROM g)
    SELECT page_id, CAST(n AS INTEGER) AS n, CAST(1 + coalesce(sum(length(node)) OVER w, 0) AS BIGINT) AS begin, kind, nullif(tag, '') AS tag, CAST(coalesce(sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER w, 0) AS BIGINT) AS depth, node
    FROM k WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
)
def page_nodes(spark, sf_dir):
    """All nodes of all pages as rows."""
    return markup.node_rows(table(spark, sf_dir, "pages"), ["page_id"], "html")


@query(
    "output_paths",
    r"""
    SELECT page_id, 'out/' || regexp_extract(p, '^(.*/)?([^/]*)$', 1) || regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[^.]*$', '') || '.html' AS path, contains(p, '_part') OR ends_with(p, '_compressed.pdf') OR contains(p, 'temp_splits') AS skipped
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'temp_splits/' ELSE '' END || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 4 WHEN 1 THEN '_compressed.pdf' ELSE '' END AS p FROM pages)
    """,
)
def output_paths(spark, sf_dir):
    from quire.sources.files import is_part, mirrored

    n = F.col("page_id") % 4
    path = F.concat(F.when(n == 0, "temp_splits/").otherwise(""), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.when(n == 1, "_compressed.pdf").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", mirrored(path, "out", "html").alias("path"), is_part(path).alias("skipped"))
