"""Queries over orders, lineitem, part, labels and the small tables: images, covers, progress, references, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import numeric
from quire.operators import images, matching, progress, table_matching, tables
from quire.plans.registry import query
from quire.sources.tables import table


@query(
    "interval_match",
    """
    WITH r AS (SELECT o_custkey % 500 AS file, o_orderkey AS article, CAST(o_orderkey % 40 AS INTEGER) AS s, CAST(o_orderkey % 40 + o_orderkey % 6 AS INTEGER) AS e FROM orders),
    p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 500 AS file, CAST(l_partkey % 48 AS INTEGER) AS page FROM lineitem),
    c AS (SELECT l_orderkey, l_linenumber, article, CASE WHEN page BETWEEN s AND e THEN 1.0 ELSE 0.5 END AS score FROM p JOIN r USING (file) WHERE page BETWEEN s - 1 AND e + 1)
    SELECT l_orderkey, l_linenumber, article, CAST(score AS DOUBLE) AS score FROM c
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY score DESC, article) = 1
    """,
)
def interval_match(spark, sf_dir):
    key = F.col("o_orderkey")
    ranges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("file"), key.alias("article"), (key % 40).cast("int").alias("s"), (key % 40 + key % 6).cast("int").alias("e"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 500).alias("file"), (F.col("l_partkey") % 48).cast("int").alias("page"))
    return matching.match_pages(points, ranges, "file", "page", "s", "e", "article", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "article", "score")


@query(
    "scored_match",
    """
    WITH b AS (SELECT item_id, text, left(text, 30) AS anchor, item_id % 20 AS file FROM benchmark),
    d AS (SELECT doc_id, text, CAST(substr(source, 4) AS BIGINT) AS file FROM documents),
    c AS (SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 100 ELSE 0 END + CASE WHEN contains(d.text, b.anchor) THEN 50 ELSE 0 END + CASE WHEN item_id % 7 BETWEEN doc_id % 5 AND doc_id % 5 + 1 THEN 10 ELSE 0 END AS score FROM b JOIN d USING (file))
    SELECT item_id, doc_id, CAST(score AS INTEGER) AS score FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1
    """,
)
def scored_match(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("caption"), (F.col("item_id") % 20).alias("file"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.substring("source", 4, 9).cast("long").alias("file"))
    none = F.lit(None).cast("string")
    points = matching.evidence(F.col("caption"), F.col("body"), none, F.col("caption"), F.col("item_id") % 7, F.col("doc_id") % 5, F.col("doc_id") % 5 + 1)
    return matching.best_scored(items.join(docs, "file").withColumn("score", points.cast("int")), ["item_id"], "score", "doc_id").select("item_id", "doc_id", "score")


@query(
    "ref_validation",
    """
    WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 11 > 0 THEN l_partkey END AS img, CAST(l_linenumber * 3 AS INTEGER) AS page FROM lineitem),
    i AS (SELECT p_partkey AS img, CAST(p_size AS INTEGER) AS ipage FROM part WHERE p_partkey % 4 <> 0),
    j AS (SELECT r.*, ipage, min(CASE WHEN abs(page - ipage) <= 3 THEN seq END) OVER (PARTITION BY img) AS taken FROM r LEFT JOIN i USING (img))
    SELECT seq, CASE WHEN img IS NULL THEN 'format' WHEN ipage IS NULL THEN 'missing' WHEN taken IS NOT NULL AND seq > taken THEN 'repeated' WHEN abs(page - ipage) > 3 THEN 'page' ELSE 'accepted' END AS verdict FROM j
    """,
)
def ref_validation(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_partkey") % 11 > 0, F.col("l_partkey")).alias("img"), (F.col("l_linenumber") * 3).cast("int").alias("ref_page"))
    known = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("img"), F.col("p_size").alias("page"))
    return images.check_references(refs, known, "img", "seq", "page", "ref_page").select("seq", "verdict")


@query(
    "undescribed_images",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)",
)
def undescribed_images(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return images.undescribed(table(spark, sf_dir, "part").select("p_partkey"), refs, "p_partkey")


@query(
    "best_cover",
    """
    SELECT p_brand, arg_min(p_partkey, rn) AS cover FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * round(p_retailprice) DESC, p_partkey) AS rn FROM part) GROUP BY p_brand
    """,
)
def best_cover(spark, sf_dir):
    score = images.cover_score(F.col("p_size"), F.round("p_retailprice"))
    return images.best_of_each(table(spark, sf_dir, "part"), ["p_brand"], score, "p_partkey").select("p_brand", F.col("p_partkey").alias("cover"))


QUALITY = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'webp' ELSE 'png' END AS form, p_size * 1024 AS size, p_size * 20 AS w, CAST(p_retailprice / 3 AS DOUBLE) AS h, (p_partkey % 10) / 10.0 AS rich FROM part"


def pictures(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 5 == 0, "webp").otherwise("png").alias("form"), (size * 1024).alias("size"), (size * 20).alias("w"), (F.col("p_retailprice") / 3).alias("h"), ((key % 10) / 10.0).alias("rich")
    )


@query(
    "quality_filter",
    f"""
    WITH i AS ({QUALITY}),
    r AS (SELECT coalesce(CASE WHEN form NOT IN ('jpg', 'jpeg', 'png') THEN 'format' WHEN size < 10240 THEN 'size' WHEN w < 400 OR h < 300 THEN 'dimensions' WHEN rich < 0.2 THEN 'richness' END, 'kept') AS reason FROM i)
    SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY reason
    """,
)
def quality_filter(spark, sf_dir):
    return images.reason_counts(pictures(spark, sf_dir), images.strict_reason(*map(F.col, ("form", "size", "w", "h", "rich"))))


@query(
    "loose_filter",
    f"""
    WITH i AS ({QUALITY})
    SELECT p_partkey, CASE WHEN size < 51200 THEN 'size' WHEN w < 100 OR h < 100 THEN 'dimensions' WHEN h = 0 OR w / h < 0.1 OR w / h > 10 THEN 'aspect' WHEN rich < 0.1 THEN 'richness' END AS reason,
           CASE WHEN w / h < 0.6 THEN 'narrow' WHEN w / h > 1.8 THEN 'wide' ELSE 'normal' END AS layout,
           w / 900 >= 0.9 AND h / 600 >= 0.9 AND w * h / 540000 >= 0.81 AND abs(w / h - 1.5) <= 0.1 AS full_page FROM i
    """,
)
def loose_filter(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    return pictures(spark, sf_dir).select(
        "p_partkey", images.loose_reason(F.col("size"), w, h, F.col("rich")).alias("reason"), numeric.layout(w, h).alias("layout"), images.is_full_page(w, h, F.lit(900.0), F.lit(600.0)).alias("full_page")
    )


@query(
    "relative_position",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN round(least(1, greatest(0, (l_quantity + l_quantity + 10) / 2 / 50)), 4) ELSE 0.5 END AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(y AS DOUBLE) AS y, CASE WHEN y < 0.33 THEN 'top' WHEN y > 0.67 THEN 'bottom' ELSE 'middle' END AS v, CASE WHEN y < 0.33 THEN 'start' WHEN y > 0.67 THEN 'end' ELSE 'middle' END AS place FROM p
    """,
)
def relative_position(spark, sf_dir):
    low = F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))
    y = numeric.relative_position(low, low + 10, F.lit(50.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", y.alias("y")).withColumn("v", numeric.vertical(F.col("y")))
    return rows.withColumn("place", numeric.insert_position(F.col("v")))


STAGE_SQL = """
    s AS (SELECT o_custkey % 50 AS session, l_orderkey AS file, l_linenumber AS stage, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'failed' WHEN l_returnflag = 'N' THEN 'completed' ELSE 'pending' END AS status
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def stages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "failed").when(F.col("l_returnflag") == "N", "completed").otherwise("pending")
    return lines.select((F.col("o_custkey") % 50).alias("session"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("stage"), status.alias("status"))


@query(
    "stage_state",
    """
    SELECT l_orderkey AS file, l_returnflag AS stage, arg_max(l_linenumber, l_linenumber) AS completed_count, 7 AS total_count, round(arg_max(l_linenumber, l_linenumber) / 7, 4) AS progress FROM lineitem GROUP BY ALL
    """,
)
def stage_state(spark, sf_dir):
    updates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("stage"), F.col("l_linenumber").alias("completed_count"), F.lit(7).alias("total_count"))
    return progress.with_ratio(progress.latest(updates, ["file", "stage"], "completed_count"))


@query("remaining_files", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def remaining_files(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return progress.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    "worklists",
    """
    WITH h AS (SELECT l_orderkey AS k, list_distinct(list(CASE l_linenumber % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'docx' END)) AS have FROM lineitem GROUP BY 1),
    m AS (SELECT o_orderkey, list_sort(list_filter(['docx', 'html', 'parsed', 'pdf'], lambda x: have IS NULL OR NOT list_contains(have, x))) AS missing FROM orders LEFT JOIN h ON o_orderkey = k)
    SELECT o_orderkey, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'complete' WHEN list_contains(missing, 'parsed') THEN 'parse' WHEN list_contains(missing, 'html') THEN 'translate' ELSE 'format' END AS next FROM m
    """,
)
def worklists(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(k == 0, "parsed").when(k == 1, "html").when(k == 2, "pdf").otherwise("docx").alias("form"))
    files = table(spark, sf_dir, "orders").select("o_orderkey")
    return progress.worklist(progress.missing_outputs(files, have, "o_orderkey", "form", ["docx", "html", "parsed", "pdf"])).withColumn("missing", F.array_join("missing", ","))


@query(
    "reconcile_stages",
    "WITH " + STAGE_SQL + "SELECT session, file, stage, CASE WHEN status = 'completed' AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = file) THEN 'pending' ELSE status END AS status FROM s",
)
def reconcile_stages(spark, sf_dir):
    outputs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"))
    return progress.reconcile(stages(spark, sf_dir), outputs, ["file"]).select("session", "file", "stage", "status")


@query(
    "markdown_table",
    """
    SELECT r_name, '| ' || 'key' || ' | ' || 'name' || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
)
def markdown_table(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    by = joined.groupBy("r_name").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), rows).alias("rows"))
    return by.select("r_name", tables.markdown(F.col("rows")).alias("markdown"))


@query(
    "table_continuation",
    """
    WITH t AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS page, CAST(3 + o_orderkey % 2 AS INTEGER) AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'Table' ELSE '' END AS caption FROM orders),
    g AS (SELECT *, coalesce(page = lag(page) OVER w + 1 AND caption = '' AND abs(n - lag(n) OVER w) <= 1, false) AS goes FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    h AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS head FROM g)
    SELECT o_custkey, min(o_orderkey) AS o_orderkey, CAST(count(*) AS INTEGER) AS n_parts, CAST(count(*) + 1 AS INTEGER) AS n_rows FROM h GROUP BY o_custkey, head
    """,
)
def table_continuation(spark, sf_dir):
    k = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (k % 3).cast("int").alias("page"), (3 + k % 2).cast("int").alias("n_columns"), F.when(k % 5 == 0, "Table").otherwise("").alias("caption"), F.array(F.lit("head"), k.cast("string")).alias("rows"))
    return tables.continue_tables(found, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "n_parts", F.size("rows").alias("n_rows"))


@query(
    "title_match",
    """
    WITH a AS (SELECT c_nationkey AS file, c_mktsegment AS t, min(c_custkey) AS article_idx FROM customer GROUP BY ALL)
    SELECT s_suppkey, article_idx FROM supplier LEFT JOIN a ON file = s_nationkey AND t = CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'NONE' END
    """,
)
def title_match(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("NONE").alias("name"))
    articles = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("title"), "c_custkey")
    return matching.match_title(rows, articles, "file", "name", "title", "c_custkey").select("s_suppkey", "article_idx")


@query(
    "annotation_join",
    """
    SELECT p_partkey, d AS note FROM part LEFT JOIN (SELECT l_partkey, arg_max(CAST(l_shipdate AS VARCHAR), l_orderkey * 10 + l_linenumber) AS d FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
    """,
)
def annotation_join(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("note"))
    return matching.annotate(table(spark, sf_dir, "part").select("p_partkey"), notes, ["p_partkey"], "o", ["note"])


@query(
    "glossary_scan",
    """
    SELECT p_brand AS source_term, arg_max(trim(p_type), p_partkey) AS target_term FROM part WHERE trim(p_brand) <> '' AND trim(p_type) <> '' GROUP BY 1
    """,
)
def glossary_scan(spark, sf_dir):
    from quire.operators.glossary import read_glossary

    raw = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("English"), F.concat("p_type", F.lit(" ")).alias("Chinese"), "p_partkey")
    return read_glossary(raw, "p_partkey").select("source_term", "target_term")


@query(
    "file_selection",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i IN (1, 3, 4, 5, 9)",
)
def file_selection(spark, sf_dir):
    from quire.sources.files import select_rows

    return select_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "1,3-5,9")


@query(
    "split_sizes",
    """
    SELECT p_partkey, CASE WHEN p_retailprice <= 1200 THEN p_size ELSE CAST(greatest(1, floor(p_size * 1200 / p_retailprice * 0.9)) AS INTEGER) END AS pages FROM part
    """,
)
def split_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numeric.split_pages(F.col("p_size"), F.col("p_retailprice"), 1200.0).alias("pages"))


#: Documents as articles with a place for a table in them, and a table for each document: captions and anchors are words of its text.
TABLES_SQL = r"""
    a AS (SELECT doc_id AS article, source AS file, regexp_replace(text, '([a-z]+) (?:the|le|der|el) ([a-z]+)', '[TABLE: \1 \2]') AS content, doc_id % 50 AS first_page, coalesce(nullif(doc_id % 50 + doc_id % 4, 0), 9999) AS last_page FROM documents),
    w AS (SELECT doc_id AS n, source AS file, (doc_id * 7) % 50 AS page, regexp_split_to_array(text, '\s+') AS words, text FROM documents),
    t AS (SELECT n, file, page, CASE n % 4 WHEN 0 THEN 'Table ' || page || '. ' || array_to_string(words[4:8], ' ') WHEN 1 THEN 'Table 1: ' || coalesce(words[3], '') WHEN 2 THEN 'TABLE 2 ' || coalesce(words[6], '') || ' ' || coalesce(words[7], '') ELSE '' END AS caption, substr(text, 41, 60) AS anchor FROM w)
"""


def tables_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key, n = F.col("doc_id"), F.col("doc_id") % 4
    place = r"([a-z]+) (?:the|le|der|el) ([a-z]+)"  # only the first becomes a placeholder
    first = F.regexp_extract("text", place, 0)
    at = F.position(first, F.col("text"))
    mark = F.concat(F.lit("[TABLE: "), F.regexp_extract("text", place, 1), F.lit(" "), F.regexp_extract("text", place, 2), F.lit("]"))
    content = F.when(first == "", F.col("text")).otherwise(F.concat(F.substring("text", 1, at - 1), mark, F.substring("text", at + F.length(first), F.length("text"))))
    articles = docs.select(F.col("source").alias("file"), key.alias("article"), content.alias("content"), (key % 50).alias("start_page"), (key % 50 + key % 4).alias("end_page"))
    words, page = F.split("text", r"\s+", 9), key * 7 % 50  # eight of them are read
    word = lambda i: F.coalesce(F.get(words, F.lit(i - 1)), F.lit(""))
    caption = F.when(n == 0, F.concat(F.lit("Table "), page, F.lit(". "), F.array_join(F.slice(words, 4, 5), " "))).when(n == 1, F.concat(F.lit("Table 1: "), word(3))).when(n == 2, F.concat(F.lit("TABLE 2 "), word(6), F.lit(" "), word(7))).otherwise("")
    found = docs.select(F.col("source").alias("file"), key.alias("n"), page.alias("page"), caption.alias("caption"), F.substring("text", 41, 60).alias("anchor_before"), F.concat(F.lit("| "), key, F.lit(" |")).alias("markdown"))
    return articles, found


@query(
    "tables_matched",
    f"""
    WITH {TABLES_SQL},
    k AS (SELECT *, lower(trim(regexp_replace(caption, '^(?:Table|TABLE|表)\\s*\\d+[\\.\\:。]?\\s*', ''))) AS said, CASE WHEN length(anchor) > 10 THEN lower(trim(left(anchor, 30), ' ' || chr(10) || chr(9) || chr(13))) ELSE '' END AS snippet FROM t),
    p AS (SELECT n, article, page BETWEEN first_page AND last_page AS on_page, caption, said, snippet, lower(content) AS body, list_transform(regexp_extract_all(content, '(?is)\\[TABLE:[^\\]]*\\]'), lambda x: lower(x)) AS marks FROM k JOIN a USING (file)),
    s AS (SELECT n, article, CASE WHEN length(caption) > 5 AND said <> '' AND contains(body, said) THEN 100 ELSE 0 END
        + CASE WHEN length(caption) > 5 AND len(list_filter(marks, lambda m: len(list_filter(string_split_regex(said, '\\s+'), lambda x: length(x) > 3 AND contains(m, x))) > 0)) > 0 THEN 80 ELSE 0 END
        + CASE WHEN caption = '' AND contains(body, '[table:') AND on_page THEN 30 ELSE 0 END + CASE WHEN snippet <> '' AND contains(body, snippet) THEN 50 ELSE 0 END + CASE WHEN on_page THEN 10 ELSE 0 END AS score FROM p)
    SELECT n, article, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, article) = 1
    """,
)
def tables_matched(spark, sf_dir):
    """A table for each document, matched to all documents of its source."""
    articles, found = tables_of_documents(spark, sf_dir)
    return table_matching.match_tables(found, articles, "file", "n", "article").select("n", "article", "score")


@query("tables_injected")
def tables_injected(spark, sf_dir):
    """All documents with the tables that belong to them in their texts; tests hold it against a plain version."""
    articles, found = tables_of_documents(spark, sf_dir)
    matched = table_matching.match_tables(found, articles, "file", "n", "article")
    return table_matching.inject_tables(articles, found, matched, "n", "article").select("article", "content")
