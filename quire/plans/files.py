"""Queries that write tables as files of other formats into the shared folder and read these back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import text_documents, workbooks
from quire.sources.tables import table
from quire.streaming.parts import shared_folder


def issue(doc_id):
    return F.floor(doc_id / 40)


def issues(spark, sf_dir):
    """Each document as an article ``file, number, title, text``; a file has a source's documents of 40 ids."""
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Article "), F.col("doc_id"), F.lit(" "), F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60)))
    # A file's articles are numbered by their ids within 40 of them, which no window has to order.
    return docs.select(F.concat("source", F.lit("-"), issue(F.col("doc_id"))).alias("file"), (issue(F.col("doc_id")) % 3).alias("kind"), "doc_id", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def as_documents(articles):
    """``name, paragraphs``: headings of all articles in files of kind 0, of every other one in kind 1, bold titles alone in kind 2."""
    heading = (F.col("kind") == 0) | (F.col("kind") == 1) & (F.col("doc_id") % 2 == 0)
    title = F.struct(F.when(heading, "heading 1").alias("style"), (F.col("kind") == 2).alias("bold"), ((F.col("kind") == 1) & ~heading).alias("new_page"), F.col("title").alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit(None).cast("string").alias("style"), F.lit(False).alias("bold"), F.lit(False).alias("new_page"), t.alias("text")))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.array(title), lines).alias("p"))))
    return articles.groupBy(F.col("file").alias("name")).agg(F.flatten(F.transform(parts, lambda x: x["p"])).alias("paragraphs"))


@query(
    "text_documents",
    r"""
    WITH d AS (
      SELECT source || '-' || (doc_id // 40) AS file, (doc_id // 40) % 3 AS kind, doc_id, text,
             'Article ' || doc_id || ' ' || left(string_split(text, chr(10))[1], 60) AS title FROM documents),
    c AS (SELECT file, kind, count(*) AS n, count(*) FILTER (WHERE kind = 0 OR kind = 1 AND doc_id % 2 = 0) AS headed FROM d GROUP BY file, kind)
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY doc_id) AS INTEGER) AS number,
           regexp_replace(title, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS title, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS content,
           CASE WHEN kind = 2 THEN 'by_segments' WHEN headed >= n * 0.9 THEN 'whole' ELSE 'by_contents' END AS strategy
    FROM d JOIN c USING (file, kind)
    """,
)
def text_documents_back(spark, sf_dir):
    """All documents as articles of text documents, read back by whichever strategy a file's headings and contents list lead to."""
    folder = shared_folder(spark, "docx")
    articles = issues(spark, sf_dir)
    text_documents.write(as_documents(articles), folder)
    name = F.regexp_extract("path", r"([^/]+)\.docx$", 1)
    text_documents.read(spark, folder).withColumn("file", name).drop("path").write.parquet(f"{folder}-rows")  # the strategies ask for them several times
    rows = spark.read.parquet(f"{folder}-rows")
    contents = articles.where("kind != 2").select("file", "title")
    return text_documents.articles(rows, contents, file="file")


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("workbook_round_trip", "SELECT p_brand AS book, p_type AS sheet, p_partkey, p_name, p_brand, p_type, CAST(p_size AS INTEGER) AS p_size, p_retailprice FROM part")
def workbook_round_trip(spark, sf_dir):
    """Parts as workbooks, one for each brand with a sheet for each type, and back."""
    folder = shared_folder(spark, "xlsx")
    names = [c.split()[0] for c in PART.split(", ")]
    workbooks.write(table(spark, sf_dir, "part").select(names), folder, F.col("p_brand"), F.col("p_type"), ["p_partkey"])
    back = workbooks.typed(workbooks.read(spark, folder), PART)
    return back.select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("book"), "sheet", *names)


#: How the heads of the glossary query's workbooks name their languages, by folder.
HEADS = (("EN", "ZH"), ("english", "chinese"), ("source", "target"), ("x", "zh"))


@query(
    "workbook_glossary",
    """
    WITH t AS (
      SELECT p_size % 4 AS book, p_type AS sheet, p_partkey AS n, trim(p_name) AS source_term, p_brand || '-' || p_partkey AS target_term FROM part
      UNION ALL SELECT 4, 'nations', n_nationkey, n_name, 'region ' || n_regionkey FROM nation)
    SELECT source_term, arg_max(target_term, place) AS target_term
    FROM (SELECT *, row_number() OVER (ORDER BY book, sheet, n) AS place FROM t WHERE book <> 3) GROUP BY source_term
    """,
)
def workbook_glossary(spark, sf_dir):
    """Terms of several workbooks with several sheets and differently named heads; books of folder 3 name no source and give none."""
    folder = shared_folder(spark, "glossary")
    parts = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("book"), F.col("p_type").alias("sheet"), F.col("p_partkey").alias("n"), F.concat(F.lit(" "), "p_name").alias("s"), F.concat_ws("-", "p_brand", "p_partkey").alias("t"))
    nations = table(spark, sf_dir, "nation").select(F.lit("nations").alias("sheet"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("s"), F.concat(F.lit("region "), "n_regionkey").alias("t"))
    for k, (source, target) in enumerate(HEADS):
        pair = [F.col("s").alias(source), F.col("t").alias(target)]
        some = parts.where(F.col("book") == k).select("sheet", "n", *(pair[::-1] if k == 1 else pair))  # in book 1 the target stands first
        workbooks.write(some, f"{folder}/{k}", F.lit("terms"), F.col("sheet"), ["n"])
    workbooks.write(nations.select("n", F.col("s").alias("English"), F.col("t").alias("Chinese")), f"{folder}/4", F.lit("terms"), F.lit("nations"), ["n"])
    return workbooks.glossary(workbooks.read(spark, folder), ["en", "EN", "English", "english", "source"], ["zh", "ZH", "Chinese", "chinese", "target"])
