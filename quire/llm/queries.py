"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import counts, crf, decontaminate, idfiles, langid, mainhtml, merkle, packing, simhash, suffix, toxicity, urls, whitening
from quire.llm.base import table

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    FOUND[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query
def op1_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.judged(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query
def op2_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL["op4_decontamination"] = """
    WITH d AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, w[1] = '' AS blank
      FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents)),
    i AS (
      SELECT item_id, len(w) AS m, least(13, len(w)) AS width, unnest(w) AS word, generate_subscripts(w, 1) AS p
      FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
    l AS (
      SELECT 'd' AS side, doc_id AS id, p, word AS w0, lead(word, 1) OVER r AS w1, lead(word, 2) OVER r AS w2, lead(word, 3) OVER r AS w3, lead(word, 5) OVER r AS w5, lead(word, 6) OVER r AS w6, lead(word, 7) OVER r AS w7 FROM d WINDOW r AS (PARTITION BY doc_id ORDER BY p)
      UNION ALL
      SELECT 'i', item_id, p, word, lead(word, 1) OVER r, lead(word, 2) OVER r, lead(word, 3) OVER r, lead(word, 5) OVER r, lead(word, 6) OVER r, lead(word, 7) OVER r FROM i WINDOW r AS (PARTITION BY item_id ORDER BY p)),
    k AS (
      SELECT side, id, p, unnest([w0 || ' ' || w1 || ' ' || w3 || ' ' || w5 || ' ' || w6, '1 ' || w0 || ' ' || w1 || ' ' || w2 || ' ' || w5 || ' ' || w7, '2 ' || w0 || ' ' || w2 || ' ' || w3 || ' ' || w6 || ' ' || w7]) AS h FROM l),
    s AS (
      SELECT a.id AS doc_id, b.id AS item_id, a.p - b.p AS shift FROM k a JOIN k b USING (h) WHERE a.side = 'd' AND b.side = 'i'
      UNION SELECT doc_id, item_id, d.p - i.p FROM d JOIN i USING (word) WHERE m < 11),
    e AS (
      SELECT s.doc_id, s.item_id, shift, i.p, m, width, CASE WHEN d.word = i.word THEN 1 ELSE 0 END AS eq, d.word IS NOT NULL AS inside
      FROM s JOIN i USING (item_id) LEFT JOIN d ON d.doc_id = s.doc_id AND d.p = shift + i.p),
    v AS (
      SELECT *, sum(eq) OVER f AS n, count_if(inside) OVER f AS n_inside FROM e
      WINDOW f AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
    t AS (
      SELECT doc_id, item_id, shift, any_value(m) AS m, sum(eq) AS n_equal FROM v GROUP BY ALL HAVING bool_or(n_inside = width AND n >= ceil(width * 0.8))),
    o AS (
      SELECT t.*, shift - (SELECT CAST(bool_or(blank) AS INTEGER) FROM d WHERE d.doc_id = t.doc_id) AS first_token FROM t)
    SELECT doc_id, item_id, CAST(any_value(m) AS BIGINT) AS n_tokens, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(arg_max(first_token, n_equal * 1000000000 - first_token) AS BIGINT) AS token_start FROM o GROUP BY doc_id, item_id
"""


@query
def op4_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


#: Fixed values of the url query: rules that come first, and sites that are blocked where no rule fits.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BLOCKED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_URLS = {f"{site}.example.{top}": "block" for site in BLOCKED_SITES for top in ("com", "net", "org")}

SQL["op5_url_list"] = """
    WITH r AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    k(h, start, says) AS (
      VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    f AS (
      SELECT page_id, host, path, arg_max(h || start, length(h || start)) AS rule, arg_max(says, length(h || start)) AS says
      FROM p LEFT JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY ALL)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IS NOT NULL THEN says
                WHEN regexp_matches(host, '(^|[.])(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$') THEN 'block'
                ELSE 'allow' END AS verdict
    FROM f
"""


@query
def op5_url_list(spark, sf_dir):
    lists = [spark.createDataFrame([*keys.items()], "key string, verdict string") for keys in (URL_RULES, BLOCKED_URLS)]
    found = urls.judged(table(spark, sf_dir, "pages"), lists)
    rule = F.when(F.col("list") == 0, F.col("rule"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))


@query
def op6_main_html(spark, sf_dir):
    found = mainhtml.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_id_files(spark, sf_dir):
    files = idfiles.write(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)
    return idfiles.read(files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_simhash(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_suffix_array(spark, sf_dir):
    found = suffix.removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op11_merkle"] = """
    WITH RECURSIVE f AS (
      SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS own,
             CASE WHEN 0 = 7 * (c // 7) - c THEN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] END AS other
      FROM (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                      lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS c
            FROM documents)),
    leaves AS (
      SELECT doc_id, lang, sha256(array_to_string(list_transform(own, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf,
             sha256(array_to_string(list_transform(coalesce(other, own), lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS said FROM f),
    nodes(level, lang, pos, n, h) AS (
      SELECT 0, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT), CAST(count(*) OVER (PARTITION BY lang) AS BIGINT), leaf FROM leaves
      UNION ALL
      SELECT level + 1, lang, CAST(pos // 2 AS BIGINT), CAST((n + 1) // 2 AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 2, n),
    subroots AS (SELECT level AS top, lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS m FROM nodes WHERE n = 1),
    tops(level, pos, n, h) AS (
      SELECT 0, CAST(rank AS BIGINT), CAST(m AS BIGINT), subroot FROM subroots
      UNION ALL
      SELECT level + 1, CAST(pos // 2 AS BIGINT), CAST((n + 1) // 2 AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
    steps(level, group_of, lang, pos, is_right, beside) AS (
      SELECT a.level, 0, a.lang, a.pos, a.pos % 2 = 1, b.h FROM nodes a LEFT JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND xor(a.pos, 1) = b.pos WHERE a.n > 1
      UNION ALL
      SELECT a.level, 1, NULL, a.pos, a.pos % 2 = 1, b.h FROM tops a LEFT JOIN tops b ON a.level = b.level AND xor(a.pos, 1) = b.pos WHERE a.n > 1),
    placed AS (
      SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos0, top, subroot, rank FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
    up(doc_id, lang, leaf, subroot, rank, pos, group_of, level, proof, fold) AS (
      SELECT doc_id, lang, leaf, subroot, CAST(rank AS BIGINT), CAST(pos0 AS BIGINT), CASE WHEN top = 0 THEN 1 ELSE 0 END, 0, '', said FROM placed
      UNION ALL
      SELECT doc_id, u.lang, leaf, u.subroot, u.rank,
             CASE WHEN u.group_of = 0 AND u.level + 1 = s.top THEN u.rank ELSE CAST(u.pos // 2 AS BIGINT) END,
             CASE WHEN u.group_of = 0 AND u.level + 1 = s.top THEN 1 ELSE u.group_of END,
             CASE WHEN u.group_of = 0 AND u.level + 1 = s.top THEN 0 ELSE u.level + 1 END,
             proof || coalesce(beside, ''), sha256(CASE WHEN is_right THEN beside || fold ELSE fold || coalesce(beside, '') END)
      FROM up u JOIN subroots s ON u.rank = s.rank JOIN steps t ON t.group_of = u.group_of AND t.level = u.level AND t.pos = CASE WHEN u.group_of = 1 AND u.level = 0 THEN u.rank ELSE u.pos END
        AND (u.group_of = 1 OR t.lang IS NOT DISTINCT FROM u.lang)),
    ends AS (SELECT max(level) AS last, arg_max(h, level) AS root FROM tops)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM up, ends WHERE group_of = 1 AND level = last
"""


@query
def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)")
    found = merkle.proofs(docs, {"n_chars": F.when(marked, more + 1).otherwise(more).cast("decimal(20,0)")})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors)).withColumnRenamed("id", "vec_id")


@query
def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.train(docs))
