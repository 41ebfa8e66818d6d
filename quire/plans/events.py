"""Queries over ``events``: requests, images, runs of narrow images, content items, archive parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import jsonio, numeric
from quire.operators import images, layout, metrics
from quire.plans.registry import query
from quire.sources.tables import table


@query(
    "run_grouping",
    """
    WITH h AS (SELECT event_id, user_id, event_type IN ('click', 'view') AS h FROM events),
    f AS (SELECT *, h AND coalesce(lag(h) OVER w, false) AS goes FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f),
    g AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) // 4 AS INTEGER) AS group_no FROM r)
    SELECT event_id, group_no, h AND count(*) OVER (PARTITION BY user_id, run, group_no) >= 2 AS grouped FROM g
    """,
)
def run_grouping(spark, sf_dir):
    return layout.group_runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type").isin("click", "view")).select("event_id", "group_no", "grouped")


@query(
    "request_metrics",
    """
    WITH r AS (
      SELECT *, row_number() OVER (PARTITION BY event_type, value > 0 ORDER BY ts DESC, event_id DESC) AS recent FROM events),
    u AS (SELECT *, CASE WHEN value > 0 AND recent <= 100 THEN value END AS used FROM r)
    SELECT event_type, count(*) AS n, CAST(count_if(event_id % 7 <> 0) AS BIGINT) AS n_ok, round(count_if(event_id % 7 <> 0) / count(*), 6) AS success_rate, round(avg(used), 6) AS avg_latency,
           round(quantile_cont(used, 0.95), 6) AS p95, round(quantile_cont(used, 0.99), 6) AS p99 FROM u GROUP BY event_type
    """,
)
def request_metrics(spark, sf_dir):
    return metrics.request_metrics(table(spark, sf_dir, "events"), ["event_type"], F.col("event_id") % 7 != 0, "value", ["ts", "event_id"], last=100)


@query(
    "error_groups",
    """
    WITH m AS (SELECT 'request ' || event_type || ' of user ' || (user_id % 50) || ' failed' AS m FROM events),
    k AS (SELECT regexp_replace(m, '\\d+', '{n}', 'g') AS key, count(*) AS n FROM m GROUP BY 1)
    SELECT key, n FROM k ORDER BY n DESC, key LIMIT 10
    """,
)
def error_groups(spark, sf_dir):
    message = F.concat(F.lit("request "), "event_type", F.lit(" of user "), F.col("user_id") % 50, F.lit(" failed"))
    return metrics.error_groups(table(spark, sf_dir, "events").withColumn("message", message), "message")


@query(
    "error_rate_limit",
    """
    WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (
      SELECT user_id, event_id, us, r, us AS lst, true AS shown, 0 AS hidden FROM n WHERE r = 1
      UNION ALL
      SELECT n.user_id, n.event_id, n.us, n.r, CASE WHEN n.us - f.lst >= 36000000000 THEN n.us ELSE f.lst END, n.us - f.lst >= 36000000000, CASE WHEN f.shown THEN 0 ELSE f.hidden END + CASE WHEN n.us - f.lst >= 36000000000 THEN 0 ELSE 1 END
      FROM f JOIN n ON n.user_id = f.user_id AND n.r = f.r + 1)
    SELECT event_id, shown, CASE WHEN shown THEN CAST(hidden AS BIGINT) END AS n_suppressed FROM f
    """,
)
def error_rate_limit(spark, sf_dir):
    return metrics.suppressed(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 36000).select("event_id", "shown", "n_suppressed")


@query(
    "progress_eta",
    """
    WITH p AS (
      SELECT event_id, count(*) OVER w AS done, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, done, CASE WHEN s > 0 THEN round((1000 - done) / (done / s), 0) END AS eta FROM p
    """,
)
def progress_eta(spark, sf_dir):
    out = metrics.progress(table(spark, sf_dir, "events"), ["user_id"], "ts", 1000, "event_id")
    return out.select("event_id", "done", F.round("eta_seconds", 0).alias("eta"))


@query(
    "retry_backoff",
    """
    SELECT event_id, least(2 * power(2, least(event_id % 12, 10)), 60) AS delay,
           CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS retryable FROM events
    """,
)
def retry_backoff(spark, sf_dir):
    k = F.col("event_id") % 4
    message = F.when(k == 0, "429 Too Many Requests").when(k == 1, "401 Unauthorized").when(k == 2, "connection reset").otherwise("no such field")
    return table(spark, sf_dir, "events").select("event_id", numeric.backoff(F.col("event_id") % 12).alias("delay"), numeric.is_retryable(message).alias("retryable"))


@query("type_distribution", "SELECT event_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY event_type")
def type_distribution(spark, sf_dir):
    return metrics.shares(table(spark, sf_dir, "events"), "event_type")


@query(
    "archive_merge",
    """
    WITH p AS (SELECT event_id, user_id, event_id % 3 AS part, CAST(event_id % 10 AS INTEGER) AS page_idx, event_type = 'view' AS is_image FROM events),
    o AS (SELECT user_id, part, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT user_id, part, max(page_idx) + 1 AS n FROM p GROUP BY ALL)),
    j AS (SELECT p.*, off FROM p JOIN o USING (user_id, part))
    SELECT event_id, CAST(page_idx + off AS BIGINT) AS page_idx, CASE WHEN is_image THEN sum(CASE WHEN is_image THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY part, event_id) - 1 END AS image_no FROM j
    """,
)
def archive_merge(spark, sf_dir):
    from quire.operators.archive import merge_parts

    parts = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("part"), (F.col("event_id") % 10).cast("int").alias("page_idx"), (F.col("event_type") == "view").alias("is_image"))
    return merge_parts(parts, "user_id", "part", "event_id").select("event_id", "page_idx", "image_no")


@query(
    "image_dedup",
    """
    SELECT user_id, name, event_id FROM (
      SELECT user_id, event_id, event_type || CAST(floor(value) AS INTEGER) AS name,
             row_number() OVER (PARTITION BY user_id, event_type || CAST(floor(value) AS INTEGER) ORDER BY CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END DESC, event_id) AS r FROM events) WHERE r = 1
    """,
)
def image_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("name", F.concat("event_type", F.floor("value").cast("int").cast("string")))
    score = images.annotation_score(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, "a"))
    return images.best_of_each(rows, ["user_id", "name"], score, "event_id").select("user_id", "name", "event_id")


@query(
    "llm_response_extract",
    """
    WITH r AS (SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k=' || k WHEN 1 THEN 'v=' || k END AS content, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'max_tokens' END AS finish_reason,
           CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' ELSE 'error' END AS status FROM r
    """,
)
def llm_response_extract(spark, sf_dir):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    one = F.concat(F.lit('{"choices": [{"message": {"content": "k='), k, F.lit('"}, "finish_reason": "stop"}]}'))
    two = F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": "v='), k, F.lit('"}]}, "finishReason": "MAX_TOKENS"}]}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n == 0, one).when(n == 1, two).otherwise('{"error": {"code": 1}}').alias("r"))
    return rows.select("event_id", *(c.alias(k) for k, c in jsonio.answer_content(F.col("r")).items()))


@query(
    "status_maps",
    """
    SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
    """,
)
def status_maps(spark, sf_dir):
    by = metrics.counts_map(table(spark, sf_dir, "events"), ["user_id"], "event_type", "m")
    return by.select("user_id", F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("counts"))


@query(
    "stream_parse_assemble",
    """
    WITH p AS (SELECT user_id % 100 AS file_no, event_id % 4 AS part, count(*) AS n FROM events GROUP BY ALL)
    SELECT file_no, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS n_items FROM p GROUP BY file_no HAVING count(*) = 4
    """,
)
def stream_parse_assemble(spark, sf_dir):
    """The events as a stream of parts; a file is assembled when its parts are all there."""
    from quire.streaming.assemble import assemble_once

    return assemble_once(spark, f"{sf_dir}/events.parquet", F.col("user_id") % 100, F.col("event_id") % 4, n_parts=4)


@query(
    "windowed_requests",
    """
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL
    """,
)
def windowed_requests(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    by = table(spark, sf_dir, "events").groupBy("event_type", F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return by.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query(
    "call_groups",
    "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS INTEGER) AS group_no FROM events",
)
def call_groups(spark, sf_dir):
    return images.groups_of(table(spark, sf_dir, "events"), ["user_id"], "event_id", 10).select("event_id", "group_no")


@query(
    "stale_outputs",
    """
    WITH f AS (SELECT user_id, max(ts) AS newest FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, max(ts) AS made FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT user_id FROM p JOIN f USING (user_id) WHERE newest > made + INTERVAL 5 SECONDS
    """,
)
def stale_outputs(spark, sf_dir):
    from quire.operators.progress import stale

    events = table(spark, sf_dir, "events")
    made = events.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("made"))
    return stale(made, events.where("event_type = 'view'"), "user_id", "made", "ts").select("user_id")


