"""Queries that feed a table to a stream batch by batch and give what the stream has told by its end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import queue_table
from quire.sources.tables import table
from quire.streaming import parts


def part_messages(spark, sf_dir):
    """Events as messages of the parts of files: a user's events are a file's, in three parts, of which some errors are failures."""
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        (F.col("event_id") % 3).cast("int").alias("part"),
        F.lit(3).alias("n_parts"),
        F.when(failed, "failed").otherwise("done").alias("state"),
        F.concat(F.lit("part-"), F.col("event_id")).alias("path"),
        (10 * (F.col("event_id") % 3)).cast("int").alias("page_offset"),
        F.floor("value").alias("n_items"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def produced(messages, queue: str, commits: int) -> None:
    """The messages in the order of their time, in so many commits, and a last message that lets all files expire."""
    first, last = messages.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / commits
    for k in range(commits):
        low, high = first + k * step, first + (k + 1) * step
        some = messages.where((F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(k == commits - 1)))
        queue_table.append(some.repartitionByRange(2, "ts", "seq").sortWithinPartitions("ts", "seq"), queue)
    end = messages.sparkSession.range(1).select(*(F.lit(last + timedelta(days=365)).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema))
    queue_table.append(end, queue)


@query(
    "part_assembly",
    """
    WITH e AS (
      SELECT user_id AS file, event_id % 3 AS part, event_type = 'error' AND event_id % 5 = 0 AS bad, ts, event_id, CAST(floor(value) AS BIGINT) AS items,
             CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(pause) OVER (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS round FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY file, round, part ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY file, round ORDER BY ts, event_id) AS place, min(ts) OVER (PARTITION BY file, round) AS began FROM g),
    x AS (SELECT *, min(place) FILTER (WHERE bad) OVER (PARTITION BY file, round) AS fails FROM f WHERE nth = 1),
    r AS (
      SELECT file, round, began, any_value(fails) AS fails, max(part) FILTER (WHERE place = fails) AS failed_part,
             count(*) FILTER (WHERE place < coalesce(fails, place + 1)) AS n, coalesce(sum(items) FILTER (WHERE place < coalesce(fails, place + 1)), 0) AS n_items,
             coalesce(string_agg('part-' || event_id, ',' ORDER BY part) FILTER (WHERE place < coalesce(fails, place + 1)), '') AS paths FROM x GROUP BY file, round, began)
    SELECT file, began, CASE WHEN fails IS NOT NULL THEN 'failed' WHEN n = 3 THEN 'whole' ELSE 'expired' END AS status,
           CAST(n AS INTEGER) AS n_parts, CAST(n_items AS BIGINT) AS n_items, paths, CAST(failed_part AS INTEGER) AS failed_part FROM r
    """,
)
def part_assembly(spark, sf_dir):
    """A producer commits messages to a queue; a consumer polls it, two files at a time, and keeps a state for each file."""
    folder = parts.shared_folder(spark, "parts")
    messages = part_messages(spark, sf_dir)
    produced(messages, f"{folder}/queue", commits=4)
    stream = parts.assembled(queue_table.polled(spark, f"{folder}/queue", max_files=2), timedelta(hours=6))
    parts.run(stream, f"{folder}/files", f"{folder}/state")
    found = spark.read.schema(stream.schema).parquet(f"{folder}/files")
    return found.select("file", F.col("began").cast("timestamp_ntz").alias("began"), "status", "n_parts", "n_items", F.array_join("paths", ",").alias("paths"), "failed_part")
