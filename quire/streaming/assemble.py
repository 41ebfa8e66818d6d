"""Streams of parsed parts: a file is handed on when all its parts have come."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.streaming.parts import shared_folder


def parts_stream(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """Result files as a stream, ``max_files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def counted(parts: DataFrame, file: str, part: str) -> DataFrame:
    """For each file and part the number of items so far; state is a row per part."""
    return parts.groupBy(file, part).agg(F.count("*").alias("n"))


def assembled(counts: DataFrame, file: str, n_parts: int) -> DataFrame:
    """Files of which all parts have come."""
    return counts.groupBy(file).agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_items")).where(F.col("n_parts") == n_parts)


def latest_errors(events: DataFrame, key: str, ts: str, seconds: int = 5) -> DataFrame:
    """Of a key's events within the watermark the first one."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{seconds} seconds").dropDuplicatesWithinWatermark([key]).drop("_ts")


def hourly(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Counts by hour of event time; later rows than the watermark are dropped."""
    marked = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return marked.groupBy(*keys, F.window("_ts", "1 hour").alias("window")).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that a stream has now, run to its end into a table in memory, for small results."""
    name = f"quire_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def assemble_once(spark: SparkSession, path: str, file: Column, part: Column, n_parts: int) -> DataFrame:
    """The rows at ``path`` as a stream of parts (``file_no`` and ``part`` of each row), run to its end; files with all parts.

    Each micro-batch is counted and appended to a table in the shared folder, with its number, so that a batch that is run
    again replaces its rows and does not double them.
    """
    folder = shared_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    items = spark.readStream.schema(schema).parquet(path if path.endswith("/") or "*" in path else _parent_glob(path)).where(F.input_file_name().contains(path.rstrip("/").rsplit("/", 1)[-1]))
    parts = items.select(file.alias("file_no"), part.alias("part"))

    def keep(batch: DataFrame, number: int) -> None:
        counted(batch, "file_no", "part").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    parts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").groupBy("file_no", "part").agg(F.sum("n").alias("n"))
    return assembled(rows, "file_no", n_parts)


def _parent_glob(path: str) -> str:
    """A single file's folder with a pattern for it alone: streams read folders."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    return f"{folder}/{name[:-1]}[{name[-1]}]"
