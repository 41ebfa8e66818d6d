"""Writers. What Spark has no format for goes through a renderer that the caller gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import scrub_controls


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended to a json-lines log, each with the time of writing."""
    df.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def write_articles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_glossary(df: DataFrame, path: str, language: str) -> None:
    df.select(F.col("source_term").alias("source"), F.col("target_term").alias("target"), F.lit(language).alias("tgt_lng")).write.mode("overwrite").option("header", "true").csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A table for spreadsheets: csv with a head and without characters that spreadsheets refuse."""
    clean = [scrub_controls(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(clean).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


#: A renderer takes html and gives a file's bytes (a browser, a converter); it may raise.
Renderer = Callable[[str], bytes]


def rendered(pages: DataFrame, renderer: Renderer, html: str = "html") -> DataFrame:
    """``pages`` with ``file`` and ``error``: what the renderer made of each page."""

    @F.pandas_udf("file binary, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                try:
                    out.append((renderer(t), None))
                except Exception as e:  # the renderer's errors become rows
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", "error"])

    return pages.withColumn("_r", run(F.col(html))).select(*pages.columns, "_r.file", "_r.error")


def save_if_changed(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Write a table as a new version unless its newest version has the same rows; say whether it wrote.

    A version is a folder of its own that is written under a trial name and renamed when it is whole, so that readers
    see the old or the new one, and a write that fails leaves none.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(root) if s.getPath().getName().startswith("version=")) if store.exists(root) else []
    if versions:
        old = spark.read.parquet(f"{path}/version={versions[-1]}")
        if set(old.columns) == set(df.columns):
            mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first()
            if mark(old) == mark(df):
                return False
    trial = jvm.org.apache.hadoop.fs.Path(f"{path}/_trial-{uuid.uuid4().hex}")
    df.sortWithinPartitions(*keys).write.parquet(trial.toString())
    if not store.rename(trial, jvm.org.apache.hadoop.fs.Path(f"{path}/version={versions[-1] + 1 if versions else 0}")):
        raise OSError(f"the new version of {path} could not be put in place")
    return True


def read_latest(spark, path: str) -> DataFrame:
    """A table's newest version."""
    return spark.read.parquet(path).where(F.col("version") == spark.read.parquet(path).agg(F.max("version")).first()[0]).drop("version")


def render_missing(pages: DataFrame, outputs: DataFrame, key: str, renderer: Renderer, html: str = "html") -> DataFrame:
    """rendered() for the pages alone of which ``outputs`` has none yet."""
    return rendered(pages.join(outputs.select(key).distinct(), key, "left_anti"), renderer, html)


def write_image_notes(images: DataFrame, path: str) -> None:
    """Images' properties and annotations as json lines."""
    images.write.mode("overwrite").json(path)
