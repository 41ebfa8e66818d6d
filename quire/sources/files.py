"""Files as tables: discovery, selection, output paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that hold no input.
NOT_INPUT = r"(^|/)(output|cache|__pycache__)(/|$)"


def discover(spark: SparkSession, folder: str, pattern: str, content: bool = False) -> DataFrame:
    """Files below a folder that match a pattern: ``path, folder, length, modificationTime`` (and content), in no input-free folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    columns = ["path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "length", "modificationTime", *(["content"] if content else [])]
    return found.where(~F.col("path").rlike(NOT_INPUT)).select(*columns).dropDuplicates(["path"])


def is_part(path: Column) -> Column:
    """Is a file a compressed copy or a part of another one, or does it lie among the parts of a split?"""
    return F.contains(path, F.lit("_part")) | F.endswith(path, F.lit("_compressed.pdf")) | F.contains(path, F.lit("temp_splits"))


def mirrored(path: Column, root: str, extension: str) -> Column:
    """The path of a file's output: the same folders below ``root``, another extension."""
    folder, name = F.regexp_extract(path, r"^(.*/)?([^/]*)$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.lit(f"{root}/"), folder, F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(f".{extension}"))


def selected(expression: str, n: int) -> list[int]:
    """Indices from 1 that an expression such as ``1,3-5`` or ``a`` (all) selects out of ``n``."""
    out: set[int] = set()
    for part in (p.strip().lower() for p in expression.split(",")):
        if part in ("a", "all"):
            return list(range(1, n + 1))
        low, _, high = part.partition("-")
        if low.isdigit() and (not high or high.isdigit()):
            out.update(range(int(low), int(high or low) + 1))
        elif part:
            raise ValueError(f"no selection: {part}")
    return sorted(k for k in out if 1 <= k <= n)


def select_rows(df: DataFrame, order: str, expression: str) -> DataFrame:
    """The rows that an expression selects by their number in order.

    Only as many rows as the highest number named are sorted, by a top-k and not by one task over all rows.
    """
    wanted = selected(expression, 1 << 30) if not {"a", "all"} & set(expression.lower().split(",")) else None
    if wanted is None:
        return df
    top = df.orderBy(order).limit(max(wanted, default=0))
    return top.withColumn("_i", F.row_number().over(Window.orderBy(order))).where(F.col("_i").isin(wanted)).drop("_i")


def json_lines_latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Rows of a json-lines log, the last one of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return spark.read.json(path).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_kinds(listings: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """``kind, path`` of several listings of files; a path that two of them have is one row, of the kind that comes first."""
    rows = [df.select(F.lit(k).alias("kind"), F.lit(n).alias("_n"), F.col(path).alias("path")) for n, (k, df) in enumerate(listings.items())]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    return every.groupBy("path").agg(F.min_by("kind", "_n").alias("kind")).select("kind", "path")


def newest_version(spark: SparkSession, *paths: str) -> DataFrame:
    """The newest version of the first of these tables that is there: final articles, say, or else merged ones."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(conf)
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        numbers = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        if numbers:
            return spark.read.parquet(f"{path}/version={max(numbers)}")
    raise FileNotFoundError(f"none of {paths} has a version")
