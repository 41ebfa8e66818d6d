"""What the operators of this subpackage share: tables, the shared folder, columns that are always there."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quire-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), where no folder is set as well."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give back to the system what a worker's earlier tasks have freed: its allocators would keep it for later ones."""
    pa.default_memory_pool().release_unused()
    trimmed = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trimmed:
        trimmed(0)


def slices(batches, rows: int = 1000):
    """Arrow batches cut to ``rows`` rows, so that few texts at a time are Python objects."""
    trim()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trim()


def named(col: str) -> Column:
    """A column by its name as it stands, dots included."""
    return F.col("`" + col.replace("`", "``") + "`")


def beside(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one, so that none can clash with those that stand beside it; ``select("row.*")`` brings them back."""
    return F.struct(*map(named, docs.columns)).alias("row")


def whole_text(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
