"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import checkpointed


def salted(df: DataFrame, by: str, salts: int) -> DataFrame:
    """``df`` with a ``_salt`` that deals the rows of one key out by another column."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def for_each_salt(df: DataFrame, salts: int) -> DataFrame:
    """Each row of ``df``, which has one a key, once for every salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns u, v of type long); root is its component's least node.

    Alternating large-star and small-star rounds: each round joins the edges with every node's least neighbour, an
    aggregate that is combined before the shuffle; the edges of a hub are dealt to ``salts`` tasks. A round's
    result is checkpointed; rounds end when the edges stay the same. Self-loops and repeated edges are allowed.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted(both.where("v > u"), "v", salts).join(for_each_salt(least, salts), ["u", "_salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, "v", salts).join(for_each_salt(down, salts), ["u", "_salt"]).where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = checkpointed(small.union(down.select("u", F.col("m").alias("v"))).distinct())
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
