"""Request metrics and log summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import error_key


def request_metrics(df: DataFrame, keys: list[str], ok: Column, latency: str, order: list[str], last: int = 1000) -> DataFrame:
    """Counts, success rate, and mean, p95 and p99 of the last ``last`` latencies above zero, by linear interpolation."""
    counts = df.groupBy(keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"))
    # The last ones of a key are among the last ones of its salted parts, so no task sorts a whole key.
    newest = [F.col(c).desc() for c in order]
    salted = df.where(F.col(latency) > 0).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*newest))).where(F.col("_r") <= last)
    used = some.withColumn("_r", F.row_number().over(Window.partitionBy(keys).orderBy(*newest))).where(F.col("_r") <= last)
    times = used.groupBy(keys).agg(
        F.round(F.avg(latency), 6).alias("avg_latency"),
        F.round(F.percentile(latency, F.lit(0.95)), 6).alias("p95"),
        F.round(F.percentile(latency, F.lit(0.99)), 6).alias("p99"),
    )
    return counts.join(times, keys, "left")


def counts_map(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A map from value to count for each group."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return by.groupBy(keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "_n")))).alias(name))


def shares(df: DataFrame, column: str) -> DataFrame:
    """``column, n, percent`` of all rows."""
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def error_groups(df: DataFrame, message: str, top: int = 10) -> DataFrame:
    """The ``top`` message groups by count, numbers masked: ``key, n``, ties by key."""
    return df.select(error_key(F.col(message)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def suppressed(df: DataFrame, key: str, ts: str, order: str, seconds: float = 5) -> DataFrame:
    """``key, order, shown, n_suppressed``: a row is shown if it comes ``seconds`` or more after the last *shown* one of its key.

    ``n_suppressed`` counts the rows of the key that were hidden since then. The clock moves at shown rows only, so a key's rows
    pass one task in order, by Arrow batches, and only the state is kept between them. Keys and orders are longs.
    """
    names = f"{key} long, {order} long, shown boolean, n_suppressed long"
    gap = round(seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, hidden = (), None, 0
        for b in batches:
            shown, counts = [], []
            for k, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    now, last, hidden = k, None, 0
                if last is None or at - last >= gap:
                    shown.append(True)
                    counts.append(hidden)
                    last, hidden = at, 0
                else:
                    shown.append(False)
                    counts.append(None)
                    hidden += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shown), pa.array(counts, pa.int64())], [key, order, "shown", "n_suppressed"])

    rows = df.select(F.col(key).cast("long"), F.col(order).cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).where("_at is not null")
    return rows.repartition(key).sortWithinPartitions(key, "_at", order).mapInArrow(run, names)


def progress(df: DataFrame, keys: list[str], ts: str, total: int, order: str) -> DataFrame:
    """Done so far, rate and remaining seconds at each event of a group; events of one time go by ``order``."""
    w = Window.partitionBy(keys).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.col(ts).cast("timestamp").cast("double") - F.min(F.col(ts)).over(w).cast("timestamp").cast("double")
    out = df.withColumn("done", F.count("*").over(w)).withColumn("rate", F.when(seconds > 0, F.count("*").over(w) / seconds))
    return out.withColumn("eta_seconds", (total - F.col("done")) / F.col("rate"))


def log_row(ok: Column, request: Column, error: Column) -> Column:
    """A row of the request log as a struct: when, whether it went well, what was asked, and the error if it did not."""
    return F.struct(F.current_timestamp().alias("timestamp"), ok.alias("ok"), F.when(ok, "success").otherwise("error").alias("kind"), request.alias("request"), F.when(~ok, error).alias("error"))


def run_summary(df: DataFrame, keys: list[str], status: str, states: tuple[str, ...] = ("success", "partial", "failed")) -> DataFrame:
    """``n``, and for each state its number and percentage."""
    n = lambda s: F.count_if(F.col(status) == s)
    return df.groupBy(keys).agg(F.count("*").alias("n"), *(n(s).alias(f"n_{s}") for s in states), *(F.round(100 * n(s) / F.count("*"), 4).alias(f"percent_{s}") for s in states))
