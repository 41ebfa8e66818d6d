"""Failed work: logs, reconciliation, runs of failures, adaptive concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.layout import runs


def reconcile_failed(failed: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Failed texts with ``fixed``: the cache has a translation that is not blank and not the text itself."""
    known = cache.groupBy(key).agg(F.max_by("translated", "ord").alias("_t"))
    fixed = F.coalesce((F.trim("_t") != "") & (F.col("_t") != F.col("text")), F.lit(False))
    return failed.join(known, key, "left").withColumn("fixed", fixed).drop("_t")


def still_failed(log: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    return log.join(failed.select(key).distinct(), key, "left_semi")


def second_round(results: DataFrame, keys: list[str], attempts: str, most: int) -> DataFrame:
    """Keys to run again: those whose last result failed or is empty, with fewer than ``most`` tries."""
    w = Window.partitionBy(keys).orderBy(F.col(attempts).desc())
    last = results.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return last.where(((F.col("status") != "success") | (F.coalesce("n_items", F.lit(0)) == 0)) & (F.col(attempts) < most)).select(*keys, attempts)


def stopped_after(df: DataFrame, keys: list[str], order: str, bad: str, n: int = 3) -> DataFrame:
    """``stop``: the row at which ``n`` results on end were bad, the first of each group; null where that never was."""
    placed = runs(df, keys, order, F.col(bad) & F.coalesce(F.lag(bad).over(Window.partitionBy(keys).orderBy(order)), F.lit(False)))
    hit = F.when(F.col(bad) & (F.col("place") == n - 1), F.col(order))
    return placed.groupBy(keys).agg(F.min(hit).alias("stop"))


def largest_fit(sizes: DataFrame, keys: list[str], pages: str, size: str, limit: int) -> DataFrame:
    """The most pages of a file whose base64 size is within the limit: every three bytes take four."""
    return sizes.groupBy(keys).agg(F.max(F.when(F.ceil(F.col(size) / 3) * 4 <= limit, F.col(pages))).alias(pages))


def concurrency(log: DataFrame, key: str, order: str, start: int = 8, least: int = 1, most: int = 64, fall: float = 0.5, rise: float = 2.0, samples: int = 20, share: float = 0.9, wait: float = 30.0) -> DataFrame:
    """The limit of parallel calls after each call of a log (status, seconds).

    A 429 lowers it and counts for nothing else: the call is tried again, and counts when it ends. A success raises it if there
    were ``samples`` calls or more since the last rise, ``share`` of them good, and the last rise, or else the first call, is
    ``wait`` seconds past; rises, but not falls, begin the count and the time anew, and none is made at the upper limit. A
    state machine: a key's calls pass one task in order, by Arrow batches, and only the state is kept between them.
    """
    names = f"{key} long, {order} long, limit_now int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, limit, good, seen, changed = (), start, 0, 0, None
        for b in batches:
            out = []
            for k, status, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False).tolist(), strict=True):
                if k != last:
                    last, limit, good, seen, changed = k, start, 0, 0, at
                if status == 429:
                    limit = max(least, int(limit * fall))
                else:
                    seen, good = seen + 1, good + (status == 200)
                    if status == 200 and seen >= samples and good / seen >= share and at - changed >= wait and limit < most:
                        limit, seen, good, changed = min(most, int(limit * rise)), 0, 0, at
                out.append(limit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [key, order, "limit_now"])

    calls = log.select(F.col(key).cast("long"), F.col(order).cast("long"), "status", F.col("seconds").cast("double"))
    return calls.repartition(key).sortWithinPartitions(F.col(key), F.col(order).asc_nulls_last()).mapInArrow(run, names)


def limited(df: DataFrame, calls: int, call) -> DataFrame:
    """``df`` through ``call`` (an iterator of pandas frames to one) in at most ``calls`` tasks at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from call(parts)

    return df.coalesce(calls).mapInPandas(run, df.schema)


def assign_results(tasks: DataFrame, results: DataFrame, keys: list[str], order: str, item: list[str]) -> DataFrame:
    """``item, field, translated, text_ids``: results go to the tasks of the same keys and order, and a field's to its item.

    ``translated`` is an array in the order of the tasks: one entry, or as many as a list has; a merged block's is split
    afterwards by its parts' lengths. ``text_ids`` name the tasks in the log of failures.
    """
    zipped = tasks.join(results, [*keys, order])
    ids = F.concat(F.lit("page_"), F.col(keys[0]), F.lit("_task_"), F.col(order), F.lit("_"), F.col("field"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("translated").alias("t"), ids.alias("i"))))
    by = zipped.groupBy(*item, "field").agg(rows.alias("_r"))
    return by.select(*item, "field", F.transform("_r", lambda x: x["t"]).alias("translated"), F.transform("_r", lambda x: x["i"]).alias("text_ids"))
