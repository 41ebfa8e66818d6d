"""The queue and the assembly of parts: restarts, repeated commits, admission and expiry."""

import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quire.plans.streams import part_assembly, part_messages, produced
from quire.sources import queue_table
from quire.streaming import parts

D = "/root/testdata/sf0.001"
T = datetime.datetime(2024, 5, 1)


def at(minutes):
    return T + datetime.timedelta(minutes=minutes)


def messages(spark, rows):
    """(file, part, n_parts, state, minute) as messages."""
    return spark.createDataFrame([(f, p, n, s, f"{f}/{p}", p and 10 * p, 5, at(m), k) for k, (f, p, n, s, m) in enumerate(rows)], parts.PART).coalesce(1)


def told(spark, folder):
    rows = spark.read.schema(parts.RESULT).parquet(f"{folder}/files").collect()
    return sorted((r.file, r.began, r.status, r.n_parts, r.n_items, ",".join(r.paths), r.failed_part) for r in rows)


def test_a_commit_that_runs_again_adds_nothing(spark, tmp_path):
    folder = queue_table.Folder(f"file://{tmp_path}/q")
    schema = spark.range(1).schema
    assert folder.commits() == [] and queue_table.QueueTable({"path": folder.path}).streamReader(schema).latestOffset() == {"commits": 0, "files": 0}
    with pytest.raises(ValueError, match="no commit"):
        queue_table.QueueTable({"path": folder.path}).schema()
    for _ in range(2):
        folder.commit("w", "7", [queue_table.Written(["data/a.parquet"]), None, queue_table.Written([])], schema)
    assert len(folder.commits()) == 1 and folder.files(folder.commits()[0]) == ["data/a.parquet"]


def test_batches_append_and_what_no_commit_lists_is_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    odd = spark.createDataFrame([(1, None, [1, None], {"a": 1.5}, T), (None, "é", None, None, None)], "i long, s string, a array<int>, m map<string,double>, t timestamp")
    queue_table.append(odd, path)
    queue_table.append(odd.limit(0), path)
    queue_table.append(spark.range(5).select(F.col("id").alias("i"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema.fields[1:])), path)
    stray = queue_table.QueueTable({"path": path}).writer(odd.schema, False)
    lost = stray.write(iter(odd.toArrow().to_batches()))
    back = queue_table.committed(spark, path)
    assert back.schema.simpleString() == odd.schema.simpleString()
    assert sorted(map(str, back.where("s is not null or a is not null").collect())) == sorted(map(str, odd.collect())) and back.count() == 7
    stray.abort([lost, None])
    assert {f"data/{os.path.basename(f)}" for f in glob.glob(f"{tmp_path}/q/data/*")} == {p.name for p in queue_table.QueueTable({"path": path}).reader(None).partitions()}
    with pytest.raises(ValueError, match="appended"):
        queue_table.QueueTable({"path": path}).writer(odd.schema, True)


def test_polls_admit_some_files_at_a_time(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    for k in range(3):
        queue_table.append(spark.range(10 * k, 10 * k + 10, numPartitions=3), path)
    source = queue_table.QueueTable({"path": path, "maxFiles": "2"})
    seen, before = [], {"commits": 0, "files": 0}
    while (now := source.streamReader(None).latestOffset()) != before:  # each poll by a new reader, as after a restart
        names = source.streamReader(None).partitions(before, now)
        assert 0 < len(names) <= 2
        seen += names
        before = now
    assert [p.name for p in seen] == [p.name for p in source.reader(None).partitions()] and len(seen) == 9
    stream = queue_table.polled(spark, path, max_files=4, reader="other")
    parts.run(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))
    queue_table.append(spark.range(30, 33), path)
    parts.run(queue_table.polled(spark, path, max_files=4, reader="other"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(33))


def test_a_stream_writes_to_a_queue(spark, tmp_path):
    spark.range(20).repartition(2).write.parquet(f"{tmp_path}/in")
    spark.dataSource.register(queue_table.QueueTable)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        query = stream.writeStream.format(queue_table.NAME).option("path", f"file://{tmp_path}/q").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.id for r in queue_table.committed(spark, f"file://{tmp_path}/q").collect()) == list(range(20))
    assert len(os.listdir(f"{tmp_path}/q/commits")) == 2


def test_files_whole_failed_and_expired(spark, tmp_path):
    first = [(1, 1, 2, "done", 0), (2, 0, 3, "done", 1), (3, 0, 1, "done", 2), (4, 0, 2, "done", 3), (1, 1, 2, "done", 4), (5, 2, 3, "done", 5)]
    second = [(1, 0, 2, "done", 30), (2, 1, 3, "failed", 31), (2, 2, 3, "done", 32), (3, 0, 1, "failed", 33), (6, 0, 2, "failed", 34), (6, 0, 2, "done", 35)]
    third = [(4, 1, 2, "done", 80), (3, 0, 1, "done", 200)]  # file 4 was silent for too long: it begins anew
    end = [(None, None, None, None, 5000)]
    for rows in (first, second, third, end):
        queue_table.append(messages(spark, rows), f"file://{tmp_path}/q")
    stream = parts.assembled(queue_table.polled(spark, f"file://{tmp_path}/q", max_files=1), datetime.timedelta(hours=1))
    parts.run(stream, f"{tmp_path}/files", f"{tmp_path}/state")
    assert told(spark, tmp_path) == sorted(
        [
            (1, at(0), "whole", 2, 10, "1/0,1/1", None),
            (2, at(1), "failed", 1, 5, "2/0", 1),
            (3, at(2), "whole", 1, 5, "3/0", None),
            (3, at(200), "whole", 1, 5, "3/0", None),
            (4, at(3), "expired", 1, 5, "4/0", None),
            (4, at(80), "expired", 1, 5, "4/1", None),
            (5, at(5), "expired", 1, 5, "5/2", None),
            (6, at(34), "failed", 0, 0, "", 0),
        ],
        key=lambda r: (r[0], r[1]),
    )


def test_a_restart_in_the_middle_tells_each_file_once(spark, tmp_path):
    produced(part_messages(spark, D), f"file://{tmp_path}/q", commits=3)
    for batches in (1, 3, None, None):
        stream = parts.assembled(queue_table.polled(spark, f"file://{tmp_path}/q", max_files=1), datetime.timedelta(hours=6))
        parts.run(stream, f"{tmp_path}/files", f"{tmp_path}/state", batches)
    with open(sorted(glob.glob(f"{tmp_path}/state/offsets/[0-9]*"), key=lambda f: int(os.path.basename(f)))[-1]) as f:
        assert json.loads(f.read().splitlines()[-1]) == {"commits": 4, "files": 0}
    once = [tuple(r) for r in part_assembly(spark, D).collect()]
    assert told(spark, tmp_path) == sorted(once, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("buckets", [None, 1])
def test_states_by_file_and_by_bucket_tell_the_same(spark, tmp_path, buckets):
    produced(part_messages(spark, D), f"file://{tmp_path}/q", commits=3)
    for batches in (2, None):
        stream = parts.assembled(queue_table.polled(spark, f"file://{tmp_path}/q", max_files=2), datetime.timedelta(hours=6), buckets=buckets)
        parts.run(stream, f"{tmp_path}/files", f"{tmp_path}/state", batches)
    once = [tuple(r) for r in part_assembly(spark, D).collect()]
    assert told(spark, tmp_path) == sorted(once, key=lambda r: (r[0], r[1]))
