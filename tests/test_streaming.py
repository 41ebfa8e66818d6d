"""Streams that are run to their end give the batch result."""

from pyspark.sql import functions as F

from quire.streaming import assemble

D = "/root/testdata/sf0.001"


def write_events(spark, path, parts):
    spark.read.parquet(f"{D}/events.parquet").repartition(parts).write.parquet(path)


def test_parts_are_assembled(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), 4)
    items = assemble.parts_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, max_files=1)
    parts = items.select((F.col("user_id") % 20).alias("file_no"), (F.col("event_id") % 3).alias("part"))
    got = assemble.run_once(assemble.counted(parts, "file_no", "part"), "complete", str(tmp_path / "state"))
    done = {(r.file_no, r.n_parts, r.n_items) for r in assemble.assembled(got, "file_no", 3).collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy((F.col("user_id") % 20).alias("f")).agg(F.countDistinct(F.col("event_id") % 3).alias("k"), F.count("*").alias("n")).where("k = 3")
    assert done == {(r.f, 3, r.n) for r in batch.collect()}


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    once = assemble.assemble_once(spark, f"{D}/events.parquet", F.col("user_id") % 100, F.col("event_id") % 4, 4)
    assert {(r.file_no, r.n_items) for r in once.collect()} == {(r.file_no, r.n_items) for r in assemble.assemble_once(spark, f"{D}/events.parquet", F.col("user_id") % 100, F.col("event_id") % 4, 4).collect()}


def test_hours_of_event_time(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), 1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = assemble.run_once(assemble.hourly(assemble.parts_stream(spark, str(tmp_path / "in"), schema), ["event_type"], "ts"), "append", str(tmp_path / "state"))
    total = sum(r.n for r in got.collect())
    assert 0 < total <= 1000


def test_repeated_errors_within_the_watermark(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), 1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = assemble.latest_errors(assemble.parts_stream(spark, str(tmp_path / "in"), schema), "event_type", "ts", 5)
    got = assemble.run_once(stream.select("event_type"), "append", str(tmp_path / "state"))
    assert {r.event_type for r in got.collect()} == {r.event_type for r in spark.read.parquet(f"{D}/events.parquet").select("event_type").distinct().collect()}
