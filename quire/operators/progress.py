"""Progress of files through stages, kept as a table of (session, file, stage) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of a file, in order.
STAGES = (
    "extraction", "image_processing", "excel_original", "html_original", "pdf_original", "docx_original", "translation", "excel_translated", "html_translated", "pdf_translated", "docx_translated"
)
#: States of a file in a session.
FILE_STATES = ("completed_no_issues", "completed_with_issues", "partial_no_issues", "partial_with_issues", "failed", "pending")


def latest(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state after all updates: each key's last row."""
    return updates.groupBy(keys).agg(F.max_by(F.struct(*updates.columns), order).alias("_r")).select("_r.*")


def with_ratio(df: DataFrame) -> DataFrame:
    """``progress``: completed over total counts, 0 where there is no total."""
    return df.withColumn("progress", F.round(F.when(F.col("total_count") > 0, F.col("completed_count") / F.col("total_count")).otherwise(0.0), 4))


def reconcile(stages: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Completed stages whose output is not there go back to pending."""
    there = outputs.select(keys).distinct().withColumn("_there", F.lit(True))
    gone = (F.col("status") == "completed") & F.col("_there").isNull()
    return stages.join(there, keys, "left").withColumn("status", F.when(gone, "pending").otherwise(F.col("status"))).drop("_there")


def status_of(stage: Column) -> Column:
    """A stage's status from its text, which is the status itself or an object that has it."""
    return F.coalesce(F.when(F.startswith(F.ltrim(stage), F.lit("{")), F.get_json_object(stage, "$.status")).otherwise(stage), F.lit("pending"))


def file_rollup(files: DataFrame, stages: DataFrame, keys: list[str], issues: str = "n_issues", error: str = "error") -> DataFrame:
    """Each file with its counts of stages by status and its state, one of FILE_STATES.

    ``files`` has the number of issues and the error, ``stages`` a row for each stage that was recorded (``stage``,
    ``status``). A file is complete when all of STAGES are; a stage that failed is an issue; a file with none completed or
    under way failed if it has an error, else it is pending.
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    by = stages.where(F.col("stage").isin(*STAGES)).groupBy(keys).agg(n("completed").alias("n_completed"), n("failed").alias("n_failed"), n("processing", "in_progress").alias("n_running"))
    out = files.join(by, keys, "left").fillna(0, ["n_completed", "n_failed", "n_running"])
    flawed = (F.coalesce(F.col(issues), F.lit(0)) > 0) | (F.col("n_failed") > 0)
    reached = F.when(F.col("n_completed") == len(STAGES), "completed").when((F.col("n_completed") > 0) | (F.col("n_running") > 0), "partial")
    state = F.when(reached.isNotNull(), F.concat(reached, F.when(flawed, "_with_issues").otherwise("_no_issues"))).when(F.coalesce(F.col(error), F.lit("")) != "", "failed").otherwise("pending")
    return out.withColumn("state", state)


def session_rollup(files: DataFrame, session: str) -> DataFrame:
    """Counts of a session's files by state, those to go on with, the share completed, and whether it is done: all complete, without issues."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    complete = n("completed_no_issues", "completed_with_issues")
    return files.groupBy(session).agg(
        F.count("*").alias("n_files"),
        *(n(s).alias(f"n_{s}") for s in FILE_STATES),
        n("partial_no_issues", "partial_with_issues", "pending").alias("n_incomplete"),
        F.round(100 * complete / F.count("*"), 4).alias("percent"),
        F.bool_and(F.col("state") == "completed_no_issues").alias("done"),
    )


def to_resume(files: DataFrame, status: str = "status") -> DataFrame:
    """Files that are to be worked on, with ``why``: failed, unfinished or not_started; complete ones stay out, whatever their issues."""
    started = (F.col("n_completed") > 0) | (F.col("n_failed") > 0) | (F.col("n_running") > 0)
    why = F.when(F.col(status) == "failed", "failed").when(started, "unfinished").otherwise("not_started")
    return files.where(~F.startswith("state", F.lit("completed"))).withColumn("why", why)


SESSION = "session_id string, files array<string>, file_progress map<string, struct<status: string, error: string, issues: array<string>, stages: map<string, string>>>"


def session_files(sessions: DataFrame, text: str = "json") -> tuple[DataFrame, DataFrame]:
    """Files (``session_id, file, status, error, n_issues``) and stages (``session_id, file, stage, status``) of sessions' json.

    Paths are compared with forward slashes; progress of files that a session does not list is left out.
    """
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    parsed = sessions.select(F.from_json(F.col(text), SESSION).alias("s")).select("s.*").where("session_id is not null")
    noted = F.map_from_entries(F.transform(F.map_entries("file_progress"), lambda e: F.struct(slashed(e["key"]).alias("key"), e["value"].alias("value"))))
    each = parsed.select("session_id", F.explode(F.array_distinct(F.transform("files", slashed))).alias("file"), noted.alias("noted"))
    rows = each.select("session_id", "file", F.try_element_at("noted", F.col("file")).alias("p"))
    files = rows.select("session_id", "file", F.coalesce("p.status", F.lit("pending")).alias("status"), F.col("p.error").alias("error"), F.greatest(F.size(F.coalesce("p.issues", F.array().cast("array<string>"))), F.lit(0)).alias("n_issues"))
    stages = rows.select("session_id", "file", F.explode("p.stages").alias("stage", "_v")).select("session_id", "file", "stage", status_of(F.col("_v")).alias("status"))
    return files, stages


def read_sessions(spark, folder: str) -> DataFrame:
    """The sessions' json texts of a folder; a file that cannot be read gives way to its copy ``.bak``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(folder).select("path", F.decode("content", "UTF-8").alias("json"))
    named = raw.select(F.regexp_replace("path", r"\.bak$", "").alias("name"), F.endswith("path", F.lit(".bak")).alias("copy"), "json", F.from_json("json", SESSION)["session_id"].isNotNull().alias("good"))
    return named.where("good").groupBy("name").agg(F.min_by("json", "copy").alias("json"))


def stage_done(files: DataFrame, stages: DataFrame, keys: list[str], path: str, stage: str) -> DataFrame:
    """``files`` with ``done``: is the stage completed under the file's path, with slashes of either kind?"""
    slashed = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    known = stages.where((F.col("stage") == stage) & (F.col("status") == "completed")).select(*keys, slashed.alias("_p")).distinct().withColumn("_d", F.lit(True))
    return files.withColumn("_p", slashed).join(known, [*keys, "_p"], "left").withColumn("done", F.coalesce("_d", F.lit(False))).drop("_p", "_d")


def unfinished(files: DataFrame, stages: DataFrame, keys: list[str], path: str, stage: str) -> DataFrame:
    """Files for which a stage is to be run: it is not completed."""
    return stage_done(files, stages, keys, path, stage).where("not done").drop("done")


def remaining(files: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(done.select(keys).distinct(), keys, "left_anti")


def missing_outputs(files: DataFrame, outputs: DataFrame, key: str, form: str, wanted: list[str]) -> DataFrame:
    """``missing``: the wanted forms of output that a file does not have, sorted."""
    have = outputs.groupBy(key).agg(F.collect_set(form).alias("_have"))
    none = F.array().cast("array<string>")
    return files.join(have, key, "left").withColumn("missing", F.sort_array(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("_have", none)))).drop("_have")


def worklist(df: DataFrame) -> DataFrame:
    """What is next for a file by its ``missing`` outputs: complete, parse, translate or format."""
    m = F.col("missing")
    return df.withColumn("next", F.when(F.size(m) == 0, "complete").when(F.array_contains(m, "parsed"), "parse").when(F.array_contains(m, "html"), "translate").otherwise("format"))


def stale(pages: DataFrame, fragments: DataFrame, key: str, page_ts: str, fragment_ts: str, slack: str = "INTERVAL 5 SECONDS") -> DataFrame:
    """Pages older than one of their fragments by more than the slack."""
    newest = fragments.groupBy(key).agg(F.max(fragment_ts).alias("_newest"))
    return pages.join(newest, key).where(F.col("_newest") > F.col(page_ts) + F.expr(slack)).drop("_newest")


def is_old(done: Column, updated: Column, now: Column, days: int = 7) -> Column:
    """May a session be cleaned up: it is done, and was not touched for so many days?"""
    return done & (updated < now - F.expr(f"INTERVAL {days} DAYS"))


def mark(stages: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The stage table after changes of status (keys, stage, status, updated_at): the newest one of each file's stage stands."""
    columns = [*keys, "stage", "status", "updated_at"]
    return latest(stages.select(columns).unionByName(changes.select(columns)), [*keys, "stage"], "updated_at")
