"""The history of runs: latest snapshots, retention, what a run found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import bucketed_positions


def distinct_runs(runs: DataFrame) -> DataFrame:
    """One row per run id: of repeated deliveries the one that finished last."""
    columns = [c for c in runs.columns if c not in ("id", "finished_at")]
    return runs.groupBy("id").agg(F.max(F.struct("finished_at", *columns)).alias("r")).select("id", "r.*")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each project; ties by id. An aggregate, so no project is put in order in one task."""
    newest = F.max(F.struct("created_at", "id", "branch", "file_count", "bytes_total")).alias("s")
    return snapshots.groupBy("project_id").agg(newest).select("project_id", "s.*")


def retained(runs: DataFrame, keep: int) -> DataFrame:
    """id, project_id, finished_at of the newest keep runs of each project; ties by id.

    Runs are numbered by buckets of time, so a project with a third of all runs isn't one task.
    """
    rows = distinct_runs(runs).where(F.col("finished_at").isNotNull()).select("project_id", (-F.col("finished_at")).alias("age"), (-F.col("id")).alias("nid"))
    placed = bucketed_positions(rows, ["project_id"], "age", 30 * 86_400)
    return placed.where(F.col("pos") < keep).select((-F.col("nid")).alias("id"), "project_id", (-F.col("age")).alias("finished_at"))


def run_history(runs: DataFrame, projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Runs with their project's name and whether they are successful, that is, have a snapshot."""
    named = distinct_runs(runs).join(projects.select(F.col("id").alias("project_id"), "name", "root_path"), "project_id")
    done = snapshots.select(F.col("run_id").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("ok", F.lit(True))
    out = named.join(done, "id", "left")
    return out.select("id", "project_id", "name", "profile", "finished_at", "files_copied", F.coalesce("ok", F.lit(False)).alias("successful"))


def last_export_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """rel_path, status of a file list against an earlier one: added, modified (by digest) or deleted. rel_path, sha256 each."""
    cur, pre = current.select("rel_path", F.col("sha256").alias("now")), previous.select("rel_path", F.col("sha256").alias("then"))
    both = cur.join(pre, "rel_path", "full_outer")
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified")
    return both.select("rel_path", status.alias("status")).where(F.col("status").isNotNull())


def runs_per_day(runs: DataFrame) -> DataFrame:
    """day, runs, cancelled, bytes of distinct runs by the UTC day they finished."""
    rows = distinct_runs(runs).where(F.col("finished_at").isNotNull())
    day = F.date_format(F.timestamp_seconds("finished_at"), "yyyy-MM-dd")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.coalesce("cancelled", F.lit(False))).alias("cancelled"), F.sum(F.coalesce("bytes_total", F.lit(0))).alias("bytes"))


def running_bytes(runs: DataFrame) -> DataFrame:
    """day, bytes, and all bytes up to the day: a prefix sum over days, of which there are few."""
    days = runs_per_day(runs).select("day", "bytes")
    return days.withColumn("bytes_so_far", F.sum("bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
