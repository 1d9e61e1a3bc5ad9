"""Queries of the operators for files that change over time: schemas, timestamps, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.instants import normalised_instants
from cairn.operators.schema_drift import schema_changes, unified_settings
from cairn.operators.snapshot_changes import snapshot_changes
from cairn.runtime import kept_at, small, table


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, record_id, raw, tz_name, locale of every written time that is to be normalised."""
    project = table(spark, sf_dir, "project").select("id", "root_path", "tz_name", "locale")
    project = small(project)

    def of(name: str, key: str, raw: str, on: str, to: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), F.col(raw).cast("string").alias("raw"), F.col(on).alias("_on"))
        return rows.join(project, rows["_on"] == project[to], "left").select("source_table", "record_id", "raw", "tz_name", "locale")

    runs = of("export_run", "id", "started_at", "project_id", "id")
    entries = of("legacy_history_entry", "entry_id", "generated_at", "source_root", "root_path")
    blobs = of("historical_blob", "blob_id", "committed_at", "project_id", "id")
    return runs.unionByName(entries).unionByName(blobs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of written times is kept in the shared folder: a later run parses only what is new."""
    return normalised_instants(written_times(spark, sf_dir), kept_at(spark, "instants-1", sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinals of file keys are kept in the shared folder: a later run numbers only what is new."""
    return snapshot_changes(table(spark, sf_dir, "export_snapshot"), table(spark, sf_dir, "snapshot_file"), kept_at(spark, "ordinals-1", sf_dir))


def p4_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot: how many files were added, removed and changed."""
    changes = p4_found(spark, sf_dir)
    kinds = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "changed")]
    return changes.groupBy("snapshot_id").agg(*kinds)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "legacy_settings"))


def p1_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent settings table over all files."""
    return unified_settings(table(spark, sf_dir, "legacy_settings"))


QUERIES = {
    "p1_found": p1_found,
    "p1_settings": p1_settings,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_change_counts": p4_change_counts,
}

#: The same files compared by SQL: a full outer join of each complete snapshot with the one before it.
_P4 = r"""
WITH f AS (
  SELECT snapshot_id, regexp_replace(replace(lower(rel_path), '\', '/'), '^\./', '') AS p,
         max(nullif(lower(trim(regexp_replace(sha256, '^.*:', ''))), '')) AS h, max(size_bytes) AS s, max(loc) AS l
  FROM snapshot_file WHERE rel_path IS NOT NULL GROUP BY 1, 2),
n AS (SELECT snapshot_id, count(*) AS n FROM f GROUP BY 1),
h0 AS (SELECT DISTINCT id, project_id, branch, created_at, file_count FROM export_snapshot),
hd AS (
  SELECT h0.*, lag(id) OVER (PARTITION BY project_id, branch ORDER BY created_at, id) AS prev
  FROM h0 LEFT JOIN n ON n.snapshot_id = h0.id WHERE coalesce(n.n, 0) >= h0.file_count),
cur AS (SELECT hd.id, f.* FROM hd JOIN f ON f.snapshot_id = hd.id WHERE hd.prev IS NOT NULL),
pre AS (SELECT hd.id, f.* FROM hd JOIN f ON f.snapshot_id = hd.prev),
ch AS (
  SELECT coalesce(cur.id, pre.id) AS snapshot_id, coalesce(cur.p, pre.p) AS rel_path,
         CASE WHEN pre.id IS NULL THEN 'added' WHEN cur.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM cur FULL JOIN pre ON cur.id = pre.id AND cur.p = pre.p
  WHERE pre.id IS NULL OR cur.id IS NULL OR coalesce(cur.h <> pre.h, false)
     OR coalesce(cur.s <> pre.s, false) OR coalesce(cur.l <> pre.l, false))
"""

ORACLE = {
    "p4_found": _P4 + "SELECT snapshot_id, rel_path, change FROM ch",
    "p4_change_counts": _P4
    + """SELECT snapshot_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
       count(*) FILTER (change = 'changed') AS changed FROM ch GROUP BY 1""",
}
