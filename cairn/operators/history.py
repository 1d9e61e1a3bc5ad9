"""The history of a repository as tables: commits, changes, blobs, and findings in what was once committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths

#: Blobs larger than this are counted, not scanned; commits beyond this many are left out (0: none are).
LARGEST_BLOB, MOST_COMMITS = 8 * 1024 * 1024, 500
#: Commits over which changes of files are summed up.
CHURN_COMMITS = 200


def recent(commits: DataFrame, keep: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The newest keep commits (0: all), of each group by; order: columns, the newest being the largest; ties by every other column."""
    if keep <= 0:
        return commits
    columns = [F.col(c).desc_nulls_last() for c in [*order, *(c for c in commits.columns if c not in order)]]
    if by is None:
        return commits.orderBy(*columns).limit(keep)
    # Of a group's commits only keep are held while sorting: the window's limit is pushed below the shuffle.
    ranked = commits.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*columns)))
    return ranked.where(F.col("_k") <= keep).drop("_k")


def distinct_blobs(blobs: DataFrame, newest: list[str]) -> DataFrame:
    """One row per project and blob (the first 7 digits of its id, as abbreviated ids occur), the newest that has it. blobs: project_id, oid, and more."""
    rest = [c for c in blobs.columns if c not in ("project_id", "oid")]
    keyed = blobs.where("oid IS NOT NULL").withColumn("short", F.lower(F.substring("oid", 1, 7)))
    best = F.max_by(F.struct("oid", *rest), F.struct(*newest, *(c for c in ["oid", *rest] if c not in newest)))
    return keyed.groupBy("project_id", "short").agg(best.alias("b")).select("project_id", "short", "b.*")


def blob_counters(blobs: DataFrame) -> DataFrame:
    """One row: blobs, and how many are too large to be scanned. blobs: bytes."""
    return blobs.agg(F.count("*").alias("blobs"), F.count_if(F.col("bytes") > LARGEST_BLOB).alias("too_large"))


def placed_findings(findings: DataFrame, blobs: DataFrame) -> DataFrame:
    """findings in blobs under the paths they had, with their commit. findings: project_id, file, line, and more; blobs: project_id, relative, repo_path, commit_oid, committed_at, summary.

    A finding's file names a blob's relative path, in any spelling; findings elsewhere are left out. Of blobs that
    give one path and line several origins the last, by commit id, counts.
    """
    key = lambda c: paths.key(F.regexp_replace(c, r"^\.[\\/]", ""))
    own = blobs.where("relative IS NOT NULL AND repo_path IS NOT NULL").select(F.col("project_id").alias("_p"), key("relative").alias("_k"), F.col("repo_path").alias("path"), "commit_oid", "committed_at", "summary")
    hit = findings.where("file IS NOT NULL").withColumn("_f", key("file"))
    both = hit.join(own, (F.col("_f") == F.col("_k")) & (F.col("project_id") == F.col("_p"))).drop("_f", "_k", "_p")
    columns = ["commit_oid", "committed_at", "summary"]
    return both.groupBy("project_id", "path", "line").agg(F.max_by(F.struct(*columns), F.struct(*columns)).alias("o"), F.count("*").alias("findings")).select("project_id", "path", "line", "o.*", "findings")


def by_author(commits: DataFrame) -> DataFrame:
    """project_id, author, commits. commits: project_id, author, oid."""
    return commits.groupBy("project_id", "author").agg(F.countDistinct("oid").alias("commits"))


def churn(changes: DataFrame, commits: DataFrame, keep: int = CHURN_COMMITS) -> DataFrame:
    """project_id, path, churn, touches over the newest commits. changes: project_id, oid, path, inserted, deleted; commits: project_id, oid, at."""
    last = recent(commits.select("project_id", "oid", "at").distinct(), keep, ["at", "oid"], ["project_id"]).select("project_id", "oid")
    rows = changes.join(last, ["project_id", "oid"], "left_semi")
    return rows.groupBy("project_id", "path").agg(F.sum(F.col("inserted") + F.col("deleted")).alias("churn"), F.countDistinct("oid").alias("touches"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """project_id, path, status, old_path between two trees (project_id, path, oid): added, deleted, modified, renamed.

    A file that is gone and one that is new with the same blob are a rename, paired in the order of their paths.
    """
    old, new = (t.select("project_id", "path", F.col("oid").alias(name)).distinct() for t, name in ((before, "then"), (after, "now")))
    both = old.join(new, ["project_id", "path"], "full_outer")
    changed = both.where("then IS NOT NULL AND now IS NOT NULL AND then <> now").select("project_id", "path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_path"))
    place = lambda oid: F.row_number().over(Window.partitionBy("project_id", oid).orderBy("path"))
    gone = both.where("now IS NULL").select("project_id", F.col("path").alias("old_path"), F.col("then").alias("oid"), place("then").alias("k"))
    made = both.where("then IS NULL").select("project_id", "path", F.col("now").alias("oid"), place("now").alias("k"))
    pairs = made.join(gone, ["project_id", "oid", "k"], "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    moved = pairs.select("project_id", F.coalesce("path", "old_path").alias("path"), status.alias("status"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return changed.unionByName(moved)
