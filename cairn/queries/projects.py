"""Queries over projects: plans, imports, scores, budgets, parts, run history, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths, sizes
from cairn.functions.classify import archive_group
from cairn.operators import findings, graph, manifests, parts, rules, sarif, store
from cairn.queries import corpus
from cairn.queries.corpus import _FILES, files
from cairn.operators.snapshot_changes import digest_value, path_key
from cairn.runtime import cut, shared_folder, small, spread, table
from cairn.streaming import scan as stream

RULES = rules.Rules.parse(
    """
# what stays out
reports/
*/legacy/*
*_drift*.md
lib/**/secret?.txt
*.lock   # made again by every install
!src/core/
!summary_*.md
""",
    ["ini", "tf"],
)
BUDGET, PART_BYTES = 20_000, 64 * 1024


def plan_files(spark: SparkSession, d: str) -> DataFrame:
    planned = rules.plan(files(spark, d).select("doc_id", "rel_path", "size"), RULES, "safe")
    return planned.select("doc_id", "status", "reason", "severity")


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.plan_summary(rules.plan(files(spark, d).select("rel_path", "size"), RULES, "safe"))


def pinned_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(RULES.pinned(F.col("rel_path"))).select("doc_id", "rel_path")


def explain_verdict(spark: SparkSession, d: str) -> DataFrame:
    """What the plan says of the files that earlier findings name; the diff is all that a snapshot ever held."""
    planned = rules.plan(files(spark, d).select("rel_path", "size"), RULES, "safe")
    asked = table(spark, d, "finding").select(F.regexp_replace("file", r"^\.[\\/]", "").alias("rel_path")).where("rel_path IS NOT NULL").distinct()
    selected = table(spark, d, "snapshot_file").select("rel_path").where("rel_path IS NOT NULL")
    return rules.explain(asked, planned, selected).groupBy("verdict").agg(F.count("*").alias("paths"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(files(spark, d).select("project_id", "rel_path", "text"))
    modules = manifests.declarations(rows).where("kind = 'module'").select("project", F.col("name").alias("module")).distinct()
    return graph.import_edges(rows, go_module=modules)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return cut(import_edges(spark, d))


def import_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(import_edges(spark, d))


def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    """How many files each importing file may stand for, before they are held against what exists."""
    found = graph.specifiers(spread(files(spark, d).select("project_id", "rel_path", "text")))
    return found.groupBy("project", "source").agg(F.countDistinct("base").alias("bases"), F.countDistinct("target").alias("targets"))


def key_file_scores(spark: SparkSession, d: str) -> DataFrame:
    return graph.key_file_scores(spread(files(spark, d).select("doc_id", "project_id", "rel_path", "text")), _edges(spark, d))


def refactoring_scores(spark: SparkSession, d: str) -> DataFrame:
    return graph.refactoring_scores(spread(files(spark, d).select("doc_id", "project_id", "rel_path", "text")), _edges(spark, d))


def layers_of_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(graph.layers(F.col("rel_path")).alias("layer")).agg(F.count("*").alias("files"))


def budget_fit(spark: SparkSession, d: str) -> DataFrame:
    """Per project: which files fit its token budget; importance is the depth at which a file isn't."""
    rows = files(spark, d).where("project_id IS NOT NULL").select(F.col("project_id").alias("group"), F.col("doc_id").alias("id"), (F.lit(12) - paths.depth(F.col("rel_path"))).cast("double").alias("importance"), sizes.token_estimate(F.col("size")).alias("tokens"))
    return parts.budget_fit(rows, BUDGET).select(F.col("group").alias("project_id"), F.col("id").alias("doc_id"), "tokens", "included")


def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).where("project_id IS NOT NULL")
    return rows.select(F.col("project_id").alias("archive"), archive_group(F.col("rel_path"), F.lit("core")).alias("group"), F.concat_ws("#", paths.key(F.col("rel_path")), "doc_id").alias("path"), "size")


def archive_parts(spark: SparkSession, d: str) -> DataFrame:
    """Per project: the parts of its archive, by group and path, of PART_BYTES each."""
    placed = parts.archive_parts(archive_entries(spark, d), PART_BYTES)
    return placed.groupBy("archive", "part").agg(F.min("group").alias("group"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_snapshots(table(spark, d, "export_snapshot"))


def retention_keep_5(spark: SparkSession, d: str) -> DataFrame:
    return store.retained(table(spark, d, "export_run"), 5)


def run_history(spark: SparkSession, d: str) -> DataFrame:
    rows = store.run_history(table(spark, d, "export_run"), table(spark, d, "project"), table(spark, d, "export_snapshot"))
    return rows.select("id", "project_id", "name", "successful")


def runs_per_day(spark: SparkSession, d: str) -> DataFrame:
    return store.runs_per_day(table(spark, d, "export_run"))


def running_bytes(spark: SparkSession, d: str) -> DataFrame:
    return store.running_bytes(table(spark, d, "export_run"))


def last_export_diff(spark: SparkSession, d: str) -> DataFrame:
    """Per branch: the files of its newest snapshot against those of the one before, by digest."""
    heads = table(spark, d, "export_snapshot").select("id", "project_id", "branch", "created_at").dropna().distinct()
    newest = heads.groupBy("project_id", "branch").agg(F.sort_array(F.collect_list(F.struct("created_at", "id")), False).alias("all"))
    pairs = newest.where(F.size("all") > 1).select(F.col("all")[0]["id"].alias("now_id"), F.col("all")[1]["id"].alias("then_id"))
    rows = table(spark, d, "snapshot_file").where("rel_path IS NOT NULL").select("snapshot_id", path_key(F.col("rel_path")).alias("p"), F.hex(digest_value(F.col("sha256"))).alias("sha256"))
    rows = rows.groupBy("snapshot_id", "p").agg(F.coalesce(F.max("sha256"), F.lit("")).alias("sha256"))
    keyed = lambda side: rows.join(small(pairs), rows["snapshot_id"] == F.col(side)).select(F.concat_ws(":", "now_id", "p").alias("rel_path"), "sha256")
    return store.last_export_diff(keyed("now_id"), keyed("then_id")).select(F.split_part("rel_path", F.lit(":"), F.lit(1)).cast("long").alias("snapshot_id"), F.expr("substr(rel_path, locate(':', rel_path) + 1)").alias("rel_path"), "status")


def _project_findings(spark: SparkSession, d: str) -> DataFrame:
    found = findings.scan(files(spark, d).where("project_id IS NOT NULL").select(F.concat_ws("\\", "project_id", "rel_path").alias("rel_path"), "text")).distinct()
    return found.withColumn("project_id", F.regexp_extract("file", r"^\.\\(\d+)\\", 1).cast("long")).withColumn("file", F.regexp_replace("file", r"^\.\\\d+\\", ".\\\\"))


def sarif_scans(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one SARIF document per project."""
    return sarif.sarif_lines(_project_findings(spark, d).distinct(), "project_id").select("scan", F.to_json("place").alias("place"), "text")


def json_scans(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one JSON report per project."""
    return sarif.json_lines(_project_findings(spark, d).distinct(), "project_id", "1970-01-01 00:00:00").select("scan", F.to_json("place").alias("place"), "text")


def build_declarations(spark: SparkSession, d: str) -> DataFrame:
    return manifests.declarations(files(spark, d))


def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """The secret lines found by the streaming scan of the documents' folder."""
    at = f"{shared_folder(spark).rstrip('/')}/cairn/stream-{uuid.uuid4().hex}"
    files(spark, d).select("doc_id", "text").repartition(8).write.parquet(f"{at}/in")
    arriving = stream.arriving(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema, per_trigger=4)
    stream.scan_stream(arriving, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out")


def batch_scan(spark: SparkSession, d: str) -> DataFrame:
    return stream.secret_lines(files(spark, d))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = stream.changes_per_window(table(spark, d, "events").select("ts", "event_type"), "1 day")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events")


QUERIES = {
    "plan_files": plan_files, "plan_summary": plan_summary, "pinned_files": pinned_files, "explain_verdict": explain_verdict, "import_edges": import_edges, "import_degrees": import_degrees, "import_candidates": import_candidates,
    "key_file_scores": key_file_scores, "refactoring_scores": refactoring_scores, "layers_of_files": layers_of_files, "budget_fit": budget_fit, "archive_parts": archive_parts, "latest_snapshot": latest_snapshot,
    "retention_keep_5": retention_keep_5, "run_history": run_history, "runs_per_day": runs_per_day, "running_bytes": running_bytes, "last_export_diff": last_export_diff, "sarif_scans": sarif_scans, "json_scans": json_scans,
    "build_declarations": build_declarations, "stream_scan": stream_scan, "batch_scan": batch_scan, "event_windows": event_windows,
}

_RUNS = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC NULLS LAST) AS k FROM export_run) WHERE k = 1)"
_PINNED = "(parent = 'src/core' OR starts_with(parent, 'src/core/') OR list_contains(string_split(parent, '/'), 'src/core') OR n GLOB 'summary_*.md' OR lp GLOB 'summary_*.md')"
_DIRS = "'.git', 'node_modules', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache', '.tox', '.venv', 'venv', 'env', 'dist', 'build', 'coverage', '.coverage', '.next', '.nuxt', '.turbo', '.parcel-cache'"
_KEPT_DIR = lambda a: f"({a} = 'src/core' OR starts_with({a}, 'src/core/') OR list_contains(string_split({a}, '/'), 'src/core'))"
_HIT_DIR = lambda a: f"(string_split({a}, '/')[-1] IN ({_DIRS}) OR ((string_split({a}, '/')[-1] = 'reports' OR starts_with({a}, 'reports/')) AND NOT {_KEPT_DIR(a)}))"


def planned_sql(pinned: str = "false", rules_first: str = "") -> str:
    """The plan in SQL; pinned and rules_first: what a user put in or out by hand."""
    return (
        _FILES.replace("array_to_string(parts[:-2], '/') AS parent", "array_to_string(lparts[:-2], '/') AS parent")
        + f""", q0 AS (SELECT *, list_transform(range(1, len(lparts)), lambda k: array_to_string(lparts[1:k], '/')) AS ups, ({_PINNED} OR {pinned}) AS pin FROM h),
      q AS (SELECT *, CASE WHEN pin THEN NULL WHEN e IN ('ini', 'tf') THEN 'custom extension rule: .' || e {rules_first}
      WHEN regexp_matches(lp, '^.*/legacy/.*$') THEN 'file rule: */legacy/*' WHEN regexp_matches(n, '^.*_drift.*\\.md$') OR regexp_matches(lp, '^.*_drift.*\\.md$') THEN 'file rule: *_drift*.md'
      WHEN regexp_matches(lp, '^lib/.*.*/secret.\\.txt$') THEN 'file rule: lib/**/secret?.txt' WHEN regexp_matches(n, '^.*\\.lock$') THEN 'file rule: *.lock'
      WHEN list_contains(lparts[:-2], 'reports') THEN 'directory rule: reports' END AS rule,
      CASE WHEN n IN ('.npmrc', '.pypirc', 'credentials.json', 'secrets.json', 'secret.json', 'service-account.json', 'service_account.json', 'firebase-adminsdk.json', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519') OR (starts_with(n, '.env') AND NOT (ends_with(n, '.example') OR ends_with(n, '.sample'))) THEN 'high-risk credential filename'
      WHEN contains(n, 'secret') OR contains(n, 'credential') OR contains(n, 'private') THEN 'secret-like filename'
      WHEN e IN ('key', 'pem', 'p12', 'pfx', 'crt', 'cer', 'keystore', 'jks', 'db', 'sqlite', 'sqlite3', 'bak', 'dump', 'backup', '7z', 'rar', 'tar', 'gz', 'xz', 'zip') THEN 'sensitive/binary suffix .' || e END AS safe,
      list_filter(ups, lambda a: {_HIT_DIR('a')}) AS skipped, len(list_filter(ups, lambda a: {_HIT_DIR('a')})) > 0 AS ignored FROM q0),
    pl AS (SELECT *, CASE WHEN ignored THEN 'not_planned' WHEN rule IS NOT NULL OR safe IS NOT NULL THEN 'excluded' ELSE 'included' END AS status,
      CASE WHEN ignored THEN 'inside an ignored directory' ELSE coalesce(rule, safe, 'included') END AS reason,
      CASE WHEN ignored THEN 'info' WHEN rule IS NOT NULL THEN 'medium' WHEN safe IS NULL THEN 'info' WHEN starts_with(safe, 'high-risk') THEN 'critical' ELSE 'high' END AS severity FROM q) """
    )


_PLANNED = planned_sql()

_PARTS = (
    _FILES
    + f""", ent AS (SELECT project_id AS archive, {corpus._ARCHIVE} AS grp, lp || '#' || doc_id AS path, size FROM h WHERE project_id IS NOT NULL),
  xs AS (SELECT archive, grp, list({{'s': size, 'p': path, 'part': CAST(0 AS BIGINT), 'held': CAST(0 AS BIGINT), 'cut': false, 'log': CAST([] AS BIGINT[])}} ORDER BY path) AS xs FROM ent GROUP BY 1, 2),
  fold AS (SELECT archive, grp, xs, list_reduce(list_prepend({{'s': CAST(0 AS BIGINT), 'p': '', 'part': CAST(0 AS BIGINT), 'held': CAST(0 AS BIGINT), 'cut': true, 'log': CAST([] AS BIGINT[])}}, xs), lambda a, x:
    {{'s': x.s, 'p': x.p, 'part': CASE WHEN a.cut OR a.held + x.s > {PART_BYTES} THEN a.part + 1 ELSE a.part END, 'held': CASE WHEN a.cut OR a.held + x.s > {PART_BYTES} THEN x.s ELSE a.held + x.s END, 'cut': x.s >= {PART_BYTES},
      'log': list_append(a.log, CASE WHEN a.cut OR a.held + x.s > {PART_BYTES} THEN a.part + 1 ELSE a.part END)}}).log AS log FROM xs),
  placed0 AS (SELECT archive, grp, unnest(list_transform(xs, lambda x: x.s)) AS s, unnest(log) AS gp FROM fold),
  off AS (SELECT archive, grp, coalesce(sum(n) OVER (PARTITION BY archive ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT archive, grp, max(gp) AS n FROM placed0 GROUP BY 1, 2)),
  placed AS (SELECT p.archive, p.grp, p.s, gp + o AS part FROM placed0 p JOIN off ON off.archive = p.archive AND off.grp = p.grp) """
)

ORACLE = {
    "plan_files": _PLANNED + "SELECT doc_id, status, reason, severity FROM pl",
    "plan_summary": _PLANNED + "SELECT status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size >= 104857600) AS large, count(*) FILTER (severity = 'critical') AS critical FROM pl GROUP BY 1",
    "pinned_files": _PLANNED + f"SELECT doc_id, rel_path FROM q WHERE {_PINNED}",
    "layers_of_files": _FILES
    + """, y AS (SELECT CASE WHEN n IN ('main.py', '__main__.py', 'app.py', 'manage.py') OR starts_with(n, 'vite.config') THEN 'entrypoints'
      WHEN list_has_any(lparts, ['ui', 'components', 'pages']) OR e IN ('html', 'css', 'scss', 'tsx', 'jsx', 'vue', 'svelte') THEN 'interface' WHEN list_has_any(lparts, ['services', 'service', 'usecases']) THEN 'business_services'
      WHEN list_has_any(lparts, ['reports', 'exporters']) THEN 'report_generation' WHEN list_has_any(lparts, ['models', 'schemas', 'entities']) THEN 'data_models' WHEN list_has_any(lparts, ['utils', 'helpers', 'lib']) THEN 'utilities'
      WHEN list_contains(lparts, 'tests') OR contains(n, 'test') THEN 'tests' WHEN e IN ('json', 'yaml', 'yml', 'toml', 'ini', 'cfg', 'conf') THEN 'configuration' WHEN e IN ('md', 'rst', 'adoc', 'txt') THEN 'documentation' ELSE 'other' END AS layer FROM h)
      SELECT layer, count(*) AS files FROM y GROUP BY 1""",
    "budget_fit": _FILES
    + f""", c AS (SELECT project_id, doc_id, greatest(1, CAST(round(size / 3.5) AS BIGINT)) AS tokens, (12.0 - len(parts)) / greatest(1, CAST(round(size / 3.5) AS BIGINT)) AS rank FROM h WHERE project_id IS NOT NULL),
      s AS (SELECT project_id, list({{'room': CAST({BUDGET} AS BIGINT), 't': tokens, 'id': doc_id, 'ok': CAST([] AS BIGINT[])}} ORDER BY rank DESC, doc_id) AS xs FROM c GROUP BY 1),
      z AS (SELECT project_id, list_reduce(list_prepend({{'room': CAST({BUDGET} AS BIGINT), 't': CAST(0 AS BIGINT), 'id': CAST(-1 AS BIGINT), 'ok': CAST([] AS BIGINT[])}}, xs),
        lambda a, x: {{'room': CASE WHEN x.t <= a.room THEN a.room - x.t ELSE a.room END, 't': x.t, 'id': x.id, 'ok': CASE WHEN x.t <= a.room THEN list_append(a.ok, x.id) ELSE a.ok END}}).ok AS ok FROM s)
      SELECT c.project_id, c.doc_id, c.tokens, list_contains(z.ok, c.doc_id) AS included FROM c JOIN z USING (project_id)""",
    "latest_snapshot": """SELECT project_id, created_at, id, branch, file_count, bytes_total FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM (SELECT DISTINCT project_id, created_at, id, branch, file_count, bytes_total FROM export_snapshot)) WHERE k = 1""",
    "retention_keep_5": f"WITH {_RUNS} SELECT id, project_id, finished_at FROM (SELECT id, project_id, finished_at, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, id DESC) AS m FROM r WHERE finished_at IS NOT NULL) WHERE m <= 5",
    "run_history": f"WITH {_RUNS} SELECT r.id, r.project_id, p.name, r.id IN (SELECT run_id FROM export_snapshot WHERE run_id IS NOT NULL) AS successful FROM r JOIN project p ON p.id = r.project_id",
    "runs_per_day": f"WITH {_RUNS} SELECT strftime(to_timestamp(finished_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (coalesce(cancelled, false)) AS cancelled, CAST(sum(coalesce(bytes_total, 0)) AS BIGINT) AS bytes FROM r WHERE finished_at IS NOT NULL GROUP BY 1",
    "running_bytes": f"WITH {_RUNS}, y AS (SELECT strftime(to_timestamp(finished_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CAST(sum(coalesce(bytes_total, 0)) AS BIGINT) AS bytes FROM r WHERE finished_at IS NOT NULL GROUP BY 1) SELECT day, bytes, CAST(sum(bytes) OVER (ORDER BY day) AS BIGINT) AS bytes_so_far FROM y",
    "last_export_diff": r"""WITH hd AS (SELECT id, lead(id) OVER w AS prev, row_number() OVER w AS k FROM (SELECT DISTINCT id, project_id, branch, created_at FROM export_snapshot WHERE id IS NOT NULL AND project_id IS NOT NULL AND branch IS NOT NULL AND created_at IS NOT NULL) WINDOW w AS (PARTITION BY project_id, branch ORDER BY created_at DESC, id DESC)),
      f AS (SELECT snapshot_id, regexp_replace(replace(lower(rel_path), '\', '/'), '^\./', '') AS p, coalesce(max(nullif(lower(trim(regexp_replace(sha256, '^.*:', ''))), '')), '') AS s FROM snapshot_file WHERE rel_path IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT hd.id, f.p, f.s FROM hd JOIN f ON f.snapshot_id = hd.id WHERE k = 1 AND prev IS NOT NULL), o AS (SELECT hd.id, f.p, f.s FROM hd JOIN f ON f.snapshot_id = hd.prev WHERE k = 1)
      SELECT coalesce(c.id, o.id) AS snapshot_id, coalesce(c.p, o.p) AS rel_path, CASE WHEN o.p IS NULL THEN 'added' WHEN c.p IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM c FULL JOIN o ON o.id = c.id AND o.p = c.p WHERE o.p IS NULL OR c.p IS NULL OR c.s <> o.s""",
    "explain_verdict": _PLANNED
    + r""", k AS (SELECT lp, min({'s': status, 'r': reason}) AS m FROM pl GROUP BY 1), a AS (SELECT DISTINCT regexp_replace(file, '^\.[\\/]', '') AS f FROM finding WHERE file IS NOT NULL),
      s AS (SELECT DISTINCT lower(replace(rel_path, '\', '/')) AS p FROM snapshot_file WHERE rel_path IS NOT NULL),
      v AS (SELECT CASE WHEN k.lp IS NULL THEN 'not_planned' WHEN m.s = 'included' AND s.p IS NULL THEN 'not_in_diff' ELSE m.s END AS verdict FROM a LEFT JOIN k ON k.lp = lower(replace(f, '\', '/')) LEFT JOIN s ON s.p = lower(replace(f, '\', '/')))
      SELECT verdict, count(*) AS paths FROM v GROUP BY 1""",
    "archive_parts": _PARTS + "SELECT archive, CAST(part AS BIGINT) AS part, min(grp) AS group, count(*) AS files, CAST(sum(s) AS BIGINT) AS bytes FROM placed GROUP BY 1, 2",
    "batch_scan": corpus._CASCADE + "SELECT doc_id, line, s.rule AS rule, s.confidence AS confidence FROM cs WHERE s IS NOT NULL", "stream_scan": corpus._CASCADE + "SELECT doc_id, line, s.rule AS rule, s.confidence AS confidence FROM cs WHERE s IS NOT NULL",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
