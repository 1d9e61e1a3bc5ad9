"""Queries over the steps of an export and the history of runs: copies, dumps, manifests, retention, imports, blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import sizes
from cairn.operators import export, findings, history, lines, parts, redaction, rules, store, structure
from cairn.operators.instants import normalised_instants
from cairn.queries import corpus, literal
from cairn.queries.code import _STACKS
from cairn.queries.corpus import _FILES, files
from cairn.queries.general import written_times
from cairn.queries.projects import _DIRS, BUDGET, PART_BYTES, RULES, _PARTS, archive_entries, planned_sql
from cairn.reports import ALL, MOST, REVIEW, Catalogue, run
from cairn.runtime import cut, spread, table
from cairn.sources import store as stores
from cairn.streaming import scan as stream

#: What a user put in and out by hand.
INCLUDE, EXCLUDE = ["config/*"], ["*.sql"]
LARGEST_DUMPED, KEEP_RUNS, NEWEST_COMMITS = 4096, 5, 20
BANNER_TIME = "yyyy-MM-dd HH:mm:ss"


def _planned(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select("project_id", "doc_id", "rel_path", "size", F.col("text").isNotNull().alias("has_content"))
    return rules.plan(rows, RULES, "safe")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The paths that earlier findings name."""
    return table(spark, d, "finding").select(F.regexp_replace("file", r"^\.[\\/]", "").alias("rel_path")).where("rel_path IS NOT NULL").distinct()


def copy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each planned file if only those are wanted that earlier findings name."""
    done = export.copy_outcomes(_planned(spark, d).where("status <> 'not_planned'"), _named(spark, d), "safe")
    return done.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def copy_counters(spark: SparkSession, d: str) -> DataFrame:
    done = export.copy_outcomes(_planned(spark, d).where("status <> 'not_planned'"), _named(spark, d), "safe")
    return export.copy_counters(done, rules.skipped_dirs(files(spark, d), RULES))


def skipped_dirs(spark: SparkSession, d: str) -> DataFrame:
    return rules.skipped_dirs(files(spark, d), RULES)


def plan_overrides(spark: SparkSession, d: str) -> DataFrame:
    changed = rules.with_overrides(RULES, INCLUDE, EXCLUDE)
    return rules.plan(files(spark, d).select("doc_id", "rel_path", "size"), changed, "safe").select("doc_id", "status", "reason")


def directory_status(spark: SparkSession, d: str) -> DataFrame:
    return structure.directory_status(_planned(spark, d).where("project_id IS NOT NULL AND status <> 'not_planned'"))


def size_cap(spark: SparkSession, d: str) -> DataFrame:
    """Files that a size cap lets pass and those it doesn't."""
    rows = files(spark, d).groupBy((F.col("size") > LARGEST_DUMPED).alias("capped")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rows


def dump_counters(spark: SparkSession, d: str) -> DataFrame:
    return export.dump_counters(export.dump_outcomes(spread(files(spark, d).select("rel_path", "size", "text")), LARGEST_DUMPED))


def dump_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How long each file's text is in a dump, with its banner."""
    rows = table(spark, d, "documents").select("doc_id", "rel_path", "text", F.octet_length("text").cast("long").alias("size"), F.date_format("indexed_at", BANNER_TIME).alias("modified"))
    done = export.dump_outcomes(spread(rows), LARGEST_DUMPED).where("outcome = 'written'")
    return done.select("doc_id", F.length(export.file_banner(F.col("rel_path"), F.col("size"), F.coalesce("modified", F.lit("")), F.col("text"))).alias("chars"))


def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that hold secrets, each secret under the label it has all over the corpus."""
    rows = spread(files(spark, d).select("doc_id", "text"))
    return redaction.labelled_lines(rows, "doc_id", redaction.label_map(rows, "doc_id"))


def _with_project(spark: SparkSession, d: str) -> DataFrame:
    runs = store.distinct_runs(table(spark, d, "export_run")).select(F.col("id").alias("run_id"), "project_id")
    return table(spark, d, "finding").select("id", "run_id", "type", "severity", "file", "line", "rule", "message").distinct().join(runs, "run_id")


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each project's manifest, read from its JSON."""
    made = export.manifest(files(spark, d).where("project_id IS NOT NULL"), _with_project(spark, d).select(F.col("project_id").alias("project"), "severity"))
    read = F.from_json("manifest", "schema_version string, files bigint, bytes bigint, tokens bigint, languages array<struct<language:string,files:bigint,bytes:bigint>>, findings bigint, critical bigint")
    rows = made.withColumn("m", read)
    return rows.select("project", "m.files", "m.bytes", "m.tokens", F.size("m.languages").alias("languages"), "m.findings", "m.critical")


def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    """What earlier scans found, held against what an export makes itself and lines of which only placeholders are left."""
    rows = table(spark, d, "finding").distinct()
    shown = rows.select("file", "line", F.col("message").alias("content")).groupBy("file", "line").agg(F.min("content").alias("content"))
    return export.verify_summary(export.verified(rows, shown))


def message_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "finding").select("id", "message").distinct().where("message IS NOT NULL")
    return rows.groupBy(export.not_credential_shaped(F.col("message")).alias("harmless")).agg(F.count("*").alias("messages"))


def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    return findings.gates(table(spark, d, "finding").distinct())


def budget_pinned(spark: SparkSession, d: str) -> DataFrame:
    """The plan after a token budget per project; the more open markers a file has, the more it matters."""
    planned = _planned(spark, d).where("project_id IS NOT NULL")
    marks = lines.todo_markers(lines.numbered_lines(spread(files(spark, d).select("doc_id", "text")))).groupBy("doc_id").agg((F.count("*") + 1).cast("double").alias("importance"))
    fit = parts.fit_plan(planned, marks, BUDGET, RULES.pinned(F.col("rel_path")))
    return fit.select("project_id", "doc_id", "status", "reason", "severity")


def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    planned = _planned(spark, d).where("project_id IS NOT NULL")
    marks = lines.todo_markers(lines.numbered_lines(spread(files(spark, d).select("doc_id", "text")))).groupBy("doc_id").agg((F.count("*") + 1).cast("double").alias("importance"))
    return rules.plan_summary(parts.fit_plan(planned, marks, BUDGET, RULES.pinned(F.col("rel_path")))).select("status", "files", "bytes")


def oversized_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that come out larger than their limit, had packing saved nothing."""
    placed = cut(parts.archive_parts(archive_entries(spark, d), PART_BYTES))
    written = placed.groupBy("archive", "part").agg(F.sum("size").alias("bytes"))
    return parts.oversized(placed, written, PART_BYTES)


def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table of the history that are left when each project keeps its newest runs."""
    names = ["export_run", "finding", "export_snapshot", "snapshot_file"]
    # Repeated deliveries of a run are one run; a snapshot without a run belongs to none that is kept.
    tables = {n: table(spark, d, n) for n in names}
    tables["export_run"] = cut(store.distinct_runs(tables["export_run"]))
    left = stores.retained_tables(tables, KEEP_RUNS)
    counts = [left[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    done = stores.imported(table(spark, d, "legacy_history_entry"))
    return done.select("entry_id", "imported", "warning", F.coalesce("started_at", F.lit(0)).alias("started_at"))


def legacy_import_report(spark: SparkSession, d: str) -> DataFrame:
    return stores.import_report(stores.imported(table(spark, d, "legacy_history_entry")))


def new_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects that the top directories of the corpus would be, numbered after those there are."""
    top = F.split_part(F.translate("rel_path", "\\", "/"), F.lit("/"), F.lit(1))
    wanted = files(spark, d).select(F.concat(F.lit("/srv/"), top).alias("root_path"), top.alias("name")).where("rel_path IS NOT NULL").distinct()
    return stores.new_projects(wanted, table(spark, d, "project"))


def snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snapshot_file").select("snapshot_id", "rel_path", "sha256", "size_bytes", "loc").distinct()
    return rows.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "historical_blob").distinct()


def distinct_blobs(spark: SparkSession, d: str) -> DataFrame:
    rows = _blobs(spark, d).select("project_id", F.col("commit_oid").alias("oid"), "blob_id")
    return history.distinct_blobs(rows, ["blob_id"]).select("project_id", "short", "blob_id")


def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    """The newest commits of each project, by the instants that their times denote."""
    times = normalised_instants(written_times(spark, d).where("source_table = 'historical_blob'")).select(F.col("record_id").alias("blob_id"), "utc_us")
    commits = _blobs(spark, d).join(times, "blob_id").select("project_id", F.lower(F.substring("commit_oid", 1, 7)).alias("commit"), "utc_us").where("commit IS NOT NULL").groupBy("project_id", "commit").agg(F.max("utc_us").alias("utc_us"))
    return history.recent(commits, NEWEST_COMMITS, ["utc_us", "commit"], ["project_id"])


def blob_findings(spark: SparkSession, d: str) -> DataFrame:
    """Earlier findings that lie in files which historical blobs hold as well, with the commit they stem from."""
    blobs = _blobs(spark, d).select("project_id", F.col("repo_path").alias("relative"), "repo_path", "commit_oid", "committed_at", F.coalesce("summary", F.lit("")).alias("summary"))
    rows = history.placed_findings(_with_project(spark, d), blobs)
    return rows.select("project_id", "path", F.coalesce("line", F.lit(0)).alias("line"), sizes.short_oid(F.col("commit_oid")).alias("commit"), "findings")


def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """How sizes, moments, paths and ids are shown."""
    rows = files(spark, d)
    at = F.col("size") * 86_399
    forms = [sizes.utc_text(at, f).alias(k) for k, f in sizes.UTC_FORMS.items() if k != "listing"]
    return rows.select("doc_id", sizes.thousands(F.col("size") * 1000).alias("shown"), sizes.mermaid_id(F.col("rel_path")).alias("node"), sizes.escape_html(F.concat(F.lit("<a & 'b'> "), F.col("rel_path"))).alias("html"), *forms)


def refined_tokens(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("text IS NOT NULL").select("doc_id", sizes.token_estimate_of(F.col("text")).alias("tokens"))


def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as changes of a watched root, debounced by a week."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("root"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("path"))
    return stream.debounced(rows, 7 * 86_400_000)


def ignored_union(spark: SparkSession, d: str) -> DataFrame:
    """All names of directories that aren't looked into, with those that the stacks of the literal projects add."""
    found = structure.ignored_by_stack(structure.detected_stacks(literal.files(spark)))
    base = rules.IgnoredDirs()
    rows = spark.createDataFrame([(n,) for n in base.names()], "directory string")
    return rows.unionByName(found.select(F.lower("directory").alias("directory"))).distinct().withColumn("added", ~F.col("directory").isin(rules.BASE_IGNORED))


_COMMITS, _CHANGES, _TREE = "project_id long, oid string, author string, at long", "project_id long, oid string, path string, inserted long, deleted long", "project_id long, path string, oid string"
KEEP_LITERAL = 3


def literal_authors(spark: SparkSession, d: str) -> DataFrame:
    return history.by_author(literal.rows(spark, literal.COMMITS, _COMMITS))


def literal_churn(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(literal.rows(spark, literal.CHANGES, _CHANGES), literal.rows(spark, literal.COMMITS, _COMMITS), KEEP_LITERAL)


def literal_tree_diff(spark: SparkSession, d: str) -> DataFrame:
    found = history.tree_diff(literal.rows(spark, literal.BEFORE, _TREE), literal.rows(spark, literal.AFTER, _TREE))
    return found.select("project_id", "path", "status", F.coalesce("old_path", F.lit("")).alias("old_path"))


def catalogue() -> Catalogue:
    """The reports of this package, each a query."""
    from cairn.queries import code, projects

    out = Catalogue()
    for name, profiles, about, build in (
        ("summary", ALL, "Files, bytes, tokens and secrets by source.", corpus.source_risk_summary),
        ("file_statistics", MOST, "Files by extension.", corpus.inv_by_extension),
        ("dependencies", MOST, "What build files declare.", projects.build_declarations),
        ("security_scan", ALL, "Findings by kind.", corpus.scan_summary),
        ("todo", MOST, "Open markers by kind.", corpus.todo_by_kind),
        ("code_metrics", MOST, "Lines by extension.", corpus.code_metrics),
        ("config", ALL, "What configuration shows to be in use.", code.config_checklist),
        ("dependency_graph", ("quick", "full", "ai_review"), "Imports between files.", projects.import_degrees),
        ("architecture", ALL, "Directories by layer.", code.directory_layers),
        ("key_files", ALL, "Files that matter.", projects.key_file_scores),
        ("code_quality", MOST, "Files that mix concerns.", code.mixed_concerns),
        ("api_surface", REVIEW, "Routes of servers.", code.api_routes),
        ("frontend", ("full", "ai_review"), "Components and hooks.", code.code_symbols),
        ("git_timeline", REVIEW, "The newest commits.", recent_commits),
        ("refactoring", MOST, "Files that call for work.", projects.refactoring_scores),
        ("large_files", MOST, "The largest files.", corpus.top_largest_files),
        ("export_plan", ALL, "What goes out and what doesn't.", projects.plan_summary),
        ("comparison", ALL, "Changes since the snapshot before.", projects.last_export_diff),
    ):
        out.add(name, profiles, about, build)
    return out


def report_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return catalogue().table(spark)


def report_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs the reports of the smallest profile and tells how each ended."""
    done = list(run(catalogue(), "minimal", spark, d, lambda _, df: df.write.format("noop").mode("overwrite").save()))
    return spark.createDataFrame(done, "report string, outcome string, error string")


QUERIES = {
    "copy_outcomes": copy_outcomes, "copy_counters": copy_counters, "skipped_dirs": skipped_dirs, "plan_overrides": plan_overrides, "directory_status": directory_status, "size_cap": size_cap, "dump_counters": dump_counters, "dump_lengths": dump_lengths, "labelled_lines": labelled_lines, "manifests": manifests,
    "verify_summary": verify_summary, "message_shapes": message_shapes, "exit_codes": exit_codes, "budget_pinned": budget_pinned, "budget_summary": budget_summary, "oversized_parts": oversized_parts, "retention_counts": retention_counts, "legacy_import": legacy_import, "legacy_import_report": legacy_import_report,
    "new_projects": new_projects, "snapshot_totals": snapshot_totals, "distinct_blobs": distinct_blobs, "recent_commits": recent_commits, "blob_findings": blob_findings, "display_forms": display_forms, "refined_tokens": refined_tokens, "debounced_events": debounced_events, "ignored_union": ignored_union,
    "literal_authors": literal_authors, "literal_churn": literal_churn, "literal_tree_diff": literal_tree_diff, "report_catalogue": report_catalogue, "report_run": report_run,
}

# --- the same in SQL ---------------------------------------------------------------------------------------------

_PLAN = planned_sql()
_COPY = (
    _PLAN
    + r""", nm AS (SELECT DISTINCT regexp_replace(file, '^\.[\\/]', '') AS rel_path FROM finding WHERE file IS NOT NULL),
  oc AS (SELECT pl.*, CASE WHEN status = 'excluded' AND safe = reason THEN 'safety' WHEN status <> 'included' THEN 'excluded' WHEN nm.rel_path IS NULL THEN 'diff' WHEN safe IS NOT NULL THEN 'safety' WHEN text IS NULL THEN 'error' ELSE 'copied' END AS outcome
    FROM pl LEFT JOIN nm ON nm.rel_path = pl.rel_path WHERE status <> 'not_planned') """
)
_WRITTEN = f"CASE WHEN NOT ({corpus._TEXT}) THEN 'not_text' WHEN size > {LARGEST_DUMPED} THEN 'large' WHEN text IS NULL THEN 'decode' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'written' END"
_RUNS = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC NULLS LAST, project_id DESC, started_at DESC NULLS LAST) AS k FROM export_run) WHERE k = 1)"
_FOUND = "fd AS (SELECT DISTINCT id, run_id, type, severity, file, line, rule, message FROM finding)"
_UNFIT = (
    _PLAN
    + f""", mk AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i){corpus._WB}({'|'.join(corpus.lines.TODO_WORDS)}){corpus._WE}'))) AS m FROM documents),
  c AS (SELECT pl.project_id, pl.doc_id, greatest(1, CAST(round(size / 3.5) AS BIGINT)) AS tokens, (CASE WHEN m > 0 THEN m + 1.0 ELSE 1.0 END) / greatest(1, CAST(round(size / 3.5) AS BIGINT)) AS rank FROM pl LEFT JOIN mk ON mk.doc_id = pl.doc_id WHERE project_id IS NOT NULL AND status = 'included'),
  s AS (SELECT project_id, list({{'room': CAST({BUDGET} AS BIGINT), 't': tokens, 'id': doc_id, 'ok': CAST([] AS BIGINT[])}} ORDER BY rank DESC, doc_id) AS xs FROM c GROUP BY 1),
  z AS (SELECT project_id, list_reduce(list_prepend({{'room': CAST({BUDGET} AS BIGINT), 't': CAST(0 AS BIGINT), 'id': CAST(-1 AS BIGINT), 'ok': CAST([] AS BIGINT[])}}, xs),
    lambda a, x: {{'room': CASE WHEN x.t <= a.room THEN a.room - x.t ELSE a.room END, 't': x.t, 'id': x.id, 'ok': CASE WHEN x.t <= a.room THEN list_append(a.ok, x.id) ELSE a.ok END}}).ok AS ok FROM s),
  un AS (SELECT c.doc_id FROM c JOIN z ON z.project_id = c.project_id WHERE NOT list_contains(z.ok, c.doc_id)),
  fp AS (SELECT pl.project_id, pl.doc_id, size, un.doc_id IS NOT NULL AND NOT pin AS out, status, reason, severity FROM pl LEFT JOIN un ON un.doc_id = pl.doc_id WHERE pl.project_id IS NOT NULL) """
)
_LEGACY = r"""WITH en AS (SELECT DISTINCT entry_id, source_root, project_name, generated_at FROM legacy_history_entry),
  w AS (SELECT *, CASE WHEN coalesce(source_root, '') = '' THEN 'missing or empty required field ''source_root''' WHEN coalesce(project_name, '') = '' THEN 'missing or empty required field ''project_name''' WHEN generated_at IS NULL THEN 'missing required field ''generated_at'''
    WHEN NOT regexp_full_match(generated_at, '\d+-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01]) ([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d') THEN 'field ''generated_at'' is not a recognized timestamp format' ELSE '' END AS warning FROM en) """
_RULE_LINE = "-" * 100

ORACLE = {
    "copy_outcomes": _COPY + "SELECT outcome, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM oc GROUP BY 1",
    "copy_counters": _COPY
    + """, dd AS (SELECT count(DISTINCT d) AS n FROM (SELECT unnest(list_prepend('', list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/')))) AS d FROM oc WHERE outcome = 'copied'))
      SELECT greatest(1, (SELECT n FROM dd)) AS dirs_created, count(*) FILTER (outcome = 'copied') AS files_copied, count(*) FILTER (outcome = 'safety') AS files_skipped, count(*) FILTER (outcome = 'safety') AS files_skipped_by_safety, count(*) FILTER (outcome = 'diff') AS files_skipped_by_diff,
      count(*) FILTER (outcome = 'error') AS errors, (SELECT count(DISTINCT skipped[1]) FROM pl WHERE len(skipped) > 0) AS dirs_skipped FROM oc""",
    "skipped_dirs": _PLAN + "SELECT DISTINCT project_id AS project, skipped[1] AS directory FROM pl WHERE len(skipped) > 0",
    "plan_overrides": planned_sql("regexp_matches(lp, '^config/.*$') OR regexp_matches(n, '^config/.*$')", "WHEN regexp_matches(n, '^.*\\.sql$') THEN 'file rule: *.sql'").replace("string_split(a, '/')[-1] = 'reports' OR", "string_split(a, '/')[-1] = 'reports' AND NOT starts_with('config/*', a || '/') OR") + "SELECT doc_id, status, reason FROM pl",
    "directory_status": _PLAN
    + """, ds AS (SELECT project_id AS project, unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) AS directory, CASE WHEN severity IN ('critical', 'high') THEN 2 WHEN status = 'included' THEN 1 ELSE 0 END AS r FROM pl WHERE project_id IS NOT NULL AND status <> 'not_planned')
      SELECT project, directory, ['excluded', 'included', 'warning'][max(r) + 1] AS status FROM ds GROUP BY 1, 2""",
    "size_cap": f"SELECT strlen(text) > {LARGEST_DUMPED} AS capped, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "dump_counters": _FILES + f", o AS (SELECT {_WRITTEN} AS o FROM h) SELECT count(*) AS scanned, count(*) FILTER (o = 'written') AS written, " + ", ".join(f"count(*) FILTER (o = '{o}') AS skipped_{o}" for o in ("binary", "large", "decode", "not_text")) + " FROM o",
    "dump_lengths": _FILES
    + f""", t AS (SELECT doc_id, coalesce(strftime(indexed_at, '%Y-%m-%d %H:%M:%S'), '') AS m FROM documents)
      SELECT h.doc_id, CAST(length(concat_ws(chr(10), '', '{_RULE_LINE}', 'File: ' || replace(rel_path, '/', '\\'), 'Name: ' || string_split(p, '/')[-1], 'Size: ' || format('{{:,}}', size) || ' bytes', 'Modified: ' || m, '{_RULE_LINE}', '', regexp_replace(text, '\\n?$', chr(10)))) AS INT) AS chars FROM h JOIN t ON t.doc_id = h.doc_id WHERE {_WRITTEN} = 'written'""",
    "manifests": _FILES
    + f""", {_RUNS}, {_FOUND}, fs AS (SELECT project_id AS project, count(*) AS findings, count(*) FILTER (lower(severity) = 'critical') AS critical FROM fd JOIN r ON r.id = fd.run_id GROUP BY 1)
      SELECT project_id AS project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, greatest(1, CAST(round(sum(size) / 3.5) AS BIGINT)) AS tokens, CAST(count(DISTINCT {corpus._LANG}) AS INT) AS languages, coalesce(max(findings), 0) AS findings, coalesce(max(critical), 0) AS critical
      FROM h LEFT JOIN fs ON fs.project = h.project_id WHERE project_id IS NOT NULL GROUP BY 1""",
    "verify_summary": r"""WITH fd AS (SELECT DISTINCT * FROM finding), sh AS (SELECT file, line, min(message) AS c FROM fd GROUP BY 1, 2),
      g AS (SELECT fd.*, lower(regexp_replace(replace(fd.file, '\', '/'), '^(\./|/)+', '')) AS p, sh.c FROM fd LEFT JOIN sh ON sh.file = fd.file AND sh.line = fd.line),
      x AS (SELECT type, severity, starts_with(p, 'reports/insights/') OR p IN ('manifest.json', 'project_profile.json', 'index.md', 'reports/01_structure.txt', 'report_plugins.json') OR coalesce(NOT regexp_matches(regexp_replace(c, '<REDACTED(_SECRET_LINE|_SECRET|:[A-Za-z0-9]*)?>?', ' ', 'g'), '[A-Za-z0-9]{12}'), false) AS generated FROM g)
      SELECT count(*) FILTER (type = 'sensitive_file' AND NOT generated) AS sensitive_files, count(*) FILTER (type = 'potential_secret' AND NOT generated) AS potential_secrets, count(*) FILTER (type = 'risky_code' AND NOT generated) AS risky_code, count(*) FILTER (NOT generated) AS total_findings,
      count(*) FILTER (lower(severity) = 'critical' AND NOT generated) AS critical, count(*) FILTER (generated) AS generated FROM x""",
    "message_shapes": "SELECT NOT regexp_matches(regexp_replace(message, '<REDACTED(_SECRET_LINE|_SECRET|:[A-Za-z0-9]*)?>?', ' ', 'g'), '[A-Za-z0-9]{12}') AS harmless, count(*) AS messages FROM (SELECT DISTINCT id, message FROM finding WHERE message IS NOT NULL) GROUP BY 1",
    "exit_codes": """WITH f AS (SELECT CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS k FROM (SELECT DISTINCT * FROM finding))
      SELECT fail_on, count(*) FILTER (k <= r) AS gating, CASE WHEN count(*) FILTER (k <= r) > 0 THEN 3 ELSE 0 END AS exit_code FROM f, (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)) AS v(fail_on, r) GROUP BY fail_on""",
    "budget_pinned": _UNFIT + f"SELECT project_id, doc_id, CASE WHEN out THEN 'excluded' ELSE status END AS status, CASE WHEN out THEN '{parts.UNFIT}' ELSE reason END AS reason, CASE WHEN out THEN 'info' ELSE severity END AS severity FROM fp",
    "budget_summary": _UNFIT + "SELECT CASE WHEN out THEN 'excluded' ELSE status END AS status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fp GROUP BY 1",
    "oversized_parts": _PARTS + f"SELECT archive, CAST(part AS BIGINT) AS part, CAST(sum(s) AS BIGINT) AS bytes, count(*) AS entries, max(s) AS largest, count(*) > 1 AS replan FROM placed GROUP BY 1, 2 HAVING sum(s) > {PART_BYTES}",
    "retention_counts": f"""WITH {_RUNS}, k AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, id DESC) AS m FROM r WHERE finished_at IS NOT NULL) WHERE m <= {KEEP_RUNS}), sn AS (SELECT * FROM export_snapshot SEMI JOIN k ON k.id = export_snapshot.run_id)
      SELECT 'export_run' AS "table", count(*) AS rows FROM r SEMI JOIN k ON k.id = r.id UNION ALL SELECT 'finding', count(*) FROM finding SEMI JOIN k ON k.id = finding.run_id UNION ALL SELECT 'export_snapshot', count(*) FROM sn
      UNION ALL SELECT 'snapshot_file', count(*) FROM snapshot_file SEMI JOIN sn ON sn.id = snapshot_file.snapshot_id""",
    "legacy_import": _LEGACY
    + """SELECT entry_id, warning = '' AS imported, warning, CASE WHEN warning = '' THEN epoch(make_date(CAST(split_part(generated_at, '-', 1) AS BIGINT), CAST(split_part(generated_at, '-', 2) AS BIGINT), 1))::BIGINT + (CAST(split_part(split_part(generated_at, ' ', 1), '-', 3) AS BIGINT) - 1) * 86400
      + CAST(split_part(split_part(generated_at, ' ', 2), ':', 1) AS BIGINT) * 3600 + CAST(split_part(split_part(generated_at, ' ', 2), ':', 2) AS BIGINT) * 60 + CAST(split_part(split_part(generated_at, ' ', 2), ':', 3) AS BIGINT) ELSE 0 END AS started_at FROM w""",
    "legacy_import_report": _LEGACY + "SELECT warning, count(*) AS entries FROM w GROUP BY 1",
    "new_projects": """WITH w AS (SELECT DISTINCT '/srv/' || split_part(replace(rel_path, '\\', '/'), '/', 1) AS root_path, split_part(replace(rel_path, '\\', '/'), '/', 1) AS name FROM documents WHERE rel_path IS NOT NULL)
      SELECT CAST((SELECT coalesce(max(id), 0) FROM project) + row_number() OVER (ORDER BY root_path) AS BIGINT) AS id, root_path, name FROM w ANTI JOIN project p ON p.root_path = w.root_path""",
    "snapshot_totals": "SELECT snapshot_id, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT snapshot_id, rel_path, sha256, size_bytes, loc FROM snapshot_file) GROUP BY 1",
    "distinct_blobs": "SELECT project_id, lower(substr(commit_oid, 1, 7)) AS short, max(blob_id) AS blob_id FROM historical_blob WHERE commit_oid IS NOT NULL GROUP BY 1, 2",
    "blob_findings": rf"""WITH {_RUNS}, {_FOUND}, bl AS (SELECT DISTINCT project_id, lower(replace(regexp_replace(repo_path, '^\.[\\/]', ''), '\', '/')) AS k, repo_path, commit_oid, committed_at, coalesce(summary, '') AS summary FROM historical_blob WHERE repo_path IS NOT NULL),
      b0 AS (SELECT DISTINCT blob_id, project_id, relative, repo_path, commit_oid, committed_at, summary FROM historical_blob WHERE repo_path IS NOT NULL),
      hit AS (SELECT b.project_id, b.repo_path AS path, fd.line, b.commit_oid, b.committed_at, coalesce(b.summary, '') AS summary FROM fd JOIN r ON r.id = fd.run_id JOIN b0 b ON b.project_id = r.project_id AND lower(replace(b.repo_path, '\', '/')) = lower(replace(regexp_replace(fd.file, '^\.[\\/]', ''), '\', '/')))
      SELECT project_id, path, coalesce(line, 0) AS line, substr(max(commit_oid), 1, 7) AS commit, count(*) AS findings FROM hit GROUP BY project_id, path, line""",
    "display_forms": _FILES
    + """SELECT doc_id, format('{:,}', size * 1000) AS shown, regexp_replace(rel_path, '[^A-Za-z0-9_]', '_', 'g') AS node, '&lt;a &amp; &#x27;b&#x27;&gt; ' || replace(replace(replace(replace(replace(rel_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
      strftime(make_timestamp(size * 86399000000), '%Y-%m-%d %H:%M:%S') AS human, strftime(make_timestamp(size * 86399000000), '%Y%m%d_%H%M%S') AS compact, strftime(make_timestamp(size * 86399000000), '%Y-%m-%d %H:%M:%S UTC') AS zoned FROM h""",
    "refined_tokens": "SELECT doc_id, greatest(1, CAST(round(strlen(text) / CASE WHEN len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) * 2 > length(text) THEN 1.9 * 2.5 ELSE 3.8 END) AS BIGINT)) AS tokens FROM documents WHERE text IS NOT NULL",
    "debounced_events": """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS root, epoch_us(ts) // 1000 AS tms, event_type AS path FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
      xs AS (SELECT root, list({'tms': tms, 'path': path, 'last': CAST(NULL AS BIGINT), 'pend': CAST([] AS VARCHAR[]), 'out': CAST([] AS STRUCT(tms BIGINT, path VARCHAR)[])} ORDER BY tms, path) AS xs FROM ev GROUP BY 1),
      fd AS (SELECT root, list_reduce(list_prepend({'tms': CAST(0 AS BIGINT), 'path': '', 'last': CAST(NULL AS BIGINT), 'pend': CAST([] AS VARCHAR[]), 'out': CAST([] AS STRUCT(tms BIGINT, path VARCHAR)[])}, xs), lambda a, x: CASE WHEN a.last IS NULL OR x.tms - a.last >= 604800000
        THEN {'tms': x.tms, 'path': x.path, 'last': x.tms, 'pend': CAST([] AS VARCHAR[]), 'out': list_concat(a.out, list_transform(list_sort(list_distinct(list_append(a.pend, x.path))), lambda p: {'tms': x.tms, 'path': p}))}
        ELSE {'tms': x.tms, 'path': x.path, 'last': a.last, 'pend': list_append(a.pend, x.path), 'out': a.out} END).out AS o FROM xs), u AS (SELECT root, unnest(o) AS r FROM fd)
      SELECT root, r.tms AS "at", r.path AS path FROM u""",
    "literal_authors": "WITH " + literal.values_sql("c", literal.COMMITS, "project_id, oid, author, at_") + " SELECT project_id, author, count(DISTINCT oid) AS commits FROM c GROUP BY 1, 2",
    "literal_churn": "WITH " + literal.values_sql("c", literal.COMMITS, "project_id, oid, author, at_") + ", " + literal.values_sql("g", literal.CHANGES, "project_id, oid, path, ins, del")
    + f""", k AS (SELECT project_id, oid FROM (SELECT project_id, oid, row_number() OVER (PARTITION BY project_id ORDER BY at_ DESC, oid DESC) AS k FROM (SELECT DISTINCT project_id, oid, at_ FROM c)) WHERE k <= {KEEP_LITERAL})
      SELECT g.project_id, path, CAST(sum(ins + del) AS BIGINT) AS churn, count(DISTINCT g.oid) AS touches FROM g SEMI JOIN k ON k.project_id = g.project_id AND k.oid = g.oid GROUP BY 1, 2""",
    "literal_tree_diff": "WITH " + literal.values_sql("b", literal.BEFORE, "project_id, path, oid") + ", " + literal.values_sql("n", literal.AFTER, "project_id, path, oid")
    + """, gone AS (SELECT b.*, row_number() OVER (PARTITION BY b.project_id, b.oid ORDER BY b.path) AS k FROM b ANTI JOIN n ON n.project_id = b.project_id AND n.path = b.path), made AS (SELECT n.*, row_number() OVER (PARTITION BY n.project_id, n.oid ORDER BY n.path) AS k FROM n ANTI JOIN b ON b.project_id = n.project_id AND b.path = n.path)
      SELECT n.project_id, n.path, 'modified' AS status, '' AS old_path FROM n JOIN b ON b.project_id = n.project_id AND b.path = n.path WHERE b.oid <> n.oid
      UNION ALL SELECT coalesce(m.project_id, g.project_id), coalesce(m.path, g.path), CASE WHEN m.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END, CASE WHEN m.path IS NOT NULL THEN coalesce(g.path, '') ELSE '' END FROM made m FULL JOIN gone g ON g.project_id = m.project_id AND g.oid = m.oid AND g.k = m.k""",
    "report_catalogue": "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS INT), '{r.name}', '{p}', {str(p == 'full' or p in r.profiles).lower()})" for k, r in enumerate(catalogue().reports.values(), 1) for p in ALL) + ") AS v(place, report, profile, runs)",
    "ignored_union": literal.over(_STACKS + f", b AS (SELECT unnest([{_DIRS}]) AS directory), u AS (SELECT directory FROM b UNION SELECT lower(unnest(dirs)) FROM st) SELECT directory, directory NOT IN (SELECT directory FROM b) AS added FROM u"),
}
