"""Queries over the files of the corpus: inventory, classes, policies, lines, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import classify, detect, paths, policy, sizes
from cairn.operators import findings, inventory, lines, redaction
from cairn.runtime import spread, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files: doc_id, project_id, rel_path, source, lang, text, size in bytes."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", "project_id", "rel_path", "source", "lang", "text", F.octet_length("text").cast("long").alias("size"))


def _path() -> F.Column:
    return F.col("rel_path")


# --- inventory ---------------------------------------------------------------------------------------------------


def inv_by_extension(spark: SparkSession, d: str) -> DataFrame:
    return inventory.by_key(files(spark, d), paths.extension_key(_path()), "extension")


def inv_by_language(spark: SparkSession, d: str) -> DataFrame:
    return inventory.by_key(files(spark, d), F.coalesce(classify.language(_path()), F.lit("unknown")), "language")


def inv_totals(spark: SparkSession, d: str) -> DataFrame:
    return inventory.totals(files(spark, d))


def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return inventory.folder_sizes(files(spark, d))


def top_largest_files(spark: SparkSession, d: str) -> DataFrame:
    return inventory.largest(files(spark, d).select("doc_id", "rel_path", "size"))


def deepest_paths(spark: SparkSession, d: str) -> DataFrame:
    return inventory.deepest(files(spark, d).select("doc_id", "rel_path"))


def repeated_file_names(spark: SparkSession, d: str) -> DataFrame:
    return inventory.repeated_names(files(spark, d))


def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    return inventory.same_content(files(spark, d))


def plan_groups(spark: SparkSession, d: str) -> DataFrame:
    return inventory.by_key(files(spark, d), classify.plan_group(_path()), "plan_group")


def archive_groups(spark: SparkSession, d: str) -> DataFrame:
    return inventory.by_key(files(spark, d), classify.archive_group(_path(), F.lit("core")), "archive_group")


def text_files(spark: SparkSession, d: str) -> DataFrame:
    return inventory.by_key(files(spark, d), classify.is_text(_path()), "is_text")


def path_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Per path: depth, parent, name, whether it is a test, what is suspicious about it."""
    rows = files(spark, d).select("rel_path").distinct()
    return rows.select("rel_path", paths.depth(_path()).alias("depth"), paths.parent(_path()).alias("parent"), paths.name(_path()).alias("name"), paths.is_test(_path()).alias("is_test"), paths.suspicious(_path()).alias("suspicious"))


def sizes_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d)
    return rows.select("doc_id", "size", sizes.token_estimate(F.col("size")).alias("tokens"), sizes.format_bytes(F.col("size")).alias("shown"))


# --- policies ----------------------------------------------------------------------------------------------------


def _policy(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = files(spark, d).withColumn("s", policy.safety(_path(), mode))
        return rows.groupBy(F.coalesce("s.reason", F.lit("included")).alias("reason"), F.coalesce("s.severity", F.lit("info")).alias("severity")).agg(F.count("*").alias("files"))

    return query


def sensitive_files(spark: SparkSession, d: str) -> DataFrame:
    return findings.sensitive_files(files(spark, d).select("doc_id", "rel_path"))


# --- lines -------------------------------------------------------------------------------------------------------


def loc_counts(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(F.col("text").isNotNull()).select("doc_id", lines.non_empty_lines(F.col("text")).alias("loc"))


def code_metrics(spark: SparkSession, d: str) -> DataFrame:
    return lines.code_metrics(_texts(spark, d, "rel_path", "text"))


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Files whose whole texts are gone through."""
    return spread(files(spark, d).select(*(columns or ("doc_id", "text"))))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered_lines(_texts(spark, d))


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines per document, and the characters in them."""
    return _lines(spark, d).groupBy("doc_id").agg(F.max("line").alias("lines"), F.sum(F.length("content")).alias("chars"))


def todo_markers(spark: SparkSession, d: str) -> DataFrame:
    return lines.todo_markers(_lines(spark, d)).select("doc_id", "line", "kind")


def todo_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return todo_markers(spark, d).groupBy("kind").agg(F.count("*").alias("markers"))


def _matching(pattern: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _lines(spark, d).where(F.col("content").rlike(pattern)).select("doc_id", "line")

    return query


def provider_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("p", detect.provider(F.col("content"))).where(F.col("p").isNotNull())
    return rows.select("doc_id", "line", "p.rule", "p.confidence")


def entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where(F.col("content").rlike(r"[A-Za-z0-9+/=_\-]{20}"))
    each = rows.select("doc_id", "line", F.explode(detect.entropy_tokens(F.col("content"))).alias("t"))
    return each.groupBy("doc_id", "line").agg(F.count("*").alias("tokens"), F.round(F.max("t.bits"), 6).alias("most_bits"))


def risky_code(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", "line", F.explode(detect.risky(F.col("content"))).alias("r"))
    return rows.select("doc_id", "line", "r.rule", "r.severity")


def secret_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where(F.col("content").rlike(findings.PREFILTER)).withColumn("s", detect.secret(F.col("content")))
    return rows.where(F.col("s").isNotNull()).groupBy("s.rule", "s.confidence").agg(F.count("*").alias("lines"))


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its redacted message."""
    return findings.scan(_texts(spark, d, "rel_path", "text")).distinct()


def scan_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every finding without its message; those of sensitive files have line 0."""
    found = findings.scan(_texts(spark, d, "rel_path", "text"))
    return found.select("type", "severity", "confidence", "file", F.coalesce("line", F.lit(0)).alias("line"), "rule").distinct()


def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.summary(findings.scan(_texts(spark, d, "rel_path", "text")))


def fail_on_gate(spark: SparkSession, d: str) -> DataFrame:
    return findings.gate(findings.scan(_texts(spark, d, "rel_path", "text")), "high")


def earlier_finding_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What earlier scans reported, by kind and severity; repeated rows and other spellings of a severity count once."""
    rows = table(spark, d, "finding").select("id", "type", F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity"), "rule").distinct()
    return rows.groupBy("type", "severity", "rule").agg(F.count("*").alias("findings"))


def allowlist_screen(spark: SparkSession, d: str) -> DataFrame:
    """Earlier findings against an allow list of those of the first hundred runs."""
    rows = table(spark, d, "finding").select("id", "run_id", "rule", "file", "message").distinct().where("rule IS NOT NULL AND file IS NOT NULL AND message IS NOT NULL")
    marked = rows.withColumn("fingerprint", detect.fingerprint(F.col("rule"), F.col("file"), F.col("message")))
    allowed = marked.where("run_id <= 100").select("fingerprint", F.lit("accepted").alias("reason"))
    out = findings.screened(rows, allowed)
    return out.groupBy("suppressed", "reason").agg(F.countDistinct("fingerprint").alias("fingerprints"), F.count("*").alias("findings"))


def source_risk_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per source: files, bytes, tokens, lines, and lines with secrets by confidence. The flagship query."""
    rows = _texts(spark, d, "source", "text", "size").withColumn("source", F.coalesce("source", F.lit("")))
    # One pass: a file's own figures go with its first line, or with the row of a file without lines.
    each = rows.select("source", "size", F.posexplode_outer(lines.split_lines(F.col("text"))).alias("at", "content"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    level = F.when(F.col("content").rlike(findings.PREFILTER), detect.keyword_confidence(F.col("content")))
    each = each.select("source", "content", level.alias("k"), *(F.when(first, c).alias(n) for n, c in (("size", F.col("size")), ("tokens", sizes.token_estimate(F.col("size"))), ("file", F.lit(1)))))
    sums = [F.count("file").alias("files"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("content").alias("lines")]
    return each.groupBy("source").agg(*sums, *(F.count_if(F.col("k") == c).alias(c) for c in ("critical", "high", "medium", "low")))


def redact_lines(spark: SparkSession, d: str) -> DataFrame:
    return redaction.redacted_lines(_texts(spark, d))


def stable_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of the distinct secrets; the secrets themselves stay inside."""
    labels = redaction.label_map(files(spark, d).select("doc_id", "text"), "doc_id")
    return labels.select("label", F.length("secret").alias("secret_chars"))


def placeholder_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "finding").select("id", "rule", "message").distinct()
    return redaction.placeholder_counts(rows, ["rule"], "message")


QUERIES = {
    "source_risk_summary": source_risk_summary,
    "inv_by_extension": inv_by_extension, "inv_by_language": inv_by_language, "inv_totals": inv_totals, "folder_rollup": folder_rollup, "top_largest_files": top_largest_files,
    "deepest_paths": deepest_paths, "repeated_file_names": repeated_file_names, "duplicate_contents": duplicate_contents, "plan_groups": plan_groups, "archive_groups": archive_groups,
    "text_files": text_files, "path_shapes": path_shapes, "sizes_and_tokens": sizes_and_tokens,
    "safety_policy_safe": _policy("safe"), "safety_policy_balanced": _policy("balanced"), "safety_policy_full": _policy("full"), "sensitive_files": sensitive_files,
    "loc_counts": loc_counts, "code_metrics": code_metrics, "line_numbers": line_numbers, "todo_markers": todo_markers, "todo_by_kind": todo_by_kind,
    "secret_keyword_value": _matching(detect.VALUE), "secret_assignment": _matching(detect.ASSIGNMENT), "secret_mention": _matching(detect.MENTION), "secret_bearer": _matching(detect.BEARER),
    "private_key_headers": _matching(detect.ARMOR), "telegram_tokens": _matching(detect.TELEGRAM), "url_credentials": _matching(detect.URL_PASSWORD), "http_auth": _matching(detect.HTTP_AUTH),
    "provider_signatures": provider_signatures, "entropy_tokens": entropy_tokens, "risky_code": risky_code, "secret_cascade": secret_cascade, "scan_findings": scan_findings, "scan_positions": scan_positions,
    "scan_summary": scan_summary, "fail_on_gate": fail_on_gate, "earlier_finding_kinds": earlier_finding_kinds, "allowlist_screen": allowlist_screen,
    "redact_lines": redact_lines, "stable_labels": stable_labels, "placeholder_counts": placeholder_counts,
}

# --- the same in SQL ---------------------------------------------------------------------------------------------


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_FILES = r"""
WITH f AS (
  SELECT doc_id, project_id, rel_path, source, lang, text, CAST(strlen(text) AS BIGINT) AS size,
         replace(rel_path, '\', '/') AS p, lower(replace(rel_path, '\', '/')) AS lp FROM documents),
g AS (SELECT *, string_split(lp, '/')[-1] AS n, regexp_extract(string_split(lp, '/')[-1], '^.+\.([^.]*)$', 1) AS e,
         list_filter(string_split(p, '/'), lambda x: x <> '') AS parts, list_filter(string_split(lp, '/'), lambda x: x <> '') AS lparts FROM f),
h AS (SELECT *, CASE WHEN n = 'dockerfile' OR starts_with(n, 'dockerfile.') THEN 'dockerfile' WHEN e = '' THEN '[no extension]' ELSE e END AS ek,
         array_to_string(parts[:-2], '/') AS parent FROM g)
"""


def _case(value: str, groups: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {value} IN {_in(es.split())} THEN {chr(39)}{g}{chr(39)}' for g, es in groups.items())} ELSE {default} END"


_STEM = "split_part(n, '.', 1)"


def _named(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} END"


_LANG = f"coalesce({_named('n', classify.LANGUAGE_NAMES)}, {_named('ek', classify.LANGUAGES)}, CASE WHEN contains(n, '.') THEN {_named(_STEM, classify.LANGUAGE_NAMES)} END, 'unknown')"
_PLAN = f"""CASE WHEN len(list_filter(lparts, lambda x: x IN ('test', 'tests', '__tests__'))) > 0 OR starts_with(n, 'test_') THEN 'tests'
  WHEN starts_with(n, 'dockerfile') AND e NOT IN {_in([x for g in ("python_source", "frontend_source", "backend_or_system_source", "docs") for x in classify.PLAN_GROUPS[g].split()])} THEN 'config_and_locks'
  WHEN n IN ('readme.md', 'license') THEN 'docs' ELSE {_case("e", classify.PLAN_GROUPS, "'other'")} END"""
_ARCHIVE = f"""CASE WHEN lparts[1] IN ('index.md', 'manifest.json', 'project_profile.json') THEN '00_metadata'
  WHEN lparts[1] = 'reports' AND list_contains(lparts, 'ai_context') THEN '02_ai_context' WHEN lparts[1] = 'reports' AND list_contains(lparts, 'ai_prompts') THEN '03_ai_prompts'
  WHEN lparts[1] = 'reports' THEN '01_reports' WHEN list_has_any(lparts, ['test', 'tests', '__tests__', 'spec']) THEN '20_tests'
  WHEN n IN ('readme.md', 'license', 'changelog.md') THEN '30_docs'
  WHEN starts_with(n, 'dockerfile') AND e NOT IN {_in([x for g in ("30_docs", "40_python_source", "41_frontend_source", "42_backend_or_system_source") for x in classify.ARCHIVE_GROUPS[g].split()])} THEN '50_config_and_locks'
  ELSE {_case("e", classify.ARCHIVE_GROUPS, "CASE WHEN lparts[1] = 'core' THEN '80_other_project_files' ELSE '90_other' END")} END"""
_TEXT = f"CASE WHEN n IN {_in(classify.TEXT_NAMES)} THEN true WHEN e IN {_in(classify.BINARY_EXTENSIONS)} THEN false ELSE e IN {_in(classify.TEXT_EXTENSIONS)} END"
_BY = "SELECT {key} AS {name}, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM h GROUP BY 1"

_LINES = r"""
WITH l0 AS (SELECT doc_id, source, rel_path, text, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS pieces FROM documents WHERE text IS NOT NULL AND text <> ''),
l AS (SELECT doc_id, source, rel_path, unnest(range(1, len(pieces) + 1)) AS line, regexp_replace(unnest(pieces), '\r$', '') AS content FROM l0)
"""
_WB, _WE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _re2(pattern: str) -> str:
    """The pattern for an engine without lookaround: the boundary's character is taken in, case folds where told."""
    return pattern.replace(r"(?<![\p{L}\p{N}_])", _WB).replace(r"(?![\p{L}\p{N}_])", _WE).replace("'", "''")


# After a name comes a blank or an operator, which is a boundary already; taking it in would lose it.
_RE = {
    "value": _re2(detect.VALUE).replace(_WE + r"[ \t]*[:=]", r"[ \t]*[:=]"), "assignment": _re2(detect.ASSIGNMENT).replace(_WE + r"[ \t]*[:=]", r"[ \t]*[:=]"), "mention": _re2(detect.MENTION),
    "bearer": _re2(detect.BEARER).replace(_WE + r"[ \t]+", r"[ \t]+"), "armor": detect.ARMOR, "telegram": detect.TELEGRAM, "url": detect.URL_PASSWORD, "http": _re2(detect.HTTP_AUTH).replace(_WE + r"[ \t]+", r"[ \t]+"),
}
_HIT = lambda k: _LINES + f"SELECT doc_id, line FROM l WHERE regexp_matches(content, '{_RE[k]}')"
_CONF = f"""CASE WHEN regexp_matches(content, '{_RE["armor"]}') THEN 'critical' WHEN regexp_matches(content, '{_RE["value"]}') OR regexp_matches(content, '{_RE["bearer"]}') THEN 'high'
  WHEN regexp_matches(content, '{_RE["assignment"]}') THEN 'medium' WHEN regexp_matches(content, '{_RE["mention"]}') AND NOT regexp_matches(ltrim(content), '^(#|//|\\*)') THEN 'low' END"""
_PROVIDER = "CASE " + " ".join(f"WHEN regexp_matches(content, '{_re2(p)}') THEN {{'rule': '{r}', 'confidence': '{c}'}}" for r, p, c in detect.PROVIDERS) + " END"
_TRIMMED = "trim(translate(content, chr(9) || chr(13) || chr(12), '   '))"
_RISKY = {
    "python-eval": f"regexp_matches(content, '{_WB}eval\\s*\\(')", "python-exec": f"regexp_matches(content, '{_WB}exec\\s*\\(')",
    "subprocess-shell-true": f"regexp_matches(content, '(?i)subprocess[\\p{{L}}\\p{{N}}_.]*\\(') AND regexp_matches(content, '(?i){_WB}shell\\s*=\\s*true')",
    "pickle-load": f"regexp_matches(content, '{_WB}pickle\\.loads?\\s*\\(')", "unsafe-yaml-load": "regexp_matches(content, 'yaml\\.load\\s*\\(')", "js-eval": f"regexp_matches(content, '{_WB}eval\\s*\\(')",
    "inner-html": "regexp_matches(content, '\\.innerHTML\\s*=([^=]|$)')", "document-write": "regexp_matches(content, 'document\\.write\\s*\\(')",
    "local-storage-token": "regexp_matches(content, '(?i)localStorage[\\p{L}\\p{N}_.]*\\(.*(token|jwt|secret|password)')",
}
_SEVERITY = {r: s for r, s, _, _ in detect.RISKY}
_ENTROPY = (
    _LINES
    + r""", t AS (SELECT doc_id, line, content, unnest(list_filter(regexp_extract_all(content, '[A-Za-z0-9+/=_\-]+'), lambda x: length(x) >= 20)) AS token FROM l),
b AS (SELECT *, list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)) * log2((length(token) - length(replace(token, c, ''))) / length(token)))) AS bits FROM t),
hit AS (SELECT * FROM b WHERE bits >= 4.0 OR (length(token) >= 32 AND bits >= 3.0))
"""
)
_SKIP = {
    "safe": [f"(n IN {_in(policy.HIGH_RISK_NAMES)} OR (starts_with(n, '.env') AND NOT (ends_with(n, '.example') OR ends_with(n, '.sample'))))", f"e IN {_in(policy.SAFE_SUFFIXES)}"],
}


def _policy_sql(mode: str) -> str:
    risk = _SKIP["safe"][0]
    if mode == "full":
        return _FILES + "SELECT 'included' AS reason, 'info' AS severity, count(*) AS files FROM h GROUP BY 1, 2"
    if mode == "balanced":
        reason = f"CASE WHEN {risk} THEN 'high-risk credential filename' WHEN e IN {_in(policy.BALANCED_SUFFIXES)} THEN 'credential/key suffix .' || e ELSE 'included' END"
    else:
        reason = f"CASE WHEN {risk} THEN 'high-risk credential filename' WHEN contains(n, 'secret') OR contains(n, 'credential') OR contains(n, 'private') THEN 'secret-like filename' WHEN e IN {_in(policy.SAFE_SUFFIXES)} THEN 'sensitive/binary suffix .' || e ELSE 'included' END"
    return _FILES + f", r AS (SELECT {reason} AS reason FROM h) SELECT reason, CASE WHEN reason = 'included' THEN 'info' WHEN starts_with(reason, 'high-risk') THEN 'critical' ELSE 'high' END AS severity, count(*) AS files FROM r GROUP BY 1, 2"


_BITS = "list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: -((length(x) - length(replace(x, c, ''))) / length(x)) * log2((length(x) - length(replace(x, c, ''))) / length(x))))"
_SELF = " OR ".join(f"contains(content, '{h}')" for h in detect.SELF_HINTS)
_PREFIX = "substr(content, 1, strpos(content, tok) - 1)"
#: rule and confidence of the one secret that each line is reported for.
_CASCADE = (
    _LINES
    + f""", k0 AS (SELECT *, {_CONF} AS k, {_PROVIDER} AS p, list_filter(regexp_extract_all(content, '[A-Za-z0-9+/=_\\-]+'), lambda x: length(x) >= 20 AND ({_BITS} >= 4.0 OR (length(x) >= 32 AND {_BITS} >= 3.0)))[1] AS tok FROM l WHERE NOT ({_SELF})),
  k1 AS (SELECT *, CASE WHEN tok IS NOT NULL THEN (SELECT {_BITS} FROM (SELECT tok AS x)) END AS bits FROM k0),
  cs AS (SELECT doc_id, rel_path, line, CASE WHEN k IN ('critical', 'high') THEN {{'rule': 'secret_like_line', 'confidence': k}} WHEN p IS NOT NULL THEN p WHEN regexp_matches(content, '{_RE["telegram"]}') THEN {{'rule': 'telegram-bot-token', 'confidence': 'critical'}}
    WHEN k IS NOT NULL THEN {{'rule': 'secret_like_line', 'confidence': k}} WHEN regexp_matches(content, '{_RE["url"]}') THEN {{'rule': 'url-credentials', 'confidence': 'high'}} WHEN regexp_matches(content, '{_RE["http"]}') THEN {{'rule': 'http-auth-credentials', 'confidence': 'high'}}
    WHEN tok IS NOT NULL THEN {{'rule': 'high-entropy-token', 'confidence': ['low', 'medium', 'high'][1 + CASE WHEN (length(tok) >= 40 AND bits >= 4.8) OR (length(tok) >= 48 AND bits >= 3.6) THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(rtrim({_PREFIX}), '[=:]$') OR regexp_matches({_PREFIX}, '{_RE["assignment"]}') THEN 1 ELSE 0 END]}} END AS s FROM k1) """
)
_RISKY_ROWS = " UNION ALL ".join(f"SELECT doc_id, rel_path, line, '{r}' AS rule, '{_SEVERITY[r]}' AS severity FROM l WHERE {c}" for r, c in _RISKY.items())
#: Every finding of the scan, but for its message.
_SCANNED = (
    _CASCADE
    + f""", nm AS (SELECT doc_id, string_split(lower(replace(rel_path, '\\', '/')), '/')[-1] AS n FROM documents), ne AS (SELECT doc_id, n, regexp_extract(n, '^.+\\.([^.]*)$', 1) AS e FROM nm), tx AS (SELECT doc_id FROM ne WHERE {_TEXT}),
  al AS (SELECT 'sensitive_file' AS type, CASE WHEN starts_with(n, '.env') OR e IN ('key', 'pem', 'p12', 'pfx') THEN 'critical' ELSE 'high' END AS severity FROM ne WHERE n IN {_in(policy.SENSITIVE_NAMES)} OR e IN {_in(policy.SENSITIVE_SUFFIXES)} OR (starts_with(n, '.env') AND NOT (ends_with(n, '.example') OR ends_with(n, '.sample')))
    UNION ALL SELECT 'potential_secret', s.confidence FROM cs SEMI JOIN tx ON tx.doc_id = cs.doc_id WHERE s IS NOT NULL UNION ALL SELECT 'risky_code', severity FROM ({_RISKY_ROWS}) r SEMI JOIN tx ON tx.doc_id = r.doc_id) """
)

ORACLE = {
    "secret_cascade": _CASCADE + "SELECT s.rule AS rule, s.confidence AS confidence, count(*) AS lines FROM cs WHERE s IS NOT NULL GROUP BY 1, 2",
    "scan_positions": _SCANNED
    + rf""", sh AS (SELECT doc_id, '.\' || replace(rel_path, '/', '\') AS file FROM documents), al2 AS (
      SELECT 'sensitive_file' AS type, CASE WHEN starts_with(n, '.env') OR e IN ('key', 'pem', 'p12', 'pfx') THEN 'critical' ELSE 'high' END AS severity, 'high' AS confidence, doc_id, 0 AS line, 'sensitive_file' AS rule FROM ne WHERE n IN {_in(policy.SENSITIVE_NAMES)} OR e IN {_in(policy.SENSITIVE_SUFFIXES)} OR (starts_with(n, '.env') AND NOT (ends_with(n, '.example') OR ends_with(n, '.sample')))
      UNION ALL SELECT 'potential_secret', s.confidence, s.confidence, cs.doc_id, line, s.rule FROM cs SEMI JOIN tx ON tx.doc_id = cs.doc_id WHERE s IS NOT NULL UNION ALL SELECT 'risky_code', severity, 'medium', r.doc_id, line, rule FROM ({_RISKY_ROWS}) r SEMI JOIN tx ON tx.doc_id = r.doc_id)
      SELECT DISTINCT type, severity, confidence, file, CAST(line AS INT) AS line, rule FROM al2 JOIN sh ON sh.doc_id = al2.doc_id""",
    "scan_summary": _SCANNED + "SELECT count(*) FILTER (type = 'sensitive_file') AS sensitive_file, count(*) FILTER (type = 'potential_secret') AS potential_secret, count(*) FILTER (type = 'risky_code') AS risky_code, count(*) FILTER (severity = 'critical') AS critical FROM al",
    "fail_on_gate": _SCANNED + "SELECT count(*) FILTER (severity IN ('critical', 'high')) AS gating, count(*) FILTER (severity IN ('critical', 'high')) > 0 AS failed FROM al",
    "inv_by_extension": _FILES + _BY.format(key="ek", name="extension"),
    "inv_by_language": _FILES + _BY.format(key=_LANG, name="language"),
    "inv_totals": _FILES + "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest, count(DISTINCT parent) AS directories FROM h",
    "folder_rollup": _FILES + ", a AS (SELECT size, unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) AS folder FROM h) SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY 1",
    "top_largest_files": _FILES + "SELECT doc_id, rel_path, size FROM h ORDER BY size DESC, rel_path, doc_id LIMIT 25",
    "deepest_paths": _FILES + "SELECT doc_id, rel_path, CAST(len(parts) AS INT) AS depth FROM h ORDER BY len(parts) DESC, rel_path, doc_id LIMIT 25",
    "repeated_file_names": _FILES + "SELECT n AS name, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM h WHERE n NOT IN ('__init__.py', 'index.ts', 'index.tsx') GROUP BY 1 HAVING count(*) >= 3",
    "duplicate_contents": "SELECT sha256(text) AS sha256, count(*) AS files, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "plan_groups": _FILES + _BY.format(key=_PLAN, name="plan_group"),
    "archive_groups": _FILES + _BY.format(key=_ARCHIVE, name="archive_group"),
    "text_files": _FILES + _BY.format(key=_TEXT, name="is_text"),
    "path_shapes": _FILES
    + r"""SELECT DISTINCT rel_path, CAST(len(parts) AS INT) AS depth, parent, string_split(p, '/')[-1] AS name,
       len(list_filter(lparts, lambda x: regexp_matches(x, '(^|[._\-])(test|spec)($|[._\-])'))) > 0 AS is_test,
       CASE WHEN trim(rel_path) = '' THEN 'empty' WHEN contains(rel_path, ' ') THEN 'spaces' WHEN regexp_matches(rel_path, '[^\x00-\x7F]') THEN 'non-ascii' WHEN length(rel_path) >= 240 THEN 'long' ELSE '' END AS suspicious FROM h""",
    "sizes_and_tokens": _FILES
    + """SELECT doc_id, size, greatest(1, CAST(round(size / 3.5) AS BIGINT)) AS tokens,
       CASE WHEN size >= 1048576 THEN printf('%.2f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.2f KB', size / 1024.0) ELSE size || ' B' END AS shown FROM h""",
    "safety_policy_safe": _policy_sql("safe"), "safety_policy_balanced": _policy_sql("balanced"), "safety_policy_full": _policy_sql("full"),
    "sensitive_files": _FILES
    + f"""SELECT doc_id, rel_path, CASE WHEN starts_with(n, '.env') OR e IN ('key', 'pem', 'p12', 'pfx') THEN 'critical' ELSE 'high' END AS severity FROM h
       WHERE n IN {_in(policy.SENSITIVE_NAMES)} OR e IN {_in(policy.SENSITIVE_SUFFIXES)} OR (starts_with(n, '.env') AND NOT (ends_with(n, '.example') OR ends_with(n, '.sample')))""",
    "loc_counts": _LINES + f"SELECT d.doc_id, CAST(count(*) FILTER ({_TRIMMED} <> '') AS INT) AS loc FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY 1",
    "code_metrics": _LINES
    + f""", k AS (SELECT doc_id, {_TRIMMED} AS s FROM l), c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (s = '') AS blank, count(*) FILTER (regexp_matches(s, '^(//|/\\*|\\*|#|<!--|--)')) AS comment FROM k GROUP BY 1),
    x AS (SELECT doc_id, string_split(lower(replace(rel_path, '\\', '/')), '/')[-1] AS n FROM documents WHERE text IS NOT NULL),
    y AS (SELECT doc_id, CASE WHEN n = 'dockerfile' OR starts_with(n, 'dockerfile.') THEN 'dockerfile' WHEN regexp_extract(n, '^.+\\.([^.]*)$', 1) = '' THEN '[no extension]' ELSE regexp_extract(n, '^.+\\.([^.]*)$', 1) END AS extension FROM x)
    SELECT extension, count(*) AS files, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(blank), 0) AS BIGINT) AS blank, CAST(coalesce(sum(comment), 0) AS BIGINT) AS comment,
    CAST(coalesce(sum(total - blank - comment), 0) AS BIGINT) AS code, count(*) FILTER (total >= 500) AS files_500, count(*) FILTER (total >= 1000) AS files_1000 FROM y LEFT JOIN c USING (doc_id) GROUP BY 1""",
    "line_numbers": _LINES + "SELECT doc_id, CAST(max(line) AS INT) AS lines, CAST(sum(length(content)) AS BIGINT) AS chars FROM l GROUP BY 1",
    "secret_keyword_value": _HIT("value"), "secret_assignment": _HIT("assignment"), "secret_mention": _HIT("mention"), "secret_bearer": _HIT("bearer"),
    "private_key_headers": _HIT("armor"), "telegram_tokens": _HIT("telegram"), "url_credentials": _HIT("url"), "http_auth": _HIT("http"),
    "provider_signatures": _LINES + f", s AS (SELECT doc_id, line, {_PROVIDER} AS p FROM l) SELECT doc_id, line, p.rule AS rule, p.confidence AS confidence FROM s WHERE p IS NOT NULL",
    "todo_markers": _LINES + f"SELECT doc_id, line, upper(regexp_extract(content, '(?i){_WB}({'|'.join(lines.TODO_WORDS)}){_WE}', 2)) AS kind FROM l WHERE regexp_matches(content, '(?i){_WB}({'|'.join(lines.TODO_WORDS)}){_WE}')",
    "todo_by_kind": _LINES + f"SELECT upper(regexp_extract(content, '(?i){_WB}({'|'.join(lines.TODO_WORDS)}){_WE}', 2)) AS kind, count(*) AS markers FROM l WHERE regexp_matches(content, '(?i){_WB}({'|'.join(lines.TODO_WORDS)}){_WE}') GROUP BY 1",
    "risky_code": _LINES + " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule, '{_SEVERITY[r]}' AS severity FROM l WHERE {c}" for r, c in _RISKY.items()),
    "entropy_tokens": _ENTROPY + "SELECT doc_id, line, count(*) AS tokens, round(max(bits), 6) AS most_bits FROM hit GROUP BY 1, 2",
    "earlier_finding_kinds": "SELECT type, severity, rule, count(*) AS findings FROM (SELECT DISTINCT id, type, lower(coalesce(severity, 'unknown')) AS severity, rule FROM finding) GROUP BY 1, 2, 3",
    "allowlist_screen": """
      WITH r AS (SELECT DISTINCT id, run_id, rule, file, message FROM finding WHERE rule IS NOT NULL AND file IS NOT NULL AND message IS NOT NULL),
      m AS (SELECT *, substr(sha256(concat_ws(chr(0), '1', rule, file, message)), 1, 16) AS fp FROM r),
      a AS (SELECT DISTINCT fp FROM m WHERE run_id <= 100)
      SELECT a.fp IS NOT NULL AS suppressed, CASE WHEN a.fp IS NOT NULL THEN 'accepted' ELSE '' END AS reason, count(DISTINCT m.fp) AS fingerprints, count(*) AS findings FROM m LEFT JOIN a ON a.fp = m.fp GROUP BY 1, 2""",
    "placeholder_counts": "SELECT rule, CAST(sum(len(regexp_extract_all(coalesce(message, ''), '<REDACTED(>|:|_)'))) AS BIGINT) AS placeholders FROM (SELECT DISTINCT id, rule, message FROM finding) GROUP BY 1",
    "source_risk_summary": _LINES
    + f""", fl AS (SELECT coalesce(source, '') AS source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(greatest(1, CAST(round(strlen(text) / 3.5) AS BIGINT))) AS BIGINT) AS tokens FROM documents GROUP BY 1),
    k AS (SELECT coalesce(source, '') AS source, {_CONF} AS c FROM l),
    n AS (SELECT source, count(*) AS lines, count(*) FILTER (c = 'critical') AS critical, count(*) FILTER (c = 'high') AS high, count(*) FILTER (c = 'medium') AS medium, count(*) FILTER (c = 'low') AS low FROM k GROUP BY 1)
    SELECT fl.source, files, bytes, tokens, CAST(coalesce(lines, 0) AS BIGINT) AS lines, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM fl LEFT JOIN n ON n.source = fl.source""",
}
