"""Queries over what the corpus's files define, call and declare, and over the tree they lie in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import stacks
from cairn.operators import code, findings, graph, manifests, sanitize, structure
from cairn.queries import corpus, literal
from cairn.queries.corpus import _FILES, _LINES, _in, files
from cairn.runtime import cut, spread


def _source(spark: SparkSession, d: str) -> DataFrame:
    return spread(files(spark, d).select("doc_id", "rel_path", "text"))


def directory_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.directories(files(spark, d)).withColumn("layer", F.coalesce(structure.directory_layer(F.col("directory")), F.lit("")))
    return rows.groupBy("layer").agg(F.count("*").alias("directories"))


def directory_roles(spark: SparkSession, d: str) -> DataFrame:
    return structure.directory_roles(structure.directories(files(spark, d))).groupBy("side", "role").agg(F.count("*").alias("directories"))


def ancestor_directories(spark: SparkSession, d: str) -> DataFrame:
    return structure.directories(files(spark, d))


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    return structure.listing(files(spark, d).where("project_id IS NOT NULL"))


def walk_order(spark: SparkSession, d: str) -> DataFrame:
    """Each project's first files in the order of a walk."""
    rows = files(spark, d).where("project_id IS NOT NULL").withColumn("k", structure.walk_key(F.col("rel_path")))
    return rows.groupBy("project_id").agg(F.min_by("rel_path", F.struct("k", "rel_path")).alias("first"), F.max_by("rel_path", F.struct("k", "rel_path")).alias("last"))


def plan_groups_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Plan groups, the most frequent first; of equals the one that was seen first."""
    from cairn.functions.classify import plan_group

    rows = files(spark, d).groupBy(plan_group(F.col("rel_path")).alias("plan_group")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))
    return rows.select("plan_group", "files", F.row_number().over(Window.orderBy(F.col("files").desc(), "first")).alias("place"))


def concern_words(spark: SparkSession, d: str) -> DataFrame:
    rows = _source(spark, d).select("doc_id", F.explode(code.words_in(F.col("text"), code.CONCERN_WORDS)).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("files"))


def mixed_concerns(spark: SparkSession, d: str) -> DataFrame:
    return code.mixed_concerns(_source(spark, d)).select("doc_id", "signal", F.size("concerns").alias("concerns"))


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return code.python_symbols(_source(spark, d))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return code.symbols(_source(spark, d))


def api_routes(spark: SparkSession, d: str) -> DataFrame:
    return code.routes(_source(spark, d))


def api_calls(spark: SparkSession, d: str) -> DataFrame:
    return code.calls(_source(spark, d))


def stripped_languages(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(F.coalesce(structure.stripped_language(F.col("rel_path")), F.lit("")).alias("language")).agg(F.count("*").alias("files"))


def sterile_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return sanitize.outcomes(sanitize.sterile_copy(_source(spark, d)))


def config_checklist(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.config_checklist(files(spark, d).where("project_id IS NOT NULL"))
    return rows.groupBy("capability").agg(F.count("*").alias("projects"), F.count_if("present").alias("present"))


# --- over literal projects: the corpus holds no such cases -------------------------------------------------------


def _literal(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(literal.files(spark))


def _edges(rows: DataFrame) -> DataFrame:
    modules = manifests.declarations(rows).where("kind = 'module'").select("project", F.col("name").alias("module")).distinct()
    return graph.import_edges(rows.select("project_id", "rel_path", "text"), go_module=modules)


def _risky(rows: DataFrame) -> DataFrame:
    from cairn.functions import detect
    from cairn.operators.lines import numbered_lines

    each = numbered_lines(rows.select("doc_id", "text")).select("doc_id", "line", F.explode(detect.risky(F.col("content"))).alias("r"))
    return each.select("doc_id", "line", "r.rule", "r.severity")


def _stack_rows(rows: DataFrame) -> DataFrame:
    return structure.detected_stacks(rows).select("project", "place", "stack", F.array_join("markers", ",").alias("markers"))


QUERIES = {
    "directory_layers": directory_layers, "directory_roles": directory_roles, "ancestor_directories": ancestor_directories, "directory_listing": directory_listing, "walk_order": walk_order, "plan_groups_ranked": plan_groups_ranked,
    "concern_words": concern_words, "mixed_concerns": mixed_concerns, "python_symbols": python_symbols, "code_symbols": code_symbols, "api_routes": api_routes, "api_calls": api_calls, "stripped_languages": stripped_languages, "sterile_outcomes": sterile_outcomes, "config_checklist": config_checklist,
    "literal_risky_code": _literal(_risky), "literal_sensitive_files": _literal(lambda f: findings.sensitive_files(f.select("doc_id", "rel_path"))), "literal_import_edges": _literal(_edges), "literal_import_degrees": _literal(lambda f: graph.degrees(_edges(f))),
    "literal_key_file_scores": _literal(lambda f: graph.key_file_scores(f.select("doc_id", "project_id", "rel_path", "text"), cut(_edges(f)))), "literal_declarations": _literal(lambda f: manifests.declarations(f)), "literal_stacks": _literal(_stack_rows),
    "literal_stack_ignores": _literal(lambda f: structure.ignored_by_stack(structure.detected_stacks(f))), "literal_package_managers": _literal(lambda f: structure.package_managers(f).select("project", F.array_join("managers", ", ").alias("managers"))),
    "literal_dependency_stack": _literal(lambda f: structure.dependency_stack(manifests.declarations(f))), "literal_checklist": _literal(lambda f: structure.config_checklist(f)),
    "literal_routes": _literal(lambda f: code.routes(f.select("doc_id", "rel_path", "text"))), "literal_calls": _literal(lambda f: code.calls(f.select("doc_id", "rel_path", "text"))), "literal_symbols": _literal(lambda f: code.symbols(f.select("doc_id", "rel_path", "text"))),
    "literal_symbol_lengths": _literal(lambda f: code.python_symbols(f.select("doc_id", "rel_path", "text"))),
}

# --- the same in SQL ---------------------------------------------------------------------------------------------

_DIRS = _FILES + ", dirs AS (SELECT DISTINCT project_id AS project, unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) AS directory FROM h), dl AS (SELECT *, string_split(lower(directory), '/') AS dp FROM dirs)"
_LAYER = "CASE " + " ".join(f"WHEN list_has_any(dp, {list(names)}) THEN '{layer}'" for layer, names in stacks.DIRECTORY_LAYERS.items()) + " ELSE '' END"
_ROLES = " UNION ALL ".join(
    [f"SELECT 'pages' AS side, CASE {' '.join(f'WHEN list_has_any(dp, {n}) THEN {chr(39)}{r}{chr(39)}' for r, n in stacks.PAGE_ROLES.items())} END AS role FROM dl"]
    + [f"SELECT '{side}', '{r}' FROM dl WHERE list_has_any(dp, {n})" for side, t in (("frontend", stacks.FRONTEND_ROLES), ("backend", stacks.BACKEND_ROLES)) for r, n in t.items()]
)
_WORD = r"[\p{L}\p{N}_]"


def _bounded(word: str) -> str:
    plain = word.replace("(", r"\(").replace(".", r"\.")
    return (r"(^|[^\p{L}\p{N}_])" + plain + (r"($|[^\p{L}\p{N}_])" if word[-1].isalpha() else "")).replace("'", "''")


_CONCERNS = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{_bounded(w)}') THEN '{w}' END" for w in code.CONCERN_WORDS) + "]"
_INFRA = " OR ".join(f"regexp_matches(text, '{_bounded(w)}')" for w in code.INFRASTRUCTURE_WORDS)
_SYMBOL_LENGTHS = (
    _LINES
    + r""", py AS (SELECT l.*, length(regexp_extract(content, '^ *')) AS spaces, trim(translate(content, chr(9) || chr(13) || chr(12), '   ')) = '' AS blank FROM l WHERE regexp_matches(lower(rel_path), '[^\\/]\.py$')),
  defs AS (SELECT doc_id, line, regexp_extract(content, '^(\s*)(async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 3) AS name, length(regexp_extract(content, '^(\s*)', 1)) AS indent FROM py WHERE regexp_matches(content, '^(\s*)(async\s+def|def|class)\s+[A-Za-z_]')),
  ends AS (SELECT doc_id, max(line) AS last FROM py GROUP BY 1)
SELECT d.doc_id, d.name, CAST(d.line AS INT) AS line, CAST(coalesce(min(p.line), max(e.last) + 1) - d.line AS INT) AS length FROM defs d JOIN ends e ON e.doc_id = d.doc_id
LEFT JOIN py p ON p.doc_id = d.doc_id AND p.line > d.line AND NOT p.blank AND p.spaces <= d.indent GROUP BY d.doc_id, d.name, d.line"""
)
_SCRIPTS = _in(code.SCRIPT_EXTENSIONS)
_Q = r"[ \t\r\n]*[''\"]([^''\"]+)"
_METHODS = "|".join(code.ROUTE_METHODS)
_SYMBOLS = _FILES + ", x AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', {g})) AS name FROM h WHERE e IN {_in(ends)}" for kind, ends, pattern, groups in code.SYMBOLS for g in groups
) + ") SELECT DISTINCT doc_id, kind, name FROM x WHERE name <> ''"
_PAIRED = lambda p, m, r, where: f"SELECT doc_id, upper(unnest(regexp_extract_all(text, '{p}', {m}))) AS method, unnest(regexp_extract_all(text, '{p}', {r})) AS route FROM h WHERE e IN {where}"
_ROUTES = _FILES + ", x AS (" + " UNION ALL ".join([
    _PAIRED(rf"(?i)@(?:app|router)\.({_METHODS})\({_Q}", 1, 2, "('py')"),
    f"SELECT doc_id, 'GET(default)', unnest(regexp_extract_all(text, '(?i)@(?:app|blueprint|bp)\\.route\\({_Q}', 1)) FROM h WHERE e = 'py'",
    _PAIRED(rf"(?i)(?:app|router)\.(get|post|put|patch|delete|use)\({_Q}", 1, 2, _SCRIPTS),
    f"SELECT doc_id, 'GO_HANDLEFUNC', unnest(regexp_extract_all(text, 'HandleFunc\\({_Q}', 1)) FROM h WHERE e = 'go'",
]) + ") SELECT DISTINCT doc_id, method, route FROM x"
_CALLS = _FILES + f""", x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{code.CALL.replace("'", "''")}', 1)) AS call FROM h WHERE e IN {_SCRIPTS})
  SELECT DISTINCT doc_id, call FROM x WHERE starts_with(call, 'http') OR starts_with(call, '/') OR starts_with(call, 'api') OR starts_with(call, '${{') OR contains(call, '/api')"""
_STRIPPED = f"CASE WHEN n IN {_in(stacks.MAKEFILES)} THEN 'Makefile' ELSE {corpus._named('e', stacks.STRIPPED_LANGUAGES)} END"
_CONFIG = f"(n IN {_in([c.lower() for c in stacks.CONFIG_FILES])} OR (starts_with(p, '.github/workflows/') AND (ends_with(n, '.yml') OR ends_with(n, '.yaml'))) OR starts_with(n, 'dockerfile') OR starts_with(n, '.env'))"
_CHECK = _FILES + f", c AS (SELECT project_id AS project, n, p FROM h WHERE {_CONFIG} AND project_id IS NOT NULL), k AS (" + " UNION ALL ".join(f"SELECT project, '{label}' AS capability, bool_or(regexp_matches({'p' if '/' in pattern else 'n'}, '{pattern}')) AS present FROM c GROUP BY 1" for label, pattern in stacks.CHECKLIST.items()) + ") "
_STACK_VALUES = ", ".join(f"({k}, '{name}', {marks + ['*' + x for x in ends]}::VARCHAR[], {needed}::VARCHAR[], {dirs}::VARCHAR[])" for k, (name, marks, ends, needed, dirs) in enumerate(stacks.STACKS))
_STACKS = (
    _FILES
    + f""", roots AS (SELECT project_id AS project, list(DISTINCT parts[1]) || list(DISTINCT CASE WHEN len(parts) = 1 AND e <> '' THEN '*.' || regexp_extract(parts[1], '\\.([^.]*)$', 1) END) AS names FROM h GROUP BY 1),
  rules AS (SELECT * FROM (VALUES {_STACK_VALUES}) AS v(k, stack, marks, needed, dirs)),
  hit AS (SELECT project, k, stack, dirs, list_sort(list_intersect(names, list_concat(marks, needed))) AS found, needed FROM roots, rules WHERE list_has_all(names, needed)),
  st AS (SELECT * FROM hit WHERE len(found) > 0 AND (len(needed) = 0 OR len(found) > len(needed))) """
)
_IMPORTS = (
    _FILES
    + r""", src AS (SELECT project_id AS project, p, e, text, parts[:-2] AS dir FROM h), known AS (SELECT DISTINCT project_id AS project, p AS target FROM h),
  plain AS (SELECT project, p, replace(regexp_extract(unnest(string_split(item, ',')), '^[ \t]*([\p{L}_][\p{L}\p{N}_.]*)', 1), '.', '/') AS base FROM (SELECT project, p, unnest(regexp_extract_all(text, '(?m)(?:^|;)[ \t]*import[ \t]+([^#;\n]+)', 1)) AS item FROM src WHERE e IN ('py', 'pyw'))),
  froms AS (SELECT project, p, dir, regexp_extract(s, 'from[ \t]+(\.*)', 1) AS dots, regexp_extract(s, 'from[ \t]+\.*[ \t]*([\p{L}_][\p{L}\p{N}_.]*)?[ \t]+import', 1) AS module FROM (SELECT project, p, dir, unnest(regexp_extract_all(text, '(?m)(?:^|;)[ \t]*from[ \t]+\.*[ \t]*(?:[\p{L}_][\p{L}\p{N}_.]*)?[ \t]+import\b', 0)) AS s FROM src WHERE e IN ('py', 'pyw'))),
  named AS (SELECT project, p, array_to_string(list_filter(list_concat(CASE WHEN dots = '' THEN CAST([] AS VARCHAR[]) ELSE dir[1:greatest(len(dir) - length(dots) + 1, 0)] END, string_split(replace(module, '.', '/'), '/')), lambda x: x <> ''), '/') AS base FROM froms),
  py AS (SELECT project, p, base, unnest([0, 1]) AS rank, unnest([base || '.py', base || '/__init__.py']) AS target FROM (SELECT * FROM plain UNION ALL SELECT * FROM named) WHERE base <> ''),
  specs AS (SELECT project, p, dir, unnest(list_concat(regexp_extract_all(text, '(?:from|import\s*\(|require\s*\()\s*"([^"\n]+)"', 1), regexp_extract_all(text, '(?:from|import\s*\(|require\s*\()\s*''([^''\n]+)''', 1))) AS spec FROM src WHERE e IN ('js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs', 'vue', 'svelte')),
  js0 AS (SELECT project, p, array_to_string(list_reduce(list_prepend(dir, list_transform(string_split(spec, '/'), lambda x: [x])), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] WHEN x[1] IN ('', '.') THEN acc ELSE list_concat(acc, x) END), '/') AS base FROM specs WHERE starts_with(spec, '.')),
"""
    + f"  js AS (SELECT project, p, base, unnest(range(0, {2 * len(graph.JS_SUFFIXES) - 1})) AS rank, base || unnest({graph.JS_SUFFIXES + ['/index' + s for s in graph.JS_SUFFIXES[1:]]}) AS target FROM js0 WHERE base <> ''),"
    + r"""
  tried AS (SELECT * FROM py UNION ALL SELECT project, p, base, CAST(rank AS INT), target FROM js),
  gomod AS (SELECT project, regexp_extract(text, '(?m)^module[ \t]+([^ \t\n]+)', 1) AS module FROM src WHERE p = 'go.mod'),
  gosp AS (SELECT g.project, g.p, substr(spec, length(module) + 1) AS rest FROM (SELECT project, p, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:import[ \t]+)?(?:[\p{L}_.][\p{L}\p{N}_]*[ \t]+)?"([^"\n]+)"[ \t]*$', 1)) AS spec FROM src WHERE e = 'go') g JOIN gomod m ON m.project = g.project WHERE starts_with(spec, module)),
  gofirst AS (SELECT project, array_to_string(dir, '/') AS dir, min(p) AS target FROM src WHERE e = 'go' GROUP BY 1, 2),
  edges AS (SELECT DISTINCT project, p AS source, target FROM (SELECT t.project, t.p, arg_min(t.target, t.rank) AS target FROM tried t JOIN known k ON k.project = t.project AND k.target = t.target GROUP BY t.project, t.p, t.base)
    UNION SELECT s.project, s.p, f.target FROM gosp s JOIN gofirst f ON f.project = s.project AND f.dir = array_to_string(list_filter(string_split(s.rest, '/'), lambda x: x <> ''), '/')) """
)
_DEGREES = _IMPORTS + ", dg AS (SELECT project, path, CAST(sum(i) AS BIGINT) AS imported_by, CAST(sum(o) AS BIGINT) AS imports FROM (SELECT project, target AS path, 1 AS i, 0 AS o FROM edges UNION ALL SELECT project, source, 0, 1 FROM edges) GROUP BY 1, 2) "
_NL = r"len(string_split(regexp_replace(text, '\n$', ''), chr(10)))"
_COUNT = lambda words, more="": f"len(regexp_extract_all(text, '\\b(?:{'|'.join(words)}){more}'))"
_SCORES = (
    _DEGREES
    + f""", sc AS (SELECT h.project_id AS project, h.doc_id, h.rel_path, {corpus._TEXT} AS read, coalesce(imported_by, 0) AS ib, parts[-1] AS nm, lparts, n, e, text FROM h LEFT JOIN dg ON dg.project = h.project_id AND dg.path = h.p),
  pt AS (SELECT project, doc_id, rel_path, CASE WHEN nm IN {_in(graph.IMPORTANCE[0][3])} THEN 40 ELSE 0 END + CASE WHEN nm IN {_in(graph.IMPORTANCE[1][3])} OR regexp_matches(n, '{graph.IMPORTANCE[2][3]}') THEN 25 ELSE 0 END + least(40, ib * 8)
    + CASE WHEN list_has_any(lparts, {graph.IMPORTANCE[3][3]}) THEN 12 ELSE 0 END + CASE WHEN read AND {_NL} >= 300 THEN 18 WHEN read AND {_NL} >= 120 THEN 10 ELSE 0 END
    + CASE WHEN read AND len(regexp_extract_all(text, '\\b(?:import|from|include|using)\\b|\\brequire[ \\t]*\\(')) >= 8 THEN 10 ELSE 0 END + CASE WHEN read AND len(regexp_extract_all(text, '\\b(?:{'|'.join(graph.DECLARATION_WORDS)})\\b')) >= 10 THEN 10 ELSE 0 END
    + CASE WHEN e IN {_in(graph.SCORED_EXTENSIONS)} THEN 5 ELSE 0 END AS score FROM sc) SELECT project, doc_id, rel_path, CAST(score AS BIGINT) AS score FROM pt WHERE score > 0"""
)
_TODO = f"(?i){corpus._WB}({'|'.join(corpus.lines.TODO_WORDS)}){corpus._WE}"
_REFACTORING = (
    _DEGREES
    + f""", rf AS (SELECT h.project_id AS project, h.doc_id, h.rel_path, {_NL} AS lines, coalesce(imported_by, 0) AS ib, coalesce(imports, 0) AS im, text FROM h LEFT JOIN dg ON dg.project = h.project_id AND dg.path = h.p WHERE text IS NOT NULL AND e IN {_in(graph.SCORED_EXTENSIONS)}),
  rs AS (SELECT project, doc_id, rel_path, CASE WHEN lines >= 500 THEN 40 WHEN lines >= 300 THEN 25 ELSE 0 END + CASE WHEN ib >= 5 THEN least(35, ib * 5) ELSE 0 END + CASE WHEN im >= 10 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '{_TODO}') THEN 8 ELSE 0 END
    + CASE WHEN contains(lower(rel_path), 'ui') AND ({_INFRA}) THEN 25 ELSE 0 END AS score FROM rf) SELECT project, doc_id, rel_path, CAST(score AS BIGINT) AS score FROM rs WHERE score > 0"""
)
_DECLARED = (
    _FILES
    + r""", pk AS (SELECT project_id AS project, rel_path, CAST(text AS JSON) AS j FROM h WHERE n = 'package.json'),
  pd AS (SELECT project, rel_path, kind, unnest(json_keys(j, '$.' || key)) AS name, j, key FROM pk, (VALUES ('dependencies', 'dependency'), ('devDependencies', 'dev_dependency'), ('peerDependencies', 'peer_dependency'), ('optionalDependencies', 'optional_dependency'), ('scripts', 'script')) AS v(key, kind) WHERE json_exists(j, '$.' || key)),
  ll AS (SELECT project_id AS project, rel_path, n, p, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS c FROM h),
  mk AS (SELECT DISTINCT project, rel_path, regexp_extract(c, '^([A-Za-z0-9_.\-]+):(?:\s|$)', 1) AS name FROM ll WHERE n IN ('makefile', 'gnumakefile')),
  rq AS (SELECT project, rel_path, trim(c) AS c FROM ll WHERE regexp_matches(lower(p), '^requirements[^/]*\.txt$')),
  gm AS (SELECT project, rel_path, trim(translate(split_part(c, '//', 1), chr(9), ' ')) AS c FROM ll WHERE n = 'go.mod'),
  cp AS (SELECT project_id AS project, rel_path, string_split(text, chr(10)) AS cs FROM h WHERE regexp_matches(n, '^(docker-)?compose(\..+)?\.ya?ml$')),
  cl AS (SELECT project, rel_path, unnest(range(1, len(cs) + 1)) AS k, unnest(cs) AS c FROM cp), cm AS (SELECT *, length(c) - length(ltrim(c)) AS ind, trim(c) AS b FROM cl WHERE trim(c) <> ''),
  cx AS (SELECT *, last_value(CASE WHEN ind = 0 THEN split_part(b, ':', 1) END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN ind = 2 THEN split_part(b, ':', 1) END IGNORE NULLS) OVER w AS service, last_value(CASE WHEN ind = 4 THEN split_part(b, ':', 1) END IGNORE NULLS) OVER w AS key FROM cm WINDOW w AS (PARTITION BY project, rel_path ORDER BY k))
SELECT project, rel_path, kind, name, json_extract_string(j, '$.' || key || '."' || name || '"') AS value FROM pd
UNION ALL SELECT project, rel_path, 'target', name, '' FROM mk WHERE name <> ''
UNION ALL SELECT project, rel_path, 'dependency', regexp_extract(c, '^([A-Za-z0-9_.\-\[\]]+)', 1), trim(split_part(regexp_replace(c, '^[A-Za-z0-9_.\-\[\]]+\s*', ''), ' #', 1)) FROM rq WHERE regexp_matches(c, '^[A-Za-z0-9_.\[\]]')
UNION ALL SELECT project, rel_path, 'module', regexp_extract(c, '^module (.*)$', 1), '' FROM gm WHERE starts_with(c, 'module ')
UNION ALL SELECT project, rel_path, 'dependency', split_part(regexp_replace(c, '^require ', ''), ' ', 1), split_part(regexp_replace(c, '^require ', ''), ' ', 2) FROM gm WHERE regexp_matches(c, '^(require )?[a-z.]+/\S+ v')
UNION ALL SELECT project, rel_path, 'service', service, '' FROM cx WHERE section = 'services' AND ind = 2
UNION ALL SELECT project, rel_path, 'service.' || key, service, trim(substr(b, strpos(b, ':') + 1)) FROM cx WHERE section = 'services' AND ind = 4 AND trim(substr(b, strpos(b, ':') + 1)) <> ''
UNION ALL SELECT project, rel_path, 'service.' || key, service, regexp_replace(b, '^- ', '') FROM cx WHERE section = 'services' AND ind >= 6"""
)
_NAMED_DEPENDENCY = ", ".join(f"('{k}', '{label}', '{part}')" for k, (label, part) in stacks.DEPENDENCY_STACK.items())

ORACLE = {
    "directory_layers": _DIRS + f" SELECT {_LAYER} AS layer, count(*) AS directories FROM dl GROUP BY 1",
    "directory_roles": _DIRS + f", r AS ({_ROLES}) SELECT side, role, count(*) AS directories FROM r WHERE role IS NOT NULL GROUP BY 1, 2",
    "ancestor_directories": _DIRS + " SELECT project, directory FROM dirs",
    "directory_listing": _DIRS
    + """, held AS (SELECT project_id AS project, parent AS directory, parts[-1] AS name, false AS is_dir, size AS bytes FROM h WHERE project_id IS NOT NULL AND len(parts) > 0
      UNION ALL SELECT project, array_to_string(string_split(directory, '/')[:-2], '/'), string_split(directory, '/')[-1], true, 0 FROM dirs WHERE project IS NOT NULL),
      o AS (SELECT project, directory, name, is_dir, max(bytes) AS bytes FROM held GROUP BY ALL)
      SELECT project, directory, CAST(row_number() OVER (PARTITION BY project, directory ORDER BY is_dir DESC, lower(name), name) AS INT) AS place, name, is_dir, bytes FROM o""",
    "walk_order": _FILES
    + """, w AS (SELECT project_id, rel_path, list_transform(range(1, len(parts) + 1), lambda k: (CASE WHEN k = len(parts) THEN '0' ELSE '1' END) || upper(parts[k])) AS k FROM h WHERE project_id IS NOT NULL)
      SELECT project_id, arg_min(rel_path, {'k': k, 'r': rel_path}) AS first, arg_max(rel_path, {'k': k, 'r': rel_path}) AS last FROM w GROUP BY 1""",
    "plan_groups_ranked": _FILES + f", g2 AS (SELECT {corpus._PLAN} AS plan_group, count(*) AS files, min(doc_id) AS f FROM h GROUP BY 1) SELECT plan_group, files, CAST(row_number() OVER (ORDER BY files DESC, f) AS INT) AS place FROM g2",
    "concern_words": f"SELECT word, count(*) AS files FROM (SELECT unnest({_CONCERNS}) AS word FROM documents WHERE text IS NOT NULL) WHERE word IS NOT NULL GROUP BY 1",
    "mixed_concerns": f"""SELECT doc_id, CASE WHEN contains(lower(rel_path), 'ui') AND ({_INFRA}) THEN 'infrastructure' ELSE 'many' END AS signal, CAST(len(list_filter({_CONCERNS}, lambda x: x IS NOT NULL)) AS INT) AS concerns
      FROM documents WHERE (contains(lower(rel_path), 'ui') AND ({_INFRA})) OR (len(list_filter({_CONCERNS}, lambda x: x IS NOT NULL)) >= 4 AND {_NL} >= 180)""",
    "python_symbols": _SYMBOL_LENGTHS, "code_symbols": _SYMBOLS, "api_routes": _ROUTES, "api_calls": _CALLS,
    "stripped_languages": _FILES + f" SELECT coalesce({_STRIPPED}, '') AS language, count(*) AS files FROM h GROUP BY 1",
    "config_checklist": _CHECK + "SELECT capability, count(*) AS projects, count(*) FILTER (present) AS present FROM k GROUP BY 1",
    "literal_risky_code": literal.over(corpus.ORACLE["risky_code"]), "literal_sensitive_files": literal.over(corpus.ORACLE["sensitive_files"]),
    "literal_import_edges": literal.over(_IMPORTS + "SELECT project, source, target FROM edges"), "literal_import_degrees": literal.over(_DEGREES + "SELECT project, path, imported_by, imports FROM dg"),
    "literal_key_file_scores": literal.over(_SCORES), "literal_declarations": literal.over(_DECLARED),
    "literal_stacks": literal.over(_STACKS + "SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY len(found) DESC, k) AS INT) AS place, stack, array_to_string(found, ',') AS markers FROM st"),
    "literal_stack_ignores": literal.over(_STACKS + "SELECT DISTINCT project, unnest(dirs) AS directory FROM st"),
    "literal_package_managers": literal.over(_FILES + f", m AS (SELECT DISTINCT project_id AS project, {corpus._named('p', stacks.PACKAGE_MANAGERS)} AS m FROM h) SELECT project, string_agg(m, ', ' ORDER BY m) AS managers FROM m WHERE m IS NOT NULL GROUP BY 1"),
    "literal_dependency_stack": literal.over(_DECLARED.replace("\nSELECT project, rel_path, kind, name, json", "\n, dx AS (SELECT project, kind, name FROM pd WHERE kind <> 'script') SELECT DISTINCT project, part, label FROM dx JOIN (VALUES " + _NAMED_DEPENDENCY + ") AS v(k, label, part) ON v.k = dx.name --", 1).split("--")[0]),
    "literal_checklist": literal.over(_CHECK + "SELECT project, capability, present FROM k"),
    "literal_routes": literal.over(_ROUTES), "literal_calls": literal.over(_CALLS), "literal_symbols": literal.over(_SYMBOLS), "literal_symbol_lengths": literal.over(_SYMBOL_LENGTHS),
}
#: Imports of the whole corpus and what rests on them.
ORACLE_PROJECTS = {"import_edges": _IMPORTS + "SELECT project, source, target FROM edges", "import_degrees": _DEGREES + "SELECT project, path, imported_by, imports FROM dg", "key_file_scores": _SCORES, "build_declarations": _DECLARED}
ORACLE_PROJECTS["import_candidates"] = _IMPORTS + "SELECT project, p AS source, count(DISTINCT base) AS bases, count(DISTINCT target) AS targets FROM tried GROUP BY 1, 2"
ORACLE_PROJECTS["refactoring_scores"] = _REFACTORING
ORACLE |= ORACLE_PROJECTS
