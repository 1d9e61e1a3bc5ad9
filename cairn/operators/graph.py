"""Imports between files of one project, and scores built on them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify, paths
from cairn.operators.code import INFRASTRUCTURE_WORDS, words_in
from cairn.operators.lines import TODO, split_lines

#: A statement of Python that imports: `from` with its dots and module, or `import` with a list up to the line's end.
_BEGINS = r"(?m)(?:^|;)[ \t]*"
FROM = _BEGINS + r"from[ \t]+(\.*)[ \t]*([\p{L}_][\p{L}\p{N}_.]*)?[ \t]+import(?![\p{L}\p{N}_])"
LISTED = _BEGINS + r"import[ \t]+([^#;\n]+)"
#: A module of a list, without the name it is given.
ITEM = r"^[ \t]*([\p{L}_][\p{L}\p{N}_.]*)(?:[ \t]+as[ \t].*)?[ \t\r]*$"
#: A string in one kind of quotes that closes on its line, after what makes it a module of a script.
_STRING = r"""(?:"([^"\n]+)"|'([^'\n]+)')"""
SCRIPT = r"(?:(?<![\p{L}\p{N}_$.])from[ \t\r\n]*|(?<![\p{L}\p{N}_$.])import[ \t\r\n]*\([ \t\r\n]*|(?<![\p{L}\p{N}_$.])require[ \t\r\n]*\([ \t\r\n]*)" + _STRING
#: A line that holds a module of Go: alone, as in a block, or after `import`, with or without a name of its own.
GO = r"(?m)^[ \t]*(?:import[ \t]+)?(?:[\p{L}_.][\p{L}\p{N}_]*[ \t]+)?[\"`]([^\"`\n]+)[\"`][ \t]*(?://.*)?\r?$"
#: What a specifier without an extension may stand for, in the order in which it is tried.
JS_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".vue", ".svelte", ".css"]


def _rows(files: DataFrame, project: str, *extensions: str) -> DataFrame:
    e = paths.extension(F.col("rel_path"))
    return files.where(e.isin(*extensions) & F.col("text").isNotNull()).select(F.col(project).alias("project"), F.translate("rel_path", "\\", "/").alias("source"), "text")


def _walk(segments: Column) -> Column:
    """segments with `.` and empty ones gone and each `..` taking one back."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def specifiers(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, source, base, rank, target: every file that an import may stand for; lower ranks are tried first."""
    here = F.array_compact(F.split(paths.parent(F.col("source")), "/"))
    py = _rows(files, project, "py", "pyw")
    plain = py.select("project", "source", F.explode(F.regexp_extract_all("text", F.lit(LISTED), 1)).alias("list"))
    plain = plain.select("project", "source", F.explode(F.split("list", ",")).alias("item")).select("project", "source", F.regexp_extract("item", ITEM, 1).alias("module"))
    plain = plain.select("project", "source", F.translate("module", ".", "/").alias("base"))
    dots, module = F.regexp_extract_all("text", F.lit(FROM), 1), F.regexp_extract_all("text", F.lit(FROM), 2)
    named = py.select("project", "source", F.explode(F.arrays_zip(dots.alias("dots"), module.alias("module"))).alias("i"))
    level = F.length("i.dots")
    up = F.when(level > 0, F.slice(here, F.lit(1), F.greatest(F.size(here) - level + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    named = named.select("project", "source", _walk(F.concat(up, F.split(F.translate("i.module", ".", "/"), "/"))).alias("base"))
    python = plain.unionByName(named).where("base <> ''")
    python = python.select("project", "source", "base", F.posexplode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("rank", "target"))

    js = _rows(files, project, "js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte")
    either = F.zip_with(F.regexp_extract_all("text", F.lit(SCRIPT), 1), F.regexp_extract_all("text", F.lit(SCRIPT), 2), lambda a, b: F.concat(a, b))
    js = js.select("project", "source", F.explode(either).alias("spec")).where(F.col("spec").startswith("."))
    js = js.select("project", "source", _walk(F.concat(here, F.split("spec", "/"))).alias("base")).where("base <> ''")
    tried = [F.concat("base", F.lit(s)) for s in JS_SUFFIXES] + [F.concat("base", F.lit(f"/index{s}")) for s in JS_SUFFIXES[1:]]
    script = js.select("project", "source", "base", F.posexplode(F.array(*tried)).alias("rank", "target"))
    return python.unionByName(script)


def import_edges(files: DataFrame, project: str = "project_id", go_module: DataFrame | None = None) -> DataFrame:
    """project, source, target: distinct imports of one file by another of its project. files: project, rel_path, text.

    Candidates meet known paths in one equi-join; of those that exist the first tried counts. go_module: project, module.
    """
    known = files.select(F.col(project).alias("project"), F.translate("rel_path", "\\", "/").alias("target")).distinct()
    hits = specifiers(files, project).distinct().join(known, ["project", "target"])
    edges = hits.groupBy("project", "source", "base").agg(F.min_by("target", "rank").alias("target"))
    edges = edges.select("project", "source", "target").distinct()
    if go_module is None:
        return edges
    go = _rows(files, project, "go").select("project", "source", F.explode(F.regexp_extract_all("text", F.lit(GO), 1)).alias("spec")).join(go_module, "project")
    go = go.where((F.col("module") != "") & F.expr("startswith(spec, module)")).select("project", "source", F.array_join(paths.parts(F.expr("substr(spec, length(module) + 1)")), "/").alias("dir"))
    first = known.where(F.col("target").endswith(".go")).groupBy("project", paths.parent(F.col("target")).alias("dir")).agg(F.min("target").alias("target"))
    return edges.unionByName(go.join(first, ["project", "dir"]).select("project", "source", "target")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """project, path, imported_by, imports."""
    inward = edges.groupBy("project", F.col("target").alias("path")).agg(F.count("*").alias("imported_by"))
    outward = edges.groupBy("project", F.col("source").alias("path")).agg(F.count("*").alias("imports"))
    both = inward.join(outward, ["project", "path"], "full_outer")
    return both.select("project", "path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("imported_by", "imports")))


def _with_degrees(files: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    rows = files.withColumn("_path", F.translate("rel_path", "\\", "/")).withColumnRenamed(project, "project")
    d = degrees(edges).withColumnRenamed("path", "_path")
    return rows.join(d, ["project", "_path"], "left").fillna(0, ["imported_by", "imports"])


# What a file's score is made of. Each row holds points, the measure they are for and what it must be: a
# least number, a list it must be in or hold one of, or a pattern. Of rows of one name the first that holds counts.
IMPORTANCE = [
    ("entry", 40, "name", ["main.py", "__main__.py", "app.py", "server.py", "manage.py", "main.tsx", "main.ts", "index.tsx", "index.ts", "main.go"]),
    ("config", 25, "name", ["package.json", "pyproject.toml", "go.mod", "Cargo.toml", "docker-compose.yml", "docker-compose.yaml", "Dockerfile", "README.md"]),
    ("config", 25, "lower_name", r"^(vite\.config|next\.config|eslint\.config|tailwind\.config)"),
    ("folder", 12, "parts", ["services", "api", "routes", "controllers", "stores", "domain", "core", "ui"]),
    ("size", 18, "lines", 300),
    ("size", 10, "lines", 120),
    ("imports", 10, "import_words", 8),
    ("declarations", 10, "declaration_words", 10),
    ("code", 5, "extension", ["py", "ts", "tsx", "js", "jsx", "go", "rs"]),
]
# Points for each import of a file by another, and the most they come to.
IMPORTED_POINTS, IMPORTED_MOST = 8, 40
REFACTORING = [
    ("size", 40, "lines", 500),
    ("size", 25, "lines", 300),
    ("outward", 20, "imports", 10),
    ("open", 8, "markers", True),
    ("mixed", 25, "ui_infrastructure", True),
]
# A file that so many others import has points for each, up to the most.
CENTRAL, CENTRAL_POINTS, CENTRAL_MOST = 5, 5, 35
SCORED_EXTENSIONS = ["py", "ts", "tsx", "js", "jsx", "go", "rs"]
# Words that import and that declare.
IMPORT_WORDS, DECLARATION_WORDS = ["import", "from", "include", "using"], ["class", "def", "function", "const", "let", "var", "interface", "type", "struct", "func"]


def _any_word(words: list[str], more: str = "") -> str:
    return rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_]){more})"


def _score(table: list[tuple], measures: dict[str, Column]) -> Column:
    """The points of a table of rows (name, points, measure, what it must be)."""
    points: dict[str, list[Column]] = {}
    for name, worth, measure, want in table:
        value = measures[measure]
        if want is True:
            holds = value
        elif isinstance(want, int):
            holds = value >= want
        elif isinstance(want, str):
            holds = value.rlike(want)
        else:
            holds = F.arrays_overlap(value, F.array(*map(F.lit, want))) if measure == "parts" else value.isin(want)
        points.setdefault(name, []).append(F.when(F.coalesce(holds, F.lit(False)), F.lit(worth)))
    return sum((F.coalesce(*p, F.lit(0)) for p in points.values()), F.lit(0))


def key_file_scores(files: DataFrame, edges: DataFrame, project: str = "project_id") -> DataFrame:
    """project, doc_id, rel_path, score of files that matter: entry points, configuration, much imported, large."""
    rows = _with_degrees(files, edges, project)
    path, read = F.col("rel_path"), classify.is_text(F.col("rel_path")) & F.col("text").isNotNull()
    in_text = lambda c: F.when(read, c)
    measures = {
        "name": paths.name(path), "lower_name": F.lower(paths.name(path)), "parts": paths.parts(F.lower(path)), "extension": paths.extension(path), "lines": in_text(F.size(split_lines(F.col("text")))),
        "import_words": in_text(F.regexp_count("text", F.lit(_any_word(IMPORT_WORDS, r"|require[ \t]*\(")))), "declaration_words": in_text(F.regexp_count("text", F.lit(_any_word(DECLARATION_WORDS)))),
    }
    score = _score(IMPORTANCE, measures) + F.least(F.lit(IMPORTED_MOST), F.col("imported_by") * IMPORTED_POINTS)
    return rows.select("project", "doc_id", "rel_path", score.cast("long").alias("score")).where(F.col("score") > 0)


def refactoring_scores(files: DataFrame, edges: DataFrame, project: str = "project_id") -> DataFrame:
    """project, doc_id, rel_path, score of source files that call for work: size, central place, open markers, mixed concerns."""
    rows = _with_degrees(files.where(F.col("text").isNotNull() & paths.extension(F.col("rel_path")).isin(SCORED_EXTENSIONS)), edges, project)
    infra = F.lower("rel_path").contains("ui") & (F.size(words_in(F.col("text"), INFRASTRUCTURE_WORDS)) > 0)
    measures = {"lines": F.size(split_lines(F.col("text"))), "imports": F.col("imports"), "markers": F.col("text").rlike(TODO), "ui_infrastructure": infra}
    central = F.when(F.col("imported_by") >= CENTRAL, F.least(F.lit(CENTRAL_MOST), F.col("imported_by") * CENTRAL_POINTS)).otherwise(F.lit(0))
    return rows.select("project", "doc_id", "rel_path", (_score(REFACTORING, measures) + central).cast("long").alias("score")).where(F.col("score") > 0)


# Layers in the order in which they are tried, each with parts of paths, extensions, whole names and
# pieces of names that show it.
LAYERS = [
    ("entrypoints", [], [], ["main.py", "__main__.py", "app.py", "manage.py"], r"^vite\.config"),
    ("interface", ["ui", "components", "pages"], ["html", "css", "scss", "tsx", "jsx", "vue", "svelte"], [], None),
    ("business_services", ["services", "service", "usecases"], [], [], None),
    ("report_generation", ["reports", "exporters"], [], [], None),
    ("data_models", ["models", "schemas", "entities"], [], [], None),
    ("utilities", ["utils", "helpers", "lib"], [], [], None),
    ("tests", ["tests"], [], [], "test"),
    ("configuration", [], ["json", "yaml", "yml", "toml", "ini", "cfg", "conf"], [], None),
    ("documentation", [], ["md", "rst", "adoc", "txt"], [], None),
]


def layers(path: Column) -> Column:
    """Which layer of an application a file belongs to: the first of LAYERS that its path shows, else other."""
    own, name, extension = paths.parts(F.lower(path)), F.lower(paths.name(path)), paths.extension(path)
    found = []
    for layer, parts, extensions, names, piece in LAYERS:
        shown = [F.arrays_overlap(own, F.array(*map(F.lit, parts)))] if parts else []
        shown += [extension.isin(extensions)] if extensions else []
        shown += [name.isin(names)] if names else []
        shown += [name.rlike(piece)] if piece else []
        found.append(F.when(reduce(or_, shown), F.lit(layer)))
    return F.coalesce(*found, F.lit("other"))
