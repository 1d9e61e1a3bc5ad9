"""Ignore rules: a small text of patterns becomes Columns over paths; the first rule that matches decides.

Rules are few and come from one file, so they are constants of the plan: paths are neither joined nor moved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, policy
from cairn.runtime import small

# Directories that are never looked into.
BASE_IGNORED = [".git", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "dist", "build", "coverage", ".coverage", ".next", ".nuxt", ".turbo", ".parcel-cache"]
LARGE = 100 * 1024 * 1024


def glob_regex(glob: str) -> str:
    """A Java pattern for a glob: `*` and `?` also match `/`, `[...]` is a class, an unclosed `[` stands for itself."""
    out, i = ["(?s)^"], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and close > 0:
            body = glob[i + 1 : close]
            negated = body[:1] in ("!", "^")
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\\\[\]&^])', r'\\\\\1', body[1:] if negated else body)}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join([*out, "$"])


@dataclass
class Rules:
    """Patterns in lower case with `/`, in the order in which they were given."""

    dirs: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    keep_files: list[str] = field(default_factory=list)
    keep_dirs: list[str] = field(default_factory=list)

    @staticmethod
    def parse(text: str, extensions: list[str] = ()) -> Rules:
        """Lines of patterns: `#` starts a comment, `!` keeps what matches, a `/` at the end means a directory."""
        rules = Rules(extensions=[e.lower().lstrip(".") for e in extensions])
        for raw in text.splitlines():
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            line = line.split(" #", 1)[0].strip().replace("\\", "/").lower()
            keep, line = line.startswith("!"), line.removeprefix("!").strip()
            target = line.strip("/")
            if target:
                kinds = (rules.keep_dirs if keep else rules.dirs) if line.endswith("/") else (rules.keep_files if keep else rules.files)
                kinds.append(target if line.endswith("/") else line.removeprefix("./"))
        return rules

    def pinned(self, path: Column) -> Column:
        """Whether path is kept whatever else matches."""
        key, name, parent = paths.key(path), F.lower(paths.name(path)), F.lower(paths.parent(path))
        out = F.lit(False)
        for glob in self.keep_files:
            out = out | key.rlike(glob_regex(glob)) | name.rlike(glob_regex(glob))
        for d in self.keep_dirs:
            out = out | (parent == d) | parent.startswith(f"{d}/") | F.array_contains(paths.parts(parent), d)
        return out

    def skips(self, directory: Column) -> Column:
        """The rule for which a directory (lower case, with `/`) isn't looked into, null if it is: kept directories are, and those above a kept file."""
        kept = F.lit(False)
        for d in self.keep_dirs:
            kept = kept | (directory == d) | directory.startswith(f"{d}/") | F.array_contains(F.split(directory, "/"), d)
        for f in self.keep_files:
            kept = kept | (directory == f) | F.lit(f).startswith(F.concat(directory, F.lit("/")))
        return F.when(~kept, self._dir_rule(directory))

    def _dir_rule(self, ancestor: Column) -> Column:
        name, out = F.substring_index(ancestor, "/", -1), None
        for d in self.dirs:
            hit = (name == d) | (ancestor == d) | ancestor.startswith(f"{d}/") | ancestor.rlike(glob_regex(d))
            out = F.when(hit, d) if out is None else out.when(hit, d)
        return F.lit(None).cast("string") if out is None else out

    def reason(self, path: Column) -> Column:
        """Why path is left out, null if it isn't: its extension, the first file rule, then directories from the nearest up."""
        key, name, extension = paths.key(path), F.lower(paths.name(path)), paths.extension(path)
        out = F.when(self.pinned(path), F.lit(None).cast("string"))
        if self.extensions:
            out = out.when(extension.isin(self.extensions), F.concat(F.lit("custom extension rule: ."), extension))
        for glob in self.files:
            out = out.when(key.rlike(glob_regex(glob)) | name.rlike(glob_regex(glob)), F.lit(f"file rule: {glob}"))
        up = F.reverse(paths.ancestors(F.lower(path)))
        first = F.get(F.filter(F.transform(up, self._dir_rule), lambda r: r.isNotNull()), F.lit(0))
        return out.otherwise(F.when(first.isNotNull(), F.concat(F.lit("directory rule: "), first)))


def skipped_dirs(files: DataFrame, rules: Rules, ignored: IgnoredDirs | None = None, project: str = "project_id") -> DataFrame:
    """project, directory (lower case): the topmost directories above files that aren't looked into, each once."""
    ignored = ignored or IgnoredDirs()
    first = F.get(F.filter(paths.ancestors(F.lower(F.col("rel_path"))), lambda a: ignored.hit(a) | rules.skips(a).isNotNull()), F.lit(0))
    return files.select(F.col(project).alias("project"), first.alias("directory")).where("directory IS NOT NULL").distinct()


@dataclass
class IgnoredDirs:
    """Directories that are never looked into: BASE_IGNORED and extra names, globs of names, and paths of several parts."""

    extra: list[str] = field(default_factory=list)

    def _plain(self) -> list[str]:
        return sorted({x.strip().lower().replace("\\", "/").strip("/") for x in self.extra} - {""})

    def names(self) -> list[str]:
        """All of them, each once, sorted."""
        return sorted({*BASE_IGNORED, *self._plain()})

    def added(self) -> list[str]:
        """Those that aren't ignored anyway."""
        return sorted(set(self._plain()) - set(BASE_IGNORED))

    def hit(self, directory: Column) -> Column:
        """Whether a directory (lower case, with `/`) is one of them or lies in a path that is."""
        name = F.substring_index(directory, "/", -1)
        plain = self._plain()
        out = name.isin([*BASE_IGNORED, *(x for x in plain if "/" not in x and not re.search(r"[*?\[]", x))])
        for x in plain:
            if "/" in x:
                out = out | (directory == x) | directory.startswith(f"{x}/")
            elif re.search(r"[*?\[]", x):
                out = out | name.rlike(glob_regex(x))
        return out


def with_overrides(rules: Rules, include: list[str], exclude: list[str]) -> Rules:
    """rules with what a user put in or out by hand: an included path is pinned, an excluded one is a file rule of its own."""
    plain = lambda xs: [x.replace("\\", "/").lower() for x in xs]
    return Rules(rules.dirs, [*plain(exclude), *rules.files], rules.extensions, [*rules.keep_files, *plain(include)], rules.keep_dirs)


def override_selection(selected: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """The paths of a diff (rel_path) with those put in by hand and without those put out."""
    spark = selected.sparkSession
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "rel_path string")
    return selected.select("rel_path").unionByName(one(include)).distinct().join(small(one(exclude)), "rel_path", "left_anti")


def not_looked_into(path: Column, rules: Rules | None = None, ignored: IgnoredDirs | None = None) -> Column:
    """Whether a directory above path isn't looked into, as ignored or by a rule, so path isn't planned at all."""
    ignored = ignored or IgnoredDirs()
    hit = lambda a: ignored.hit(a) | rules.skips(a).isNotNull() if rules else ignored.hit(a)
    return F.exists(paths.ancestors(F.lower(path)), hit)


def plan(files: DataFrame, rules: Rules, mode: str = "safe", ignored: IgnoredDirs | None = None) -> DataFrame:
    """files with status, reason, severity: rules decide first, then safety; what is left is included. files: rel_path, size."""
    path = F.col("rel_path")
    out = files.withColumns({"_rule": rules.reason(path), "_safety": policy.safety(path, mode), "_pinned": rules.pinned(path), "_dir": not_looked_into(path, rules, ignored)})
    status = F.when(F.col("_dir"), "not_planned").when(F.col("_rule").isNotNull() | (F.col("_safety").isNotNull()), "excluded").otherwise("included")
    reason = F.when(F.col("_dir"), "inside an ignored directory").when(F.col("_rule").isNotNull(), F.col("_rule")).otherwise(F.coalesce("_safety.reason", F.lit("included")))
    severity = F.when(F.col("_dir"), "info").when(F.col("_rule").isNotNull(), "medium").otherwise(F.coalesce("_safety.severity", F.lit("info")))
    return out.withColumns({"status": status, "reason": reason, "severity": severity, "large": F.col("size") >= LARGE}).drop("_rule", "_safety", "_pinned", "_dir")


def plan_summary(planned: DataFrame) -> DataFrame:
    """status, files, bytes, large, critical."""
    return planned.groupBy("status").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("large").alias("large"), F.count_if(F.col("severity") == "critical").alias("critical"))


def explain(asked: DataFrame, planned: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """rel_path, verdict, reason for paths asked about: included, excluded, not_in_diff or not_planned; case doesn't count."""
    known = planned.select(paths.key(F.col("rel_path")).alias("k"), "status", "reason").groupBy("k").agg(F.min(F.struct("status", "reason")).alias("p"))
    out = asked.select("rel_path", paths.key(F.col("rel_path")).alias("k")).join(known, "k", "left")
    status, reason = F.coalesce("p.status", F.lit("not_planned")), F.coalesce("p.reason", F.lit("no such file in the plan"))
    if selected is not None:
        chosen = selected.select(paths.key(F.col("rel_path")).alias("k")).distinct().withColumn("chosen", F.lit(True))
        out = out.join(chosen, "k", "left")
        status = F.when((status == "included") & F.col("chosen").isNull(), "not_in_diff").otherwise(status)
    return out.select("rel_path", status.alias("verdict"), reason.alias("reason"))
