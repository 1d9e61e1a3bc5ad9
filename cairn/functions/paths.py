"""Paths as columns: parts are separated by `\\` or `/`, keys are lower case with `/`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(path: Column) -> Column:
    return F.translate(F.lower(path), "\\", "/")


def display(path: Column) -> Column:
    return F.translate(path, "/", "\\")


def parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def depth(path: Column) -> Column:
    return F.size(parts(path))


def parent(path: Column) -> Column:
    """The directory of path, '' at the top."""
    p = parts(path)
    return F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")


def ancestors(path: Column) -> Column:
    """Every directory above path, the top one first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    """Lower-case suffix without the dot, '' if none; a leading dot starts no suffix."""
    return F.regexp_extract(F.lower(name(path)), r"^.+\.([^.]*)$", 1)


def extension_key(path: Column) -> Column:
    n, e = F.lower(name(path)), extension(path)
    return F.when((n == "dockerfile") | n.startswith("dockerfile."), "dockerfile").when(e == "", "[no extension]").otherwise(e)


def is_test(path: Column) -> Column:
    """Whether a part of the path is marked as a test: `test` or `spec` between its ends and `.`, `_` or `-`."""
    return F.exists(parts(F.lower(path)), lambda p: p.rlike(r"(^|[._\-])(test|spec)($|[._\-])"))


def suspicious(path: Column) -> Column:
    """Why a path may give trouble, '' if it won't."""
    return F.when(F.trim(path) == "", "empty").when(path.contains(" "), "spaces").when(path.rlike(r"[^\x00-\x7F]"), "non-ascii").when(F.length(path) >= 240, "long").otherwise("")
