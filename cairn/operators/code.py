"""What source files define and call: symbols and their lengths, routes, requests, words that tell of concerns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.lines import split_lines
from cairn.runtime import arrow_map

# Words of infrastructure, and words of concerns that one file had better not mix.
INFRASTRUCTURE_WORDS = ["shutil", "zipfile", "subprocess", "os.walk", "threading", "Queue"]
CONCERN_WORDS = ["tkinter", "subprocess", "requests", "fetch", "sql", "database", "threading", "Queue", "open(", "write_text", "read_text"]
# A file mixes concerns from so many of the words and so many lines on.
MIXED_CONCERNS, MIXED_LINES = 4, 180
# How a request begins that is one of an interface, and methods of routes and requests.
CALL_STARTS, CALL_PART = ["http", "/", "api", "${"], "/api"
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "options", "head"]
SCRIPT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "vue", "svelte", "astro"]

_WORD = r"[\p{L}\p{N}_]"


def bounded(word: str) -> str:
    """A pattern of word that no letter, digit or `_` lengthens at an end that is one itself."""
    before = rf"(?<!{_WORD})" if re.match(r"\w", word) else ""
    after = rf"(?!{_WORD})" if re.search(r"\w$", word) else ""
    return before + re.sub(r"([^\w])", r"\\\1", word) + after


def words_in(text: Column, words: list[str]) -> Column:
    """Which of words occur in text, in the order of words."""
    return F.array_compact(F.array(*(F.when(text.rlike(bounded(w)), F.lit(w)) for w in words)))


def mixed_concerns(files: DataFrame) -> DataFrame:
    """files with concerns and signal: code of user interfaces that does infrastructure, or many concerns in a larger file."""
    infra = F.lower("rel_path").contains("ui") & (F.size(words_in(F.col("text"), INFRASTRUCTURE_WORDS)) > 0)
    rows = files.withColumn("concerns", words_in(F.col("text"), CONCERN_WORDS))
    many = (F.size("concerns") >= MIXED_CONCERNS) & (F.size(split_lines(F.col("text"))) >= MIXED_LINES)
    return rows.withColumn("signal", F.when(infra, "infrastructure").when(many, "many")).where("signal IS NOT NULL")


_OPENS = re.compile(r"(\s*)(?:async\s+def|def|class)\s+([A-Za-z_]\w*)", re.A)


def symbol_lengths(text: str | None) -> list[tuple[str, int, int]]:
    """name, line, length of what a Python text defines: up to the next line that isn't blank and no deeper.

    One pass: what is open stands on a stack, and a line closes all that isn't shallower than it.
    """
    out: list[list] = []
    stack: list[tuple[int, int]] = []
    rows = (text or "").removesuffix("\n").split("\n") if text else []
    for number, line in enumerate(rows, 1):
        if line.strip():
            indent = len(line) - len(line.lstrip(" "))
            while stack and indent <= stack[-1][0]:
                out[stack.pop()[1]][2] = number
            if m := _OPENS.match(line):
                # A tab is as deep as it is long here, but closes like a line without blanks.
                while stack and len(m[1]) < stack[-1][0]:
                    out[stack.pop()[1]][2] = number
                stack.append((len(m[1]), len(out)))
                out.append([m[2], number, 0])
    for _, k in stack:
        out[k][2] = len(rows) + 1
    return [(name, start, stop - start) for name, start, stop in out]


def python_symbols(files: DataFrame) -> DataFrame:
    """doc_id, name, line, length of the functions and classes of Python files. files: doc_id, rel_path, text."""
    rows = files.where((paths.extension(F.col("rel_path")) == "py") & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in symbol_lengths(t)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "name", "line", "length"])

    return arrow_map(rows, read, "doc_id bigint, name string, line int, length int")


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


#: kind, extensions, pattern and the groups that may hold the name.
SYMBOLS = [
    ("class", ["py"], r"(?m)^class[ \t]+([A-Za-z_][A-Za-z0-9_]*)", [1]),
    ("function", ["py"], r"(?m)^def[ \t]+([A-Za-z_][A-Za-z0-9_]*)", [1]),
    ("component", SCRIPT_EXTENSIONS, r"\bfunction[ \t]+([A-Z][A-Za-z0-9_]*)|\bconst[ \t]+([A-Z][A-Za-z0-9_]*)[ \t]*=[ \t]*(?:\(|React\.)", [1, 2]),
    ("hook", SCRIPT_EXTENSIONS, r"\bfunction[ \t]+(use[A-Z][A-Za-z0-9_]*)|\bconst[ \t]+(use[A-Z][A-Za-z0-9_]*)[ \t]*=", [1, 2]),
]


def symbols(files: DataFrame) -> DataFrame:
    """doc_id, kind, name of the classes, functions, components and hooks that files define, each once."""
    e = paths.extension(F.col("rel_path"))
    named = lambda kind: lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))
    found = [F.when(e.isin(ends), F.transform(F.filter(F.concat(*(_all(p, g) for g in groups)), lambda n: n != ""), named(kind))) for kind, ends, p, groups in SYMBOLS]
    none = F.array().cast("array<struct<kind:string,name:string>>")
    rows = files.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.concat(*(F.coalesce(x, none) for x in found))).alias("s"))
    return rows.select("doc_id", "s.kind", "s.name").distinct()


_METHODS = "|".join(ROUTE_METHODS)
_QUOTED = r"""[ \t\r\n]*['"]([^'"]+)"""
#: extensions, pattern, group of the method (0: none) and of the route, and the method where none is written.
ROUTES = [
    (["py"], rf"(?i)@(?:app|router)\.({_METHODS})\({_QUOTED}", 1, 2, ""),
    (["py"], rf"(?i)@(?:app|blueprint|bp)\.route\({_QUOTED}", 0, 1, "GET(default)"),
    (SCRIPT_EXTENSIONS, rf"(?i)(?:app|router)\.(get|post|put|patch|delete|use)\({_QUOTED}", 1, 2, ""),
    (["go"], rf"HandleFunc\({_QUOTED}", 0, 1, "GO_HANDLEFUNC"),
]
CALL = r"""(?:fetch|(?:axios|client)\.(?:get|post|put|patch|delete))\([ \t\r\n]*`?['"]?([^'"`)]+)"""


def routes(files: DataFrame) -> DataFrame:
    """doc_id, method, route of the routes that files of servers declare, each once."""
    e, found = paths.extension(F.col("rel_path")), []
    same = lambda method: lambda _: F.lit(method)
    for ends, pattern, method, route, default in ROUTES:
        names = _all(pattern, route)
        verbs = F.transform(_all(pattern, method), F.upper) if method else F.transform(names, same(default))
        found.append(F.when(e.isin(ends), F.arrays_zip(verbs.alias("method"), names.alias("route"))))
    none = F.array().cast("array<struct<method:string,route:string>>")
    rows = files.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.concat(*(F.coalesce(x, none) for x in found))).alias("r"))
    return rows.select("doc_id", "r.method", "r.route").distinct()


def calls(files: DataFrame) -> DataFrame:
    """doc_id, call of the requests that scripts make to an interface, each once."""
    rows = files.where(paths.extension(F.col("rel_path")).isin(SCRIPT_EXTENSIONS) & F.col("text").isNotNull()).select("doc_id", F.explode(_all(CALL, 1)).alias("call"))
    wanted = F.col("call").contains(CALL_PART)
    for start in CALL_STARTS:
        wanted = wanted | F.col("call").startswith(start)
    return rows.where(wanted).distinct()
