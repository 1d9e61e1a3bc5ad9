"""Texts as numbered lines, and what lines are counted by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths

# Markers of open work.
TODO_WORDS = ["TODO", "FIXME", "HACK", "XXX", "BUG", "TEMP", "REFACTOR", "DEPRECATED"]
TODO = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(TODO_WORDS) + r")(?![\p{L}\p{N}_])"
_COMMENT = r"^(//|/\*|\*|#|<!--|--)"


def split_lines(text: Column) -> Column:
    """The lines of text without their ends; what follows the last line end is a line only if it isn't empty."""
    pieces = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(pieces, lambda s: F.regexp_replace(s, r"\r\z", "")))


def numbered_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with line (from 1) and content instead of text; one row per line. Null and empty texts have no lines."""
    kept = [c for c in files.columns if c != text]
    rows = files.select(*kept, F.posexplode(split_lines(F.col(text))).alias("_at", "content"))
    return rows.select(*kept, (F.col("_at") + 1).alias("line"), "content")


def non_empty_lines(text: Column) -> Column:
    return F.size(F.filter(split_lines(text), lambda s: F.trim(F.translate(s, "\t\r\f", "   ")) != ""))


def line_kinds(text: Column) -> Column:
    """total, blank, comment and code lines."""
    rows = F.transform(split_lines(text), lambda s: F.trim(F.translate(s, "\t\r\f", "   ")))
    blank, comment = F.size(F.filter(rows, lambda s: s == "")), F.size(F.filter(rows, lambda s: s.rlike(_COMMENT)))
    return F.struct(F.size(rows).alias("total"), blank.alias("blank"), comment.alias("comment"), (F.size(rows) - blank - comment).alias("code"))


def code_metrics(files: DataFrame) -> DataFrame:
    """extension, files, total, blank, comment and code lines, files of at least 500 and 1000 lines. files: rel_path, text."""
    rows = files.select(paths.extension_key(F.col("rel_path")).alias("extension"), line_kinds(F.col("text")).alias("k")).where(F.col("k").isNotNull())
    sums = [F.sum(f"k.{c}").alias(c) for c in ("total", "blank", "comment", "code")]
    return rows.groupBy("extension").agg(F.count("*").alias("files"), *sums, F.count_if(F.col("k.total") >= 500).alias("files_500"), F.count_if(F.col("k.total") >= 1000).alias("files_1000"))


def todo_markers(lines: DataFrame) -> DataFrame:
    """lines with kind: the first marker on the line, in capitals; lines without one are left out."""
    return lines.where(F.col("content").rlike(TODO)).withColumn("kind", F.upper(F.regexp_extract("content", TODO, 1)))
