"""Texts without their secrets, and stable labels for each distinct secret."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.redact import label_column, redact_column, secret_column
from cairn.operators.findings import ANCHORS
from cairn.operators.lines import numbered_lines
from cairn.runtime import bucketed_positions, cut, join_counted, ship

PLACEHOLDER = r"<REDACTED(>|:|_)"


def redacted_lines(files: DataFrame) -> DataFrame:
    """files' key columns, line, redacted: the lines that hold secrets, without them. files: any keys, text."""
    ship(files.sparkSession)
    lines = numbered_lines(files).where(F.col("content").rlike(ANCHORS))
    out = lines.withColumn("redacted", redact_column("content"))
    return out.where(F.col("redacted") != F.col("content")).drop("content")


def label_map(files: DataFrame, order: str) -> DataFrame:
    """secret, label: each distinct secret numbered by where it is first seen, in the order of the integer column order.

    The label is a number, never a hash of the secret: a hash would let its holder confirm a guess. Numbers are given
    by two-level counts, so the secrets needn't be put in order in one task.
    """
    ship(files.sparkSession)
    seen = numbered_lines(files.select(F.col(order).alias("at"), "text")).where(F.col("content").rlike(ANCHORS)).withColumn("s", secret_column("content"))
    each = seen.select("at", "line", F.posexplode("s").alias("k", "secret")).where(F.length("secret") > 0)
    first = each.groupBy("secret").agg(F.min(F.struct("at", "line", "k")).alias("f")).select("secret", "f.*")
    numbered = bucketed_positions(first.withColumn("g", F.lit(0)).select("g", "at", "line", "k", "secret"), ["g"], "at", 4096)
    return numbered.select("secret", F.concat(F.lit("<REDACTED:s"), F.col("pos") + 1, F.lit(">")).alias("label"))


def labelled_lines(files: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """key, line, redacted: the lines that hold secrets, each secret under its label. labels: label_map of the same files.

    A secret that very many lines hold goes to its lines; those aren't gathered in one task.
    """
    lines = cut(numbered_lines(files.select(key, "text")).where(F.col("content").rlike(ANCHORS)).withColumn("s", secret_column("content")).where(F.size("s") > 0))
    each = lines.select(key, "line", F.explode(F.array_distinct("s")).alias("secret"))
    counted = cut(each.groupBy("secret").agg(F.count("*").alias("n")).join(labels, "secret"))
    named = join_counted(each, counted, ["secret"], "n").groupBy(key, "line").agg(F.map_from_entries(F.collect_set(F.struct("secret", "label"))).alias("labels"))
    out = lines.drop("s").join(named, [key, "line"]).withColumn("redacted", label_column("content", "labels"))
    return out.select(key, "line", "redacted")


def placeholder_counts(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, placeholders: how many redactions the texts already hold."""
    return texts.groupBy(*by).agg(F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(PLACEHOLDER))).alias("placeholders"))
