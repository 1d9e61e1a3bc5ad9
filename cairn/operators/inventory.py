"""What a corpus of files consists of: counts and sizes by kind and place, duplicates, the largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths


def by_key(files: DataFrame, key: Column, name: str) -> DataFrame:
    """name, files, bytes for each value of key. files: rel_path, size."""
    return files.groupBy(key.alias(name)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, the largest size, and distinct directories that hold files."""
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.countDistinct(paths.parent(F.col("rel_path"))).alias("directories"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, files, bytes: a file counts in every directory above it."""
    rows = files.select(F.explode(paths.ancestors(F.col("rel_path"))).alias("folder"), "size")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, k: int = 25) -> DataFrame:
    """The k largest files; ties by path."""
    return files.orderBy(F.col("size").desc(), F.col("rel_path"), F.col("doc_id")).limit(k)


def deepest(files: DataFrame, k: int = 25) -> DataFrame:
    rows = files.withColumn("depth", paths.depth(F.col("rel_path")))
    return rows.orderBy(F.col("depth").desc(), F.col("rel_path"), F.col("doc_id")).limit(k)


# Names that every package has.
COMMON_NAMES = ["__init__.py", "index.ts", "index.tsx"]


def repeated_names(files: DataFrame, least: int = 3) -> DataFrame:
    """name, files, bytes of file names that occur at least so often."""
    rows = files.select(F.lower(paths.name(F.col("rel_path"))).alias("name"), "size").where(~F.col("name").isin(COMMON_NAMES))
    return rows.groupBy("name").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).where(F.col("files") >= least)


def same_content(files: DataFrame) -> DataFrame:
    """sha256, files, first_id of contents that occur more than once. files: doc_id, text."""
    rows = files.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id").where(F.col("sha256").isNotNull())
    return rows.groupBy("sha256").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id")).where(F.col("files") > 1)
