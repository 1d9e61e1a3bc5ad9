"""A copy of the files without comments, for those that can go out, and what became of each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import detect, policy
from cairn.functions.comments import without_comments
from cairn.operators.structure import stripped_language
from cairn.runtime import arrow_map

# What can become of a file.
STRIPPED, UNSUPPORTED, SENSITIVE, ERROR = "stripped_only_no_formatter_found", "skipped_unsupported_language", "skipped_sensitive_or_redacted", "error"
#: Languages whose grammar is at hand here.
GRAMMARS = ["Python"]


def sterile_copy(files: DataFrame) -> DataFrame:
    """doc_id, language, outcome, text: text without comments where outcome is stripped, else null. files: doc_id, rel_path, text.

    Sensitive files and those with secrets or placeholders of them are left out, as are languages without a grammar
    at hand; what can't be read as its language is an error. Only texts that are stripped reach Python.
    """
    secret = policy.sensitive_severity(F.col("rel_path")).isNotNull() | F.coalesce(F.col("text").rlike(detect.ARMOR) | F.col("text").contains("<REDACTED"), F.lit(False))
    rows = files.select(F.col("doc_id").cast("long"), stripped_language(F.col("rel_path")).alias("language"), "text", secret.alias("secret"))
    early = F.when(F.col("secret"), SENSITIVE).when(F.col("language").isNull() | ~F.col("language").isin(GRAMMARS), UNSUPPORTED).when(F.col("text").isNull(), ERROR)
    judged = rows.withColumn("outcome", early)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_comments(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([ERROR if t is None else STRIPPED for t in texts], pa.string()), pa.array(texts, pa.string())], names=["doc_id", "language", "outcome", "text"])

    done = arrow_map(judged.where("outcome IS NULL").select("doc_id", "language", "text"), strip, "doc_id bigint, language string, outcome string, text string")
    return done.unionByName(judged.where("outcome IS NOT NULL").select("doc_id", "language", "outcome", F.lit(None).cast("string").alias("text")))


def outcomes(copied: DataFrame) -> DataFrame:
    """One row: all files and how many had each outcome."""
    return copied.agg(F.count("*").alias("total_files"), *(F.count_if(F.col("outcome") == o).alias(o) for o in (STRIPPED, UNSUPPORTED, SENSITIVE, ERROR)))
