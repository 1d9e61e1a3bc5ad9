"""Queries of the training-data operators. SQL can't express them; the tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.mixing import Mix
from cairn.llm.packing import fill_report, packed
from cairn.llm.pages import residue
from cairn.llm.secrets import credential_lines, redacted_texts
from cairn.llm.tokens import token_counts
from cairn.runtime import cut, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = credential_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "documents")
    findings = table(spark, sf_dir, "finding").select("id", "message").distinct()
    messages = credential_lines(findings, "id", "message", "finding").withColumn("line", F.lit(1).cast("long")).distinct()
    return documents.unionByName(messages)


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold credentials, with only those replaced."""
    return redacted_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p3_redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of earlier scans that still hold credentials, with only those replaced."""
    return redacted_texts(table(spark, sf_dir, "finding"), "id", "message")


def p5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_capacity"))


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(cut(p5_packed(spark, sf_dir)), table(spark, sf_dir, "pack_capacity"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(token_counts(table(spark, sf_dir, "documents"), ("source",)), table(spark, sf_dir, "mix_target"))


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).chosen()


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p6_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a record, in the order of the mix's slots."""
    return _mix(spark, sf_dir).uses()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents were left out, by kind and by what showed it."""
    return residue(table(spark, sf_dir, "documents")).groupBy("kind", "evidence").agg(F.count("*").alias("documents"))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with content of their own."""
    left_out = residue(table(spark, sf_dir, "documents")).select("doc_id")
    return table(spark, sf_dir, "documents").join(left_out, "doc_id", "left_anti").select("doc_id", "source", "text")


QUERIES = {
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_redacted_messages": p3_redacted_messages,
    "p5_packed": p5_packed,
    "p5_fill": p5_fill,
    "p6_mix": p6_mix,
    "p6_shares": p6_shares,
    "p6_schedule": p6_schedule,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p7_kept": p7_kept,
}
ORACLE: dict[str, str] = {}
