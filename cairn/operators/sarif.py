"""Findings as one document per scan: SARIF 2.1.0, JSON, and plain text.

A document is made of lines that follow each other: its head, a line per finding, its tail. No task holds a whole
document, however many findings a scan has; the lines of a scan, put one after the other by place, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import policy

# Fixed values of the formats.
SARIF_SCHEMA, SARIF_VERSION, JSON_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0", "1.0"
SHORT_TEXT = 120

_SORT = "struct<part:int,rank:int,file:string,line:int,rule:string,message:string>"


def _order() -> Column:
    return F.struct(F.lit(1).alias("part"), policy.severity_rank(F.col("severity")).alias("rank"), F.lower("file").alias("file"), F.coalesce("line", F.lit(0)).cast("int").alias("line"), F.col("rule").alias("rule"), F.col("message").alias("message"))


def _edge(part: int) -> Column:
    return F.struct(*(F.lit(part if n == "part" else None).cast(t).alias(n) for n, t in (x.split(":") for x in _SORT[7:-1].split(",")))).cast(_SORT)


def _document(findings: DataFrame, scan: str, body: Column, head: DataFrame, tail: str) -> DataFrame:
    """scan, place, text of the lines: head (scan, text), bodies with commas between them, and the tail."""
    rows = findings.select(F.col(scan).alias("scan"), _order().alias("place"), body.alias("text"))
    first = rows.groupBy("scan").agg(F.min("place").alias("first"))
    rows = rows.join(first, "scan").select("scan", "place", F.when(F.col("place") == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), F.col("text"))).alias("text"))
    edges = head.select("scan", _edge(0).alias("place"), "text").unionByName(head.select("scan", _edge(2).alias("place"), F.lit(tail).alias("text")))
    return rows.unionByName(edges)


def sarif_lines(findings: DataFrame, scan: str, tool: str = "cairn") -> DataFrame:
    """scan, place, text: SARIF of each scan; rules stand in the order in which findings show them first. findings: distinct rows of scan() and the scan they are of."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    uri = F.translate(F.regexp_replace("file", r"^\.[\\/]", ""), "\\", "/")
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")))
    by_rule = findings.groupBy(F.col(scan).alias("scan"), "rule").agg(F.min(F.struct(_order().alias("o"), "message")).alias("m"))
    entry = F.struct("m.o", F.struct(F.col("rule").alias("id"), F.col("rule").alias("name"), F.struct(F.substring("m.message", 1, SHORT_TEXT).alias("text")).alias("shortDescription")).alias("r"))
    rules = by_rule.groupBy("scan").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["r"]).alias("rules"))  # as many as there are rules
    driver = F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")))
    head = rules.select("scan", F.concat(F.lit(f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":'), driver, F.lit(',"results":[')).alias("text"))
    return _document(findings, scan, result, head, "]}]}")


def json_lines(findings: DataFrame, scan: str, generated_at: str) -> DataFrame:
    """scan, place, text: the JSON report of each scan, with its summary."""
    kinds = [F.count_if(F.col("type") == k).alias(n) for k, n in (("sensitive_file", "sensitive_files"), ("potential_secret", "potential_secrets"), ("risky_code", "risky_code"))]
    summary = findings.groupBy(F.col(scan).alias("scan")).agg(*kinds, F.count("*").alias("total_findings"))
    counts = F.to_json(F.struct("sensitive_files", "potential_secrets", "risky_code", "total_findings"))
    head = summary.select("scan", F.concat(F.lit(f'{{"schema_version":"{JSON_VERSION}","generated_at":"{generated_at}","summary":'), counts, F.lit(',"findings":[')).alias("text"))
    return _document(findings, scan, F.to_json(F.struct("type", "severity", "confidence", "file", "line", "rule", "message")), head, "]}")


def text_lines(findings: DataFrame, scan: str) -> DataFrame:
    """scan, place, text: a line per finding as people read it, most severe first."""
    at = F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line"))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("file"), at, F.lit(" "), F.col("rule"), F.lit(" - "), F.col("message"))
    return findings.select(F.col(scan).alias("scan"), _order().alias("place"), line.alias("text"))
