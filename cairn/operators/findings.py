"""Findings: sensitive files, secrets and risky code, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify, detect, paths, policy
from cairn.functions.redact import redact_message
from cairn.operators.lines import numbered_lines

#: What a line must hold for a rule whose value can be cut out to match; most lines have none of it.
ANCHORS = r"(?i)key|secret|token|pass|database|bearer|basic|digest|private|akia|gh[pous]_|github_pat_|aiza|xox[baprs]-|_live_|sk-|eyj|://|[0-9]{8}:"
#: The same for any rule.
PREFILTER = ANCHORS + r"|eval|exec|subprocess|pickle|yaml|innerhtml|document\.write|localstorage|[a-z0-9+/=_\-]{20}"


def line_findings(files: DataFrame) -> DataFrame:
    """files' key columns, type, severity, confidence, line, rule, content of secrets and risky code. files: rel_path, text.

    Lines are made once: what is found on a line is an array, which is taken apart.
    """
    lines = numbered_lines(files).where(F.col("content").rlike(PREFILTER))
    keys = [c for c in files.columns if c != "text"]
    hit = lambda kind, severity, confidence, rule: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), confidence.alias("confidence"), rule.alias("rule"))
    secret = F.transform(F.array(detect.secret(F.col("content"))), lambda s: F.when(s.isNotNull(), hit("potential_secret", s["confidence"], s["confidence"], s["rule"])))
    risky = F.transform(detect.risky(F.col("content")), lambda r: hit("risky_code", r["severity"], F.lit("medium"), r["rule"]))
    found = lines.withColumn("h", F.explode(F.array_compact(F.concat(secret, risky))))
    return found.select(*keys, "h.type", "h.severity", "h.confidence", "line", "h.rule", "content")


def sensitive_files(files: DataFrame) -> DataFrame:
    """files that are sensitive by name, with severity; their findings have no line."""
    return files.withColumn("severity", policy.sensitive_severity(F.col("rel_path"))).where(F.col("severity").isNotNull())


def scan(files: DataFrame) -> DataFrame:
    """type, severity, confidence, file, line, rule, message: every finding; messages hold no secret value.

    files: rel_path, text; one row per file. Only files that are text by name are read. Null texts have no lines.
    """
    shown = F.concat(F.lit(".\\"), paths.display(F.col("rel_path")))
    named = sensitive_files(files.select("rel_path")).select(
        F.lit("sensitive_file").alias("type"), "severity", F.lit("high").alias("confidence"), shown.alias("file"), F.lit(None).cast("int").alias("line"), F.lit("sensitive_file").alias("rule"),
        F.lit("Sensitive file by name.").alias("message"),
    )
    read = line_findings(files.select("rel_path", "text").where(classify.is_text(F.col("rel_path"))))
    explained = F.try_element_at(F.create_map(*(F.lit(x) for r, _, _, m in detect.RISKY for x in (r, m))), F.col("rule"))
    message = F.when(F.col("type") == "risky_code", explained).otherwise(redact_message("content"))
    return named.unionByName(read.select("type", "severity", "confidence", shown.alias("file"), F.col("line").cast("int"), "rule", message.alias("message")))


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by file and line."""
    return findings.orderBy(policy.severity_rank(F.col("severity")), F.lower("file"), "line", "rule")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings by kind, and how many are critical."""
    kinds = [F.count_if(F.col("type") == k).alias(k) for k in ("sensitive_file", "potential_secret", "risky_code")]
    return findings.agg(*kinds, F.count_if(F.col("severity") == "critical").alias("critical"))


# How a run of the scan ends.
EXIT_CODES = {"success": 0, "failure": 1, "bad_arguments": 2, "critical_secrets": 3}


def exit_code(gating: int, failed: bool = False, arguments: bool = True) -> int:
    """The code a run ends with: failures come before findings."""
    return EXIT_CODES["bad_arguments" if not arguments else "failure" if failed else "critical_secrets" if gating else "success"]


def gates(findings: DataFrame) -> DataFrame:
    """fail_on, gating, exit_code for each severity that a run may fail on, in one pass."""
    ranks = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    rank = policy.severity_rank(F.lower("severity"))
    wide = findings.agg(*(F.count_if(rank <= r).alias(name) for name, r in ranks.items()))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("fail_on"), F.col(n).alias("gating")) for n in ranks))).alias("g")).select("g.*")
    return rows.withColumn("exit_code", F.when(F.col("gating") > 0, EXIT_CODES["critical_secrets"]).otherwise(EXIT_CODES["success"]))


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row: how many findings are at least as severe as fail_on, and whether that fails a run."""
    limit = F.lit({"critical": 0, "high": 1, "medium": 2, "low": 3}.get(fail_on, 9))
    n = F.count_if(policy.severity_rank(F.col("severity")) <= limit)
    return findings.agg(n.alias("gating"), (n > 0).alias("failed"))


def screened(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """findings with fingerprint, suppressed and reason: what an allow list (fingerprint, reason) lets pass."""
    marked = findings.withColumn("fingerprint", detect.fingerprint(F.col("rule"), F.col("file"), F.coalesce("message", F.lit(""))))
    entries = allowed.groupBy("fingerprint").agg(F.min(F.coalesce("reason", F.lit(""))).alias("reason"))
    out = marked.join(entries, "fingerprint", "left")
    return out.withColumn("suppressed", F.col("reason").isNotNull()).withColumn("reason", F.coalesce("reason", F.lit("")))
