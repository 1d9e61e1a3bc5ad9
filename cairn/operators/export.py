"""The steps of an export over a table of files: what is copied, dumped as text, listed in the manifest, and checked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify, paths, policy, sizes

# Files that an export makes itself.
GENERATED = ["manifest.json", "project_profile.json", "index.md", "reports/01_structure.txt", "report_plugins.json"]
GENERATED_FOLDER = "reports/insights/"
#: A line with a longer run of letters and digits, placeholders aside, may hold a credential.
CREDENTIAL_RUN = 12
SAMPLE_BYTES = 8192


def copy_outcomes(planned: DataFrame, selected: DataFrame | None, mode: str) -> DataFrame:
    """planned with outcome: copied, diff (not among the selected paths), safety, error (no content), or excluded by another rule.

    planned: rel_path, status, reason, content known as has_content. Safety is judged anew, whatever the plan said.
    selected: rel_path; None puts no limit.
    """
    skip = policy.safety(F.col("rel_path"), mode)
    rows = planned.withColumn("_skip", skip["reason"])
    if selected is not None:
        rows = rows.join(selected.select("rel_path").distinct().withColumn("_in", F.lit(True)), "rel_path", "left")
    out_of_diff = F.col("_in").isNull() if selected is not None else F.lit(False)
    outcome = (
        F.when((F.col("status") == "excluded") & (F.col("_skip") == F.col("reason")), "safety")
        .when(F.col("status") != "included", "excluded")
        .when(out_of_diff, "diff")
        .when(F.col("_skip").isNotNull(), "safety")
        .when(~F.col("has_content"), "error")
        .otherwise("copied")
    )
    return rows.withColumn("outcome", outcome).select(*planned.columns, "outcome")


def copy_counters(outcomes: DataFrame, skipped_dirs: DataFrame) -> DataFrame:
    """One row: dirs_created (the target and every directory above a copied file), files_copied, dirs_skipped, files_skipped, by safety, by diff, errors."""
    # One pass: a file's outcome is counted with the first of the directories above it.
    above = F.when(F.col("outcome") == "copied", F.concat(F.array(F.lit("")), paths.ancestors(F.col("rel_path")))).otherwise(F.array(F.lit("")))
    rows = outcomes.select("outcome", F.posexplode(above).alias("k", "d"))
    by = lambda o: F.count_if((F.col("outcome") == o) & (F.col("k") == 0))
    dirs_created = F.greatest(F.lit(1), F.countDistinct(F.when(F.col("outcome") == "copied", F.col("d")))).alias("dirs_created")
    counts = rows.agg(dirs_created, by("copied").alias("files_copied"), by("safety").alias("files_skipped"), by("safety").alias("files_skipped_by_safety"), by("diff").alias("files_skipped_by_diff"), by("error").alias("errors"))
    dirs = skipped_dirs.agg(F.countDistinct("directory").alias("dirs_skipped"))
    return counts.join(dirs, F.lit(True))  # one row each


def dump_outcomes(files: DataFrame, largest: int | None) -> DataFrame:
    """files with outcome: not_text by name, large, binary by its first bytes, decode (no text), or written. files: rel_path, size, text."""
    binary = classify.is_binary_sniff(F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES))
    large = F.col("size") > largest if largest else F.lit(False)
    outcome = F.when(~classify.is_text(F.col("rel_path")), "not_text").when(large, "large").when(F.col("text").isNull(), "decode").when(binary, "binary").otherwise("written")
    return files.withColumn("outcome", outcome)


def dump_counters(outcomes: DataFrame) -> DataFrame:
    """One row: scanned, written, skipped_binary, skipped_large, skipped_decode, skipped_not_text."""
    skipped = [F.count_if(F.col("outcome") == o).alias(f"skipped_{o}") for o in ("binary", "large", "decode", "not_text")]
    return outcomes.agg(F.count("*").alias("scanned"), F.count_if(F.col("outcome") == "written").alias("written"), *skipped)


def file_banner(path: Column, size: Column, modified: Column, text: Column) -> Column:
    """A file's text under its path, name, size and time, as it stands in a text dump."""
    rule = F.lit("-" * 100)
    head = [rule, F.concat(F.lit("File: "), paths.display(path)), F.concat(F.lit("Name: "), paths.name(path)), F.concat(F.lit("Size: "), sizes.thousands(size), F.lit(" bytes")), F.concat(F.lit("Modified: "), modified), rule]
    return F.concat_ws("\n", F.lit(""), *head, F.lit(""), F.regexp_replace(text, r"(?<!\n)\z", "\n"))


def is_generated(path: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./|/)+", ""))
    return plain.startswith(GENERATED_FOLDER) | plain.isin(GENERATED)


def not_credential_shaped(line: Column) -> Column:
    """Whether nothing but placeholders on the line could be a credential."""
    rest = F.regexp_replace(line, r"<REDACTED(_SECRET_LINE|_SECRET|:[A-Za-z0-9]*)?>?", " ")
    return ~rest.rlike(f"[A-Za-z0-9]{{{CREDENTIAL_RUN}}}")


def verified(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """findings with generated: whether a finding in a finished bundle stems from the export itself: its file, or a line that only holds placeholders.

    findings: file, line; lines: file, line, content of the bundle, where known.
    """
    rows = findings
    if lines is not None:
        rows = rows.join(lines.select("file", "line", F.col("content").alias("_content")), ["file", "line"], "left")
    shaped = F.coalesce(not_credential_shaped(F.col("_content")), F.lit(False)) if lines is not None else F.lit(False)
    return rows.withColumn("generated", is_generated(F.col("file")) | shaped).select(*findings.columns, "generated")


def verify_summary(checked: DataFrame) -> DataFrame:
    """One row: what of the content of a bundle was found, by kind; generated findings are counted apart."""
    own = ~F.col("generated")
    kind = lambda k: F.count_if(own & (F.col("type") == k))
    return checked.agg(kind("sensitive_file").alias("sensitive_files"), kind("potential_secret").alias("potential_secrets"), kind("risky_code").alias("risky_code"), F.count_if(own).alias("total_findings"), F.count_if(own & (F.lower("severity") == "critical")).alias("critical"), F.count_if(F.col("generated")).alias("generated"))


def manifest(files: DataFrame, findings: DataFrame, project: str = "project_id") -> DataFrame:
    """project, manifest: JSON of a project's files, bytes, tokens, languages and findings by severity. files: rel_path, size; findings: project, severity."""
    lang = files.select(F.col(project).alias("project"), F.coalesce(classify.language(F.col("rel_path")), F.lit("unknown")).alias("language"), "size").groupBy("project", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    whole = lang.groupBy("project").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("language", "files", "bytes"))).alias("languages"))
    found = findings.groupBy("project").agg(F.count("*").alias("findings"), F.count_if(F.lower("severity") == "critical").alias("critical"))
    rows = whole.join(found, "project", "left").fillna(0, ["findings", "critical"])
    body = F.struct(F.lit("1.0").alias("schema_version"), "project", "files", "bytes", sizes.token_estimate(F.col("bytes")).alias("tokens"), "languages", "findings", "critical")
    return rows.select("project", F.to_json(body).alias("manifest"))

