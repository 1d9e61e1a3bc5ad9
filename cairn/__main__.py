"""python -m cairn preview|scan|reports FOLDER: what an export of a folder would hold, what a scan finds, which reports there are.

Prints one JSON object (schema_version, command, and what the command found). Exit codes: 0 done, 1 failed, 2 wrong
arguments, 3 findings at or above --fail-on.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import ConfigError, allow_list, project_config
from cairn.operators import findings, rules
from cairn.operators.findings import EXIT_CODES, exit_code
from cairn.sources import files as source

SCHEMA_VERSION = "1.0"
IGNORE_FILE = ".exportignore"


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rules(folder: Path, settings: dict) -> rules.Rules:
    """The rules of a folder: its ignore file, and its settings."""
    file = folder / IGNORE_FILE
    out = rules.Rules.parse(file.read_text() if file.is_file() else "", settings.get("custom_excluded_extensions", []))
    return rules.with_overrides(out, settings.get("always_include_files", []), settings.get("custom_excluded_files", []))


def preview(spark: SparkSession, folder: Path, settings: dict) -> dict:
    """How many files would go out and how many not."""
    rows = source.directory(spark, str(folder)).select("rel_path", "size")
    planned = rules.plan(rows, _rules(folder, settings), settings.get("safe_export_mode", "safe"), rules.IgnoredDirs(settings.get("extra_ignored_dirs", [])))
    return {"summary": [r.asDict() for r in rules.plan_summary(planned).orderBy("status").collect()]}


def scan(spark: SparkSession, folder: Path, settings: dict, allowed: dict[str, str], fail_on: str) -> tuple[dict, int]:
    """What a scan of all files finds, but for what an allow list lets pass."""
    rows = source.walked(source.texts(source.directory(spark, str(folder))), None, rules.IgnoredDirs(settings.get("extra_ignored_dirs", [])))
    entries = spark.createDataFrame(list(allowed.items()), "fingerprint string, reason string")
    found: DataFrame = findings.screened(findings.scan(rows.select("rel_path", "text")).distinct(), entries)
    active = found.where("NOT suppressed")
    gating = {r.fail_on: r.gating for r in findings.gates(active).collect()}[fail_on]
    counted = active.groupBy("type", "severity", "rule").agg(F.count("*").alias("findings")).orderBy("type", "severity", "rule")
    return {"findings": [r.asDict() for r in counted.collect()], "suppressed": found.where("suppressed").count(), "gating": gating}, gating


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="cairn")
    parser.add_argument("command", choices=["preview", "scan", "reports"])
    parser.add_argument("folder", type=Path)
    parser.add_argument("--settings", type=Path, help="a settings file (TOML)")
    parser.add_argument("--allow", type=Path, help="an allow list (TOML)")
    parser.add_argument("--fail-on", default="critical", choices=["critical", "high", "medium", "low"])
    try:
        given = parser.parse_args(arguments)
        settings = project_config(given.settings.read_text()) if given.settings else {}
        allowed = allow_list(given.allow.read_text()) if given.allow else {}
    except SystemExit as e:
        return EXIT_CODES["bad_arguments"] if e.code else EXIT_CODES["success"]
    except (OSError, ConfigError) as e:
        print(e, file=sys.stderr)
        return EXIT_CODES["bad_arguments"]
    gating = 0
    try:
        spark = _session()
        if given.command == "preview":
            payload = preview(spark, given.folder, settings)
        elif given.command == "scan":
            payload, gating = scan(spark, given.folder, settings, allowed, given.fail_on)
        else:
            from cairn.queries.exports import catalogue

            payload = {"reports": [{"name": r.name, "profiles": list(r.profiles), "about": r.about} for r in catalogue().reports.values()]}
    except Exception as e:  # whatever fails, the caller gets the code for it
        print(e, file=sys.stderr)
        return exit_code(0, failed=True)
    print(json.dumps({"schema_version": SCHEMA_VERSION, "command": given.command, **payload}))
    return exit_code(gating)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
