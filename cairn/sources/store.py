"""The history of runs as tables in a folder: written as one, read as of the last whole write, with migrations and retention.

A generation is a folder of all tables; CURRENT names the one that counts, and is replaced in one step. A run is written
into the tables first and becomes visible by its row in export_run, which is written last: readers join on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.store import retained

# Tables of the history and their columns, as of each version of the schema.
VERSIONS = [
    {
        "project": "id bigint, root_path string, name string, primary_stack string, created_at bigint, last_export_at bigint",
        "export_run": "id bigint, project_id bigint, started_at bigint, finished_at bigint, profile string, safe_mode string, diff_mode string, files_copied bigint, bytes_total bigint, tokens_est bigint, redacted_count bigint, cancelled boolean, result_path string",
        "run_file": "run_id bigint, rel_path string, size_bytes bigint, status string, reason string",
        "finding": "run_id bigint, type string, severity string, confidence string, file string, line int, rule string, message string",
        "archive_part": "run_id bigint, part_index int, archive_name string, compressed_bytes bigint, groups string",
        "export_snapshot": "id bigint, project_id bigint, run_id bigint, created_at bigint, file_count bigint, bytes_total bigint",
        "snapshot_file": "snapshot_id bigint, rel_path string, sha256 string, size_bytes bigint, loc bigint, mtime_ns bigint",
    },
]
#: Columns that a later version adds: (table, column, type), per version after the first.
MIGRATIONS: list[list[tuple[str, str, str]]] = [[("export_snapshot", "branch", "string")]]


def columns(table: str, version: int) -> str:
    extra = [f"{c} {t}" for step in MIGRATIONS[: version - 1] for name, c, t in step if name == table]
    return ", ".join([VERSIONS[0][table], *extra])


class Store:
    """Tables of a history below a folder that all executors share. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._current() is None:
            self._point(uuid.uuid4().hex, len(MIGRATIONS) + 1)
        self.migrate()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _current(self) -> tuple[str, int] | None:
        """The generation that counts and its version: the last pointer, whose name begins with its number."""
        if not self.system.exists(self._path("CURRENT")):
            return None
        names = sorted(s.getPath().getName() for s in self.system.listStatus(self._path("CURRENT")))
        if not names:
            return None
        _, generation, version = names[-1].split("-")
        return generation, int(version)

    def _point(self, generation: str, version: int) -> None:
        """Makes generation the one that counts: creating a file is one step."""
        self.system.mkdirs(self._path("CURRENT"))
        number = len(self.system.listStatus(self._path("CURRENT")))
        if not self.system.createNewFile(self._path(f"CURRENT/{number:09d}-{generation}-{version}")):
            raise RuntimeError("another writer was faster")

    @property
    def version(self) -> int:
        return self._current()[1]

    def migrate(self) -> None:
        """Brings the schema to the last version: columns that are added are null in older files, so no table is rewritten."""
        generation, version = self._current()
        if version > len(MIGRATIONS) + 1:
            raise RuntimeError(f"the store is of version {version}, which is newer than this program")
        if version < len(MIGRATIONS) + 1:
            self._point(generation, len(MIGRATIONS) + 1)

    def raw(self, table: str) -> DataFrame:
        generation, version = self._current()
        at = f"{self.folder}/{generation}/{table}"
        if not self.system.exists(self._path(f"{generation}/{table}")):
            return self.spark.createDataFrame([], columns(table, version))
        return self.spark.read.schema(columns(table, version)).parquet(at)

    def table(self, table: str) -> DataFrame:
        """A table as far as its runs are whole: rows of a run without a row of its own aren't seen."""
        rows = self.raw(table)
        runs = self.raw("export_run").select(F.col("id").alias("_run"))
        if table in ("run_file", "finding", "archive_part"):
            return rows.join(runs, rows["run_id"] == runs["_run"], "left_semi")
        if table == "export_snapshot":
            return rows.join(runs, rows["run_id"] == runs["_run"], "left_semi")
        if table == "snapshot_file":
            return rows.join(self.table("export_snapshot").select(F.col("id").alias("_s")), rows["snapshot_id"] == F.col("_s"), "left_semi")
        return rows

    def _append(self, table: str, rows: DataFrame, generation: str) -> None:
        fields = [f.split()[0] for f in columns(table, self.version).split(", ")]
        have = set(rows.columns)
        rows.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in fields)).to(self.spark.createDataFrame([], columns(table, self.version)).schema).write.mode("append").parquet(f"{self.folder}/{generation}/{table}")

    def projects(self, wanted: DataFrame, now: int) -> DataFrame:
        """root_path, project_id of wanted (root_path, name), finding those there are and creating the others."""
        roots = wanted.where("root_path IS NOT NULL").groupBy("root_path").agg(F.min("name").alias("name"))
        new = new_projects(roots, self.raw("project")).withColumn("created_at", F.lit(now).cast("long"))
        if not new.isEmpty():
            self._append("project", new, self._current()[0])
        return self.raw("project").join(roots.select("root_path"), "root_path", "left_semi").groupBy("root_path").agg(F.min("id").alias("project_id"))

    def write_run(self, run: DataFrame, tables: dict[str, DataFrame], successful: bool = True) -> None:
        """Writes one run (a row of export_run) with its tables, the run's own row last. A failed run has no snapshot."""
        generation = self._current()[0]
        for name, rows in tables.items():
            if successful or name not in ("export_snapshot", "snapshot_file"):
                self._append(name, rows, generation)
        self._append("export_run", run, generation)

    def retain(self, keep: int) -> None:
        """Keeps the newest runs of each project and what belongs to them, in a new generation; the old one is deleted afterwards."""
        old, version = self._current()
        new = uuid.uuid4().hex
        for name, rows in retained_tables({t: self.table(t) for t in VERSIONS[0]}, keep).items():
            rows.write.parquet(f"{self.folder}/{new}/{name}")
        self._point(new, version)
        self.system.delete(self._path(old), True)


def new_projects(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """id, root_path, name of the wanted projects (root_path, name) that aren't known, numbered after the largest id by path."""
    missing = wanted.join(known.select("root_path"), "root_path", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # Projects are few beside runs and files: they are folders on someone's machine.
    numbered = missing.withColumn("k", F.row_number().over(Window.orderBy("root_path")))
    return numbered.join(top, F.lit(True)).select((F.col("top") + F.col("k")).cast("long").alias("id"), "root_path", "name")


def retained_tables(tables: dict[str, DataFrame], keep: int) -> dict[str, DataFrame]:
    """The tables with the newest keep runs of each project, and of the others only what belongs to those."""
    runs = tables["export_run"]
    kept = retained(runs, keep).select(F.col("id").alias("_run"))
    out = {"export_run": runs.join(kept, runs["id"] == kept["_run"], "left_semi")}
    for name in ("run_file", "finding", "archive_part", "export_snapshot"):
        if name in tables:
            out[name] = tables[name].join(kept, tables[name]["run_id"] == kept["_run"], "left_semi")
    if "snapshot_file" in tables and "export_snapshot" in out:
        snapshots = out["export_snapshot"].select(F.col("id").alias("_s")).distinct()
        out["snapshot_file"] = tables["snapshot_file"].join(snapshots, tables["snapshot_file"]["snapshot_id"] == F.col("_s"), "left_semi")
    return {name: out.get(name, rows) for name, rows in tables.items()}


def imported(entries: DataFrame) -> DataFrame:
    """entry_id, imported, warning, started_at: what becomes of each entry of an older history, once.

    entries: entry_id, source_root, project_name, generated_at. An entry needs a root, a name, and a time written as
    Y-M-D h:m:s, which is taken as UTC; else it is skipped with a warning. Repeated entries count once.
    """
    known = entries.select("entry_id", "source_root", "project_name", "generated_at").distinct()
    form = r"^\d+-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01]) ([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"
    warning = (
        F.when(F.coalesce("source_root", F.lit("")) == "", "missing or empty required field 'source_root'")
        .when(F.coalesce("project_name", F.lit("")) == "", "missing or empty required field 'project_name'")
        .when(F.col("generated_at").isNull(), "missing required field 'generated_at'")
        .when(~F.col("generated_at").rlike(form), "field 'generated_at' is not a recognized timestamp format")
    )
    p = [F.regexp_extract("generated_at", r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+)$", k).cast("int") for k in range(1, 7)]
    # A day that its month doesn't have counts on into the next one.
    seconds = F.unix_date(F.make_date(p[0], p[1], F.lit(1))).cast("long") * 86_400 + (p[2] - 1) * 86_400 + p[3] * 3600 + p[4] * 60 + p[5]
    rows = known.withColumn("w", warning)
    return rows.select("entry_id", F.col("w").isNull().alias("imported"), F.coalesce("w", F.lit("")).alias("warning"), F.when(F.col("w").isNull(), seconds).alias("started_at"))


def import_report(done: DataFrame) -> DataFrame:
    """warning ('' for those imported), entries."""
    return done.groupBy("warning").agg(F.count("*").alias("entries"))
