"""Files as tables: directories, encodings, archives; and texts written out again."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import classify
from cairn.functions.redact import redact_line
from cairn.operators.export import file_banner
from cairn.operators.rules import IgnoredDirs, Rules, glob_regex, not_looked_into
from cairn.operators.structure import walk_key
from cairn.runtime import arrow_map, ship

# Encodings in the order in which they are tried; the last reads anything.
ENCODINGS = ["utf-8", "utf-8-sig", "cp1251", "cp866", "utf-16", "latin-1"]


def decode(content: bytes | None) -> str | None:
    if content is None:
        return None
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).removeprefix("﻿")
        except UnicodeError:
            continue
    return None


#: Files of a tree that one task reads: until they hold so many bytes or are so many.
TASK_BYTES, TASK_FILES = 64 << 20, 4096


class _Chunk(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.ignored = set(filter(None, options.get("ignored", "").split("/")))
        self.largest = int(options.get("largest", "0"))

    def partitions(self) -> list[InputPartition]:
        """Files in the order of a walk, those of a directory before its directories; links aren't followed, ignored directories not entered."""
        out: list[list[str]] = [[]]
        held = 0
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = sorted((d for d in dirs if d.lower() not in self.ignored), key=str.upper)
            for name in sorted(names, key=str.upper):
                at = os.path.join(folder, name)
                if not os.path.islink(at):
                    out[-1].append(os.path.relpath(at, self.root))
                    held += os.path.getsize(at)
                    if held >= TASK_BYTES or len(out[-1]) >= TASK_FILES:
                        out.append([])
                        held = 0
        return [_Chunk(names) for names in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.names:
            at = os.path.join(self.root, name)
            stat = os.stat(at)
            content = None
            if not self.largest or stat.st_size <= self.largest:
                with open(at, "rb") as f:
                    content = f.read()
            yield name.replace(os.sep, "/"), stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), content


class TreeSource(DataSource):
    """spark.read.format("filetree").load(folder): every file below a folder that all executors have mounted, hidden ones too.

    Options: ignored (names of directories, with `/` between them), largest (bytes; larger files have no content).
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "rel_path string, size bigint, mtime timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def directory(spark: SparkSession, root: str, glob: str = "*", largest: int | None = None, ignored: IgnoredDirs | None = None) -> DataFrame:
    """rel_path, size, mtime, content of every file below root; with largest, the content of larger files is null.

    A folder without a scheme (or file://) is walked, ignored directories left out. Elsewhere Spark lists the files,
    which leaves out names that begin with `.` or `_`, and files over largest.
    """
    if "://" not in root or root.startswith("file://"):
        ship(spark)
        spark.dataSource.register(TreeSource)
        rows = spark.read.format("filetree").option("ignored", "/".join(x for x in (ignored or IgnoredDirs()).names() if "/" not in x)).option("largest", str(largest or 0)).load(root)
        return rows if glob == "*" else rows.where(F.substring_index("rel_path", "/", -1).rlike(glob_regex(glob)))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = rows.where(F.col("length") <= largest) if largest else rows
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.expr("substring(path, locate(base, path) + length(base) + 1)")
    return rows.withColumn("base", base).select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def walked(files: DataFrame, rules: Rules | None = None, ignored: IgnoredDirs | None = None) -> DataFrame:
    """files without those in directories that aren't looked into, with walk: what puts them in the order of a walk."""
    return files.where(~not_looked_into(F.col("rel_path"), rules, ignored)).withColumn("walk", walk_key(F.col("rel_path")))


def texts(files: DataFrame) -> DataFrame:
    """files with text: decoded content of text files; null where the name or the first bytes say binary."""
    read = F.pandas_udf(lambda s: s.map(lambda b: decode(bytes(b)) if b is not None else None), "string")
    text = F.when(classify.is_text(F.col("rel_path")) & ~classify.is_binary_sniff(F.col("content")), read("content"))
    return files.withColumn("text", text)


def snapshot(files: DataFrame) -> DataFrame:
    """rel_path, sha256, size_bytes, loc of files with content and text."""
    from cairn.operators.lines import non_empty_lines

    return files.select("rel_path", F.sha2("content", 256).alias("sha256"), F.col("size").alias("size_bytes"), F.coalesce(non_empty_lines(F.col("text")), F.lit(0)).cast("long").alias("loc"))


#: Archives are read in one piece each; larger ones are told as an error rather than read.
LARGEST_ARCHIVE = 1 << 30


def stays_inside(name: str) -> bool:
    """Whether a member of an archive stays in the folder it is put into: only plain parts, none of them up or a drive."""
    parts = name.replace("\\", "/").split("/")
    return not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def zip_members(spark: SparkSession, root: str, glob: str = "*.zip") -> DataFrame:
    """archive, rel_path, size, content of the members of all archives below root that stay inside.

    Archives are read by Spark, so root may be in any file system that it knows; a set of archives is a folder. An
    archive is one task's row. What isn't an archive has no members.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = rows.where(F.col("length") <= LARGEST_ARCHIVE).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not zipfile.is_zipfile(io.BytesIO(content.as_py())):
                    continue
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if not info.is_dir() and stays_inside(info.filename):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info.filename]), pa.array([info.file_size], pa.int64()), pa.array([z.read(info)], pa.binary())], names=["archive", "rel_path", "size", "content"])

    return arrow_map(rows, members, "archive string, rel_path string, size bigint, content binary")


def report_text(files: DataFrame, largest: int | None = None) -> DataFrame:
    """files with text for reports: null over largest bytes or where the first bytes say binary, else as UTF-8 with what can't be read replaced."""
    fits = F.lit(True) if largest is None else F.length("content") <= largest
    lossy = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "replace") if b is not None else None), "string")
    return files.withColumn("text", F.when(fits & ~classify.is_binary_sniff(F.col("content")), lossy("content")))


def zip_parts(entries: DataFrame, folder: str) -> DataFrame:
    """archive, part, bytes of the zip files that entries (archive, part, path, content) are written to, one per part.

    A part is bounded by its target size, so it fits a task; a part is written under another name, then renamed. The
    folder must be one that all executors have mounted, as the shared folder is.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        import os

        archive, part = frame["archive"].iloc[0], int(frame["part"].iloc[0])
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for path, content in sorted(zip(frame["path"], frame["content"])):
                z.writestr(zipfile.ZipInfo(path.replace("\\", "/")), bytes(content))
        name = os.path.join(folder.removeprefix("file://"), f"{archive}.part{part:03d}.zip")
        with open(name + ".partial", "wb") as f:
            f.write(buffer.getvalue())
        os.replace(name + ".partial", name)
        return pd.DataFrame({"archive": [str(archive)], "part": [part], "bytes": [buffer.tell()]})

    return entries.groupBy("archive", "part").applyInPandas(write, "archive string, part int, bytes bigint")


def text_dump(files: DataFrame, folder: str, redact: bool = True) -> None:
    """Writes rel_path, size, modified, text as files of banners and texts, in path order over all files: a range per file written.

    Secrets are replaced line by line unless redact is false.
    """
    rows = files.where(F.col("text").isNotNull())
    if redact:
        ship(files.sparkSession)
        rows = rows.withColumn("text", F.pandas_udf(lambda s: s.map(lambda t: "\n".join(redact_line(line) for line in t.split("\n"))), "string")("text"))
    shown = rows.select(F.lower("rel_path").alias("key"), file_banner(F.col("rel_path"), F.col("size"), F.coalesce(F.col("modified"), F.lit("")), F.col("text")).alias("value"))
    shown.repartitionByRange("key").sortWithinPartitions("key").select("value").write.mode("overwrite").text(folder)


def copied(files: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """Writes the content of the files that are copied (outcomes of export.copy_outcomes) as a table by project: rel_path, content."""
    chosen = outcomes.where("outcome = 'copied'").select("project_id", "rel_path")
    files.join(chosen, ["project_id", "rel_path"], "left_semi").write.mode("overwrite").partitionBy("project_id").parquet(folder)
