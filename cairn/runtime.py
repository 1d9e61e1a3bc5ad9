"""Session helpers: reading tables, cutting lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only after its bytes were summed up and found to be at most this many.
BROADCAST_BYTES = 16 << 20
#: A value is hot if more than one in so many rows has it, so there are at most so many hot values.
HOT = 10_000


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per session, so it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="cairn-")) / "cairn.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._cairn_shipped = True


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package at hand in the executors' Python."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it lies in fewer partitions than there are cores, as a table of one small file does; else df as it is.

    Only counted, never collected: the names of a large table's files stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is named, a local one if the master is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        plain = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, plain, True)
        folder = "file://" + plain
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table kept at path, empty if there is none yet; any other failure to read it is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def kept_at(spark: SparkSession, name: str, *of: str) -> str:
    """Where the table called name, of the inputs named, is kept between runs: in the shared folder, and not released."""
    return f"{shared_folder(spark).rstrip('/')}/cairn-kept/{name}-{hashlib.md5(chr(0).join(of).encode()).hexdigest()}"


_CUT: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: later stages survive lost executors and don't recompute it.

    The table stays until release(), as lazy results read it.
    """
    ship(df.sparkSession)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cairn/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Deletes the tables that cut() wrote; results that still read them can't be used any more."""
    for path in _CUT:
        at, system = _file_system(spark, path)
        system.delete(at, True)
    _CUT.clear()


@contextmanager
def only_one(spark: SparkSession, path: str) -> Iterator[bool]:
    """Whether this is the one run that may extend the table kept at path: it holds the lock file beside it meanwhile."""
    at, system = _file_system(spark, path + ".lock")
    mine = system.createNewFile(at)
    try:
        yield mine
    finally:
        if mine:
            system.delete(at, False)


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes: 16 a column, and the length of what isn't of fixed size."""
    fixed = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`") if t in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c, t in df.dtypes if t not in fixed]
    return sum(texts, F.lit(16 * len(df.columns)))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most limit bytes (summed up), else df as it is."""
    size = df.agg(F.sum(_width(df))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with values on keys (which hold no nulls); count says how many rows have the value.

    Values that are small as a whole are broadcast. Else a value that a third of all rows share isn't one task: hot
    values, at most HOT of them, are broadcast if their bytes allow it, and their rows stay where they are; the others
    are joined by a shuffle in which no value has more than one in HOT rows.
    """
    size, total, most = values.agg(F.sum(_width(values)), F.sum(count), F.max(count)).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(values.drop(count)), keys)
    if most * HOT <= total:  # no value is hot
        return rows.join(values.drop(count), keys)
    hot = F.col(count) * HOT > total
    heads = values.where(hot).drop(count)
    if (heads.agg(F.sum(_width(heads))).first()[0] or 0) > BROADCAST_BYTES:  # few, but too long
        return rows.join(values.drop(count), keys)
    heads = F.broadcast(heads)
    cold = rows.join(F.broadcast(values.where(hot).select(*keys)), keys, "left_anti").join(values.where(~hot).drop(count), keys)
    return rows.join(heads, keys).unionByName(cold)


def bucketed_positions(df: DataFrame, group: list[str], order: str, width: int, name: str = "pos") -> DataFrame:
    """df with name: the place (from 0) of each row within its group by the integer column order.

    A group isn't sorted in one task: it falls into buckets of width values of order; the rows of a bucket are
    numbered on their own, and the counts of the earlier buckets are added. Ties go by every other column.
    Rows whose order is null get a null place.
    """
    rest = [c for c in df.columns if c not in {*group, order}]
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("long"))
    counts = bucketed.where(F.col(order).isNotNull()).groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    for c in [*group, "_bucket"]:
        starts = starts.withColumnRenamed(c, f"_s{c}")
    own = Window.partitionBy(*group, "_bucket").orderBy(order, *rest)
    placed = bucketed.withColumn("_rank", F.row_number().over(own))
    same = [placed[c].eqNullSafe(starts[f"_s{c}"]) for c in group] + [placed["_bucket"] == starts["_s_bucket"]]
    out = placed.join(starts, same, "left")
    return out.select(*df.columns, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))


