"""Mixed timestamp formats and zones to UTC instants, through a dictionary of the distinct written values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.instants import instant
from cairn.runtime import arrow_map, cut, join_counted, kept

_KEY = ["raw", "tz_name", "locale"]
_DICTIONARY = "raw string, tz_name string, locale string, utc_us bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("raw", pa.string()), ("tz_name", pa.string()), ("locale", pa.string()), ("utc_us", pa.int64())])
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([instant(*x) for x in zip(*columns)], pa.int64())], schema=schema)


def extend_dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary (raw, tz_name, locale, utc_us) of the distinct values; what doesn't denote an instant has null.

    Every distinct value is parsed once; missing zones and locales are ''. With path, the dictionary is kept there:
    only values that it doesn't have yet are parsed, and they are appended in one commit. Two runs at once may both
    append a value, with the same instant; that changes no result.
    """
    distinct = values.select("raw", *(F.coalesce(c, F.lit("")).alias(c) for c in _KEY[1:])).where(F.col("raw").isNotNull()).distinct()
    if path is None:
        return cut(arrow_map(distinct, _parse, _DICTIONARY))
    known = kept(values.sparkSession, path, _DICTIONARY)
    new = cut(arrow_map(distinct.join(known.select(*_KEY), _KEY, "left_anti"), _parse, _DICTIONARY))
    if not new.isEmpty():
        new.write.mode("append").parquet(path)
    return kept(values.sparkSession, path, _DICTIONARY)


def normalised_instants(rows: DataFrame, path: str | None = None) -> DataFrame:
    """source_table, record_id, utc_us: one row per record of rows whose time denotes exactly one instant.

    rows: source_table, record_id, raw, tz_name, locale; other columns are ignored. Nulls, empty and unreadable
    texts give no row, nor do records whose repeated rows denote different instants. An empty table gives no rows.
    path: where the dictionary is kept between runs. A value that a third of all rows share is one entry of the
    dictionary, which goes to its rows; those aren't moved.
    """
    known = rows.select("source_table", "record_id", "raw", *(F.coalesce(c, F.lit("")).alias(c) for c in _KEY[1:])).dropna(subset=["record_id", "raw"])
    counted = cut(known.groupBy(*_KEY).agg(F.count("*").alias("n")))
    dictionary = extend_dictionary(counted, path).where(F.col("utc_us").isNotNull()).distinct()
    placed = join_counted(known, cut(dictionary.join(counted, _KEY)), _KEY, "n")
    one = placed.groupBy("source_table", "record_id").agg(F.min("utc_us").alias("utc_us"), F.max("utc_us").alias("last"))
    return one.where(F.col("utc_us") == F.col("last")).drop("last")
