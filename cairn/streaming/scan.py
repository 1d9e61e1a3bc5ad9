"""The line scan over files as they arrive: the same Columns as the batch scan, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cairn.functions import detect
from cairn.operators.findings import PREFILTER
from cairn.operators.lines import numbered_lines
from cairn.operators.rules import IgnoredDirs, not_looked_into


def arriving(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Rows of files that are put into folder; files that go aren't seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(form).load(folder)


def secret_lines(files: DataFrame) -> DataFrame:
    """doc_id, line, rule, confidence of lines with a secret; files may be a stream."""
    rows = numbered_lines(files.select("doc_id", "text")).where(F.col("content").rlike(PREFILTER)).withColumn("s", detect.secret(F.col("content")))
    return rows.where(F.col("s").isNotNull()).select("doc_id", "line", "s.rule", "s.confidence")


def scan_stream(files: DataFrame, to: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes the secret lines of a stream to a table, each once. interval: how long arrivals are gathered; None: all there is, then end."""
    writer = secret_lines(files).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def changes_per_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, events of a stream of ts, event_type; later than late is left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "events")


def listed_changes(before: DataFrame, now: DataFrame, ignored: IgnoredDirs | None = None) -> DataFrame:
    """rel_path, event (create, modify, remove) between two listings of a folder (rel_path, size, mtime), so what goes is seen as well.

    Paths with an ignored directory in them, in any case, are left out.
    """
    old = before.select("rel_path", F.struct("size", "mtime").alias("then"))
    both = now.select("rel_path", F.struct("size", "mtime").alias("now")).join(old, "rel_path", "full_outer")
    event = F.when(F.col("then").isNull(), "create").when(F.col("now").isNull(), "remove").when(F.col("now") != F.col("then"), "modify")
    seen = both.select("rel_path", event.alias("event")).where(F.col("event").isNotNull())
    return seen.where(~not_looked_into(F.concat("rel_path", F.lit("/x")), None, ignored))


#: Milliseconds that must have passed since the last emission.
DEBOUNCE_MS = 400


def debounce(events: list[tuple[int, str]], last: int | None, pending: set[str], wait: int = DEBOUNCE_MS) -> tuple[list[tuple[int, str]], int | None, set[str]]:
    """(at, path) of what is emitted, the time of the last emission, and what waits for the next event.

    Paths gather; the first event at least wait after the last emission emits all that gathered. events: (at, path) in order.
    """
    out = []
    for at, path in events:
        pending = pending | {path}
        if last is None or at - last >= wait:
            out += [(at, p) for p in sorted(pending)]
            last, pending = at, set()
    return out, last, pending


_DEBOUNCED = "root string, at bigint, path string"


def debounced(events: DataFrame, wait: int = DEBOUNCE_MS) -> DataFrame:
    """root, at, path: the events (root, at in milliseconds, path) of each watched root, debounced; events may be a stream.

    A root's events are gone through in order of time and path; in a stream, in the order of its batches.
    """

    def batch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "path"])
        out, _, _ = debounce(list(zip(frame["at"], frame["path"])), None, set(), wait)
        return pd.DataFrame([(frame["root"].iloc[0], a, p) for a, p in out], columns=["root", "at", "path"])

    def stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (None, [])
        rows = pd.concat(list(frames)).sort_values(["at", "path"])
        out, last, waits = debounce(list(zip(rows["at"], rows["path"])), last, set(pending), wait)
        state.update((last, sorted(waits)))
        yield pd.DataFrame([(key[0], a, p) for a, p in out], columns=["root", "at", "path"])

    rows = events.select("root", "at", "path").where("root IS NOT NULL AND at IS NOT NULL AND path IS NOT NULL")
    if events.isStreaming:
        return rows.groupBy("root").applyInPandasWithState(stream, _DEBOUNCED, "last bigint, pending array<string>", "append", GroupStateTimeout.NoTimeout)
    return rows.groupBy("root").applyInPandas(batch, _DEBOUNCED)
