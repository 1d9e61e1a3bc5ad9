"""Credentials in a table of texts: where they begin, and the texts with only them replaced."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.credentials import candidates, credentials, lines_of, redact
from cairn.runtime import arrow_map, spread

#: What replaces a credential.
MARK = "<REDACTED>"


#: Characters of texts that the automaton goes over together.
TOGETHER = 1 << 22


def _scanned(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list]]:
    """Key, text and credentials of each row, the automaton going over many texts at once."""
    rows, size = [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        rows.append((key, text))
        size += len(text)
        if size >= TOGETHER:
            yield from _together(rows)
            rows, size = [], 0
    yield from _together(rows)


def _together(rows: list[tuple[int, str]]) -> Iterator[tuple[int, str, list]]:
    for (key, text), lines in zip(rows, candidates([text for _, text in rows])):
        yield key, text, credentials(text, lines)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = [], []
        for key, text, where in _scanned(batch):
            for line in lines_of(text, where):
                ids.append(key)
                lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["record_id", "line"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, where in _scanned(batch):
            if where:
                out.append((key, redact(text, where, MARK), len(where)))
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["record_id", "text", "credentials"])


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return spread(rows.select(F.col(key).cast("long").alias("record_id"), F.col(text).alias("text")).where(F.col("record_id").isNotNull() & (F.length("text") > 0)))


def credential_lines(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """source_table (name), record_id, line: the lines of text, counted from 1, on which a literal credential begins.

    Each row is scanned on its own, whole, where it lies; only lines found are shuffled, to count repeated rows
    once. Null ids and texts are left out. An empty table gives no rows.
    """
    found = arrow_map(_texts(rows, key, text), _lines, "record_id bigint, line bigint")
    return found.distinct().select(F.lit(name).alias("source_table"), "record_id", "line")


def redacted_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """record_id, text, credentials: the texts that hold credentials, with each replaced by MARK, and how many.

    Quotes, names and line ends stand as they were. Repeated rows count once.
    """
    return arrow_map(_texts(rows, key, text), _redacted, "record_id bigint, text string, credentials bigint").distinct()
