"""Dependencies, services and scripts that the build files of a corpus declare."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.manifests import declared
from cairn.runtime import arrow_map

_NAMES = r"^(package\.json|go\.mod|requirements.*\.txt|(gnu)?makefile|(docker-)?compose(\..+)?\.ya?ml)$"


def declarations(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, rel_path, kind, name, value. Only build files, known by name, reach Python."""
    rows = files.where(F.lower(paths.name(F.col("rel_path"))).rlike(_NAMES) & F.col("text").isNotNull()).select(F.col(project).cast("long").alias("project"), "rel_path", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, r, *x) for p, r, t in zip(*(batch.column(k).to_pylist() for k in range(3))) for x in declared(r, t)]
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["project", "rel_path", "kind", "name", "value"])

    return arrow_map(rows, read, "project bigint, rel_path string, kind string, name string, value string")
