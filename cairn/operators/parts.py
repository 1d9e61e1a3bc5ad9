"""Choices that depend on an order: what fits a token budget, and where an archive is cut into parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import sizes
from cairn.runtime import arrow_map
from cairn.runtime import cut as cut_table

MIB = 1024 * 1024
PART_TARGET, PART_RESERVE = 500 * MIB, 8 * MIB


def budget_fit(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates with included: in each group the best by importance per token is taken while it fits; what doesn't fit is skipped.

    candidates: group, id, importance, tokens. Ties go by id; 0 tokens come first. Of the items of one size only
    the best budget/size can ever fit, so the others are out before the fold, which then sees at most about
    budget * ln(budget) rows of a group, however many the group has.
    """
    rank = F.when(F.col("tokens") <= 0, F.lit(float("inf"))).otherwise(F.col("importance") / F.col("tokens"))
    rows = candidates.select("group", "id", F.col("importance").cast("double"), F.greatest(F.col("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("rank", rank)
    place = F.row_number().over(Window.partitionBy("group", "tokens").orderBy(F.col("rank").desc(), "id"))
    placed = rows.withColumn("possible", (F.col("tokens") == 0) | (place <= F.floor(F.lit(budget) / F.greatest(F.col("tokens"), F.lit(1)))))
    free = placed.where("tokens = 0")
    columns = "group {g}, id {i}, importance double, tokens bigint, rank double, included boolean".format(g=dict(placed.dtypes)["group"], i=dict(placed.dtypes)["id"])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "id"], ascending=[False, True])
        left, taken = budget, []
        for t in frame["tokens"]:
            taken.append(t <= left)
            left -= t if t <= left else 0
        frame["included"] = taken
        return frame[["group", "id", "importance", "tokens", "rank", "included"]]

    folded = placed.where("possible AND tokens > 0").drop("possible").groupBy("group").applyInPandas(fold, columns)
    out = placed.where("NOT possible").drop("possible").withColumn("included", F.lit(False))
    return folded.unionByName(out).unionByName(free.drop("possible").withColumn("included", F.lit(True))).drop("rank")


#: What the fit puts into the plan for a file that it leaves out, and the importance of a file of which nothing is known.
UNFIT, UNKNOWN_IMPORTANCE = "does not fit the configured token budget", 1.0


def fit_plan(planned: DataFrame, importance: DataFrame, budget: int, pinned: Column) -> DataFrame:
    """planned with the included files that don't fit the budget excluded (severity info); pinned ones stay whatever they cost.

    planned: project_id, doc_id, rel_path, size, status, reason, severity; importance: doc_id, importance; a file that
    it doesn't hold has UNKNOWN_IMPORTANCE. Pinned files take part in the fit like all others.
    """
    included = planned.where("status = 'included'").join(importance.select("doc_id", F.col("importance").cast("double")), "doc_id", "left")
    candidates = included.select(F.col("project_id").alias("group"), F.col("doc_id").alias("id"), F.coalesce("importance", F.lit(UNKNOWN_IMPORTANCE)).alias("importance"), sizes.token_estimate(F.col("size")).alias("tokens"))
    unfit = budget_fit(candidates, budget).where("NOT included").select(F.col("id").alias("doc_id"), F.lit(True).alias("_unfit"))
    rows = planned.join(unfit, "doc_id", "left")
    out = F.coalesce("_unfit", F.lit(False)) & ~pinned
    return rows.select(*(F.when(out, F.lit(v)).otherwise(F.col(c)).alias(c) if (v := {"status": "excluded", "reason": UNFIT, "severity": "info"}.get(c)) else F.col(c) for c in planned.columns))


def planned_parts(entries: DataFrame, target: int, hooks: Sequence[Callable[[DataFrame], None]] = ()) -> DataFrame:
    """archive_parts, cut, with each of hooks told of the plan (archive, part, group, files, bytes) before anything is written."""
    placed = cut_table(archive_parts(entries, target))
    for hook in hooks:
        hook(placed.groupBy("archive", "part").agg(F.min("group").alias("group"), F.count("*").alias("files"), F.sum("size").alias("bytes")))
    return placed


def oversized(entries: DataFrame, written: DataFrame, limit: int) -> DataFrame:
    """archive, part, bytes, entries, largest, replan: parts whose written file is larger than limit. A part of several entries is planned anew; one entry can't be helped.

    entries: archive, part, size of what was packed; written: archive, part, bytes.
    """
    held = entries.groupBy("archive", "part").agg(F.count("*").alias("entries"), F.max("size").alias("largest"))
    late = written.where(F.col("bytes") > limit).join(held, ["archive", "part"])
    return late.select("archive", "part", "bytes", "entries", "largest", (F.col("entries") > 1).alias("replan"))


def replanned_target(target: int, limit: int, bytes_: int) -> int:
    """A smaller target for parts that came out larger than limit: less by what they were too large."""
    return max(1, int(target * limit / bytes_ * 0.95)) if bytes_ > limit else target


def part_target(limit: int) -> int:
    return min(PART_TARGET, max(1, max(1, limit) - PART_RESERVE))


def cut_sizes(sizes: np.ndarray, target: int, state: tuple[int, int, bool, bool]) -> tuple[np.ndarray, tuple[int, int, bool, bool]]:
    """The part of each size, and the state after the last: part, what it holds, whether it is closed, whether it is the first and empty.

    Cut by cut, not size by size: a part goes as far as the running sum allows, or to the first size of at least target.
    """
    part, held, full, fresh = state
    upto = np.concatenate([[0], np.cumsum(sizes)])
    large = np.flatnonzero(sizes >= target)
    out, i = np.empty(len(sizes), dtype=np.int32), 0
    while i < len(sizes):
        if not fresh and (full or held + sizes[i] > target):
            part, held = part + 1, 0
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + target - held, side="right")) - 1)
        k = np.searchsorted(large, i)
        if k < len(large) and large[k] < j:
            j = int(large[k]) + 1
        out[i:j] = part
        held, full, fresh, i = held + int(upto[j] - upto[i]), bool(sizes[j - 1] >= target), False, j
    return out, (part, held, full, fresh)


def archive_parts(entries: DataFrame, target: int) -> DataFrame:
    """entries with part: each group's files in path order, cut where the next would pass target; a file of at least target ends its part.

    entries: archive, group, path, size. Groups never share a part. Where a part ends depends on all before it, so the
    files of a group of one archive are gone through in order, in a stream: only the running size is held, and only
    path and size are moved.
    """
    rows = entries.select("archive", "group", "path", F.col("size").cast("long"), F.lower("path").alias("_key"))
    ordered = rows.repartition("archive", "group").sortWithinPartitions("archive", "group", "_key", "path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (1, 0, False, True)
        for batch in batches:
            if not batch.num_rows:
                continue
            archive, group = batch.column(0), batch.column(1)
            sizes, out = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), np.empty(batch.num_rows, dtype=np.int32)
            differs = [pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False) for c in (archive, group)]
            starts = [0, *(np.flatnonzero(differs[0] | differs[1]) + 1).tolist()]
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                this = (archive[begin].as_py(), group[begin].as_py())
                out[begin:end], state = cut_sizes(sizes[begin:end], target, state if this == key else (1, 0, False, True))
                key = this
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["archive", "group", "path", "size", "group_part"])

    kinds = dict(rows.dtypes)
    cut_rows = arrow_map(ordered.select("archive", "group", "path", "size"), cut, f"archive {kinds['archive']}, group string, path string, size bigint, group_part int")
    # Parts are numbered through the groups of an archive: how many the groups before have.
    counts = cut_rows.groupBy("archive", "group").agg(F.max("group_part").alias("n"))
    before = Window.partitionBy("archive").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("archive", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = cut_rows.join(offsets, ["archive", "group"])
    return out.select("archive", "group", "path", "size", (F.col("offset") + F.col("group_part")).cast("long").alias("part"))
