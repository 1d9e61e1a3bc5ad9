"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

A container limits tokens, segments and loss-bearing tokens at once. Items fall into classes of like size and like
share of loss; the container in hand takes, again and again, from the class whose demand has the largest dot product
with what room is left (both relative to the limits), as long as anything fits. Only what alone exceeds the capacity
is split: into full containers and one rest, which is an item like any other.

Loss-bearing tokens of a document are those after its prompt; pieces after the first bear loss alone, so they are cut
at the loss limit. Every piece therefore fits a container by each limit, and no container passes any.

Items are packed in groups that hold some hundreds of containers each, drawn by a hash of the id, so no group grows
with the corpus. The containers that a group could fill only badly are given up and their items packed once more,
with those of other groups, as long as this makes fewer of them. No level has a group larger than the first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.runtime import cut, ship, small

#: Containers that a group of items fills, about.
GROUP_CONTAINERS = 256
#: Containers that are filled less than this are given up and packed again...
WELL_FILLED = 0.97
#: ... at most so often, and only while each level leaves at most this share of the badly filled ones before it.
LEVELS, WON = 5, 0.8
#: A segment of a container's limit has so many tokens, and this share of its tokens may bear loss.
PER_SEGMENT, LOSS_SHARE = 16, 0.995
#: Rows that a table of capacities may have: it is a parameter, held by the driver.
MOST_CAPACITIES = 1000


@dataclass(frozen=True)
class Limits:
    """What a container holds at most."""

    tokens: int
    segments: int
    loss: int

    @staticmethod
    def of(capacity: int, per_segment: int = PER_SEGMENT, loss_share: float = LOSS_SHARE) -> Limits:
        return Limits(capacity, max(1, capacity // per_segment), max(1, int(capacity * loss_share)))


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The container (from 0) of each item; an item that no container holds alone is an error."""
    n = len(tokens)
    if n and (tokens.max() > limits.tokens or loss.max() > limits.loss):
        raise ValueError("an item exceeds the capacity of a container")
    out = np.full(n, -1, dtype=np.int64)
    if n == 0:
        return out
    # Classes: sizes in steps of a power of two divided by 16, and the share of loss in eighths.
    size_class = np.zeros(n, dtype=np.int64)
    positive = tokens > 0
    size_class[positive] = 1 + np.floor(16 * np.log2(tokens[positive])).astype(np.int64)
    share = np.where(positive, np.minimum(7, (8 * loss / np.maximum(tokens, 1)).astype(np.int64)), 0)
    order = np.lexsort((np.arange(n), -tokens, -share, -size_class))
    keys = (size_class * 8 + share)[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], n]
    head = starts.copy()
    # Within a class the largest item comes first; what is judged is the next item of each class.
    t = tokens[order].astype(np.float64)
    lo = loss[order].astype(np.float64)
    next_t, next_l = t[head].copy(), lo[head].copy()
    alive = np.ones(len(starts), dtype=bool)
    container, placed = 0, 0
    unit = np.array([1.0 / limits.tokens, 1.0 / limits.segments, 1.0 / limits.loss])
    while placed < n:
        room_t, room_s, room_l = float(limits.tokens), float(limits.segments), float(limits.loss)
        while True:
            fits = alive & (next_t <= room_t) & (next_l <= room_l)
            if room_s < 1 or not fits.any():
                break
            gain = next_t * (room_t * unit[0] * unit[0]) + room_s * unit[1] * unit[1] + next_l * (room_l * unit[2] * unit[2])
            k = int(np.argmax(np.where(fits, gain, -1.0)))
            out[order[head[k]]] = container
            room_t, room_s, room_l = room_t - next_t[k], room_s - 1, room_l - next_l[k]
            head[k] += 1
            placed += 1
            if head[k] == ends[k]:
                alive[k] = False
            else:
                next_t[k], next_l[k] = t[head[k]], lo[head[k]]
        container += 1
    return out


def _pieces(sized: DataFrame, capacities: list[tuple[str, Limits]]) -> DataFrame:
    """container, doc_id, piece, tokens, loss_tokens, full: documents cut where they alone exceed the capacity."""
    kinds = F.array(*(F.struct(F.lit(name).alias("container"), F.lit(c.tokens).cast("long").alias("c"), F.lit(c.loss).cast("long").alias("l")) for name, c in capacities))
    both = sized.withColumn("k", F.explode(kinds)).select("doc_id", "size", (F.col("size") - F.col("loss")).alias("prompt"), "k.*")
    # Whole containers of prompt, then one with the prompt's end, then pieces that bear loss alone.
    before = F.floor(F.col("prompt") / F.col("c"))
    both = both.withColumn("a", before).withColumn("p", F.col("prompt") - F.col("a") * F.col("c"))
    both = both.withColumn("mixed", F.least("c", F.col("p") + F.col("l"), F.col("size") - F.col("a") * F.col("c")))
    both = both.withColumn("rest", F.col("size") - F.col("a") * F.col("c") - F.col("mixed"))
    both = both.withColumn("a", F.when((F.col("mixed") == 0) & (F.col("a") > 0), F.col("a") - 1).otherwise(F.col("a")))
    both = both.withColumn("mixed", F.when(F.col("p") + F.col("rest") + F.col("mixed") == 0, F.least("c", "size")).otherwise(F.col("mixed")))
    cutted = both.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("a") + F.ceil(F.col("rest") / F.col("l"))).cast("int"))))
    after = F.col("piece") - F.col("a")
    tokens = F.when(after < 0, F.col("c")).when(after == 0, F.col("mixed")).otherwise(F.least("l", F.col("rest") - (after - 1) * F.col("l")))
    loss = F.when(after < 0, F.lit(0)).when(after == 0, F.greatest(F.lit(0), F.least(F.col("mixed") - F.col("p"), F.col("size") - F.col("prompt")))).otherwise(F.col("tokens"))
    out = cutted.withColumn("tokens", tokens.cast("long")).withColumn("loss_tokens", loss.cast("long"))
    return out.select("container", "doc_id", "piece", "tokens", "loss_tokens", ((F.col("tokens") >= F.col("c")) | (F.col("loss_tokens") >= F.col("l"))).alias("full"))


def _group_packer(level: int, capacities: dict[str, Limits]):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        limits = capacities[frame["container"].iloc[0]]
        tokens, loss = frame["tokens"].to_numpy(), frame["loss_tokens"].to_numpy()
        bins = pack(tokens, loss, limits)
        most = bins.max() + 1
        # Filled by the limit that it comes nearest to: no more room can be used than that one leaves.
        filled = np.maximum(np.bincount(bins, weights=tokens, minlength=most) / limits.tokens, np.bincount(bins, minlength=most) / limits.segments)
        filled = np.maximum(filled, np.bincount(bins, weights=loss, minlength=most) / limits.loss)
        frame["bin"] = [f"{level}.{frame['group'].iloc[0]}.{b}" for b in bins]
        frame["again"] = filled[bins] < WELL_FILLED
        return frame[["container", "bin", "doc_id", "piece", "tokens", "loss_tokens", "again"]]

    return one


def _groups(rest: DataFrame, capacities: dict[str, Limits]) -> tuple[dict[str, int], int]:
    """How many groups the items of each container take, of GROUP_CONTAINERS containers each, and all items."""
    sums = {r[0]: r[1:] for r in rest.groupBy("container").agg(F.sum("tokens"), F.sum("loss_tokens"), F.count("*")).collect()}
    need = {name: max(t / capacities[name].tokens, l / capacities[name].loss, n / capacities[name].segments) for name, (t, l, n) in sums.items()}
    return {name: max(1, math.ceil(x / GROUP_CONTAINERS)) for name, x in need.items()}, sum(x[2] for x in sums.values())


def packed(sized: DataFrame, capacities: DataFrame, per_segment: int = PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """container, bin, doc_id, piece, tokens, loss_tokens: where each document goes, for each capacity.

    sized: doc_id, tokens, loss_tokens, one row per document; of a document's tokens at most loss_share count as loss
    bearing, so no document within the capacity passes the loss limit. capacities: container, capacity_tokens (a
    parameter of at most MOST_CAPACITIES rows, else an error; nulls and capacities under 1 are left out). bin is
    unique within a container. Documents of 0 tokens take a segment. Empty tables give no rows.
    """
    spark = sized.sparkSession
    ship(spark)
    known = capacities.select("container", F.col("capacity_tokens").cast("int").alias("c")).where("container IS NOT NULL AND c >= 1").groupBy("container").agg(F.max("c").alias("c")).limit(MOST_CAPACITIES + 1).collect()
    if len(known) > MOST_CAPACITIES:
        raise ValueError("too many capacities")
    limits = {r[0]: Limits.of(r[1], per_segment, loss_share) for r in sorted(known)}
    schema = "container string, bin string, doc_id bigint, piece int, tokens bigint, loss_tokens bigint"
    if not limits:
        return spark.createDataFrame([], schema)
    size = F.col("tokens").cast("long")
    loss = F.least(F.col("loss_tokens").cast("long"), F.floor(size * F.lit(loss_share)))
    pieces = cut(_pieces(sized.select("doc_id", size.alias("size"), loss.alias("loss")), list(limits.items())))
    alone = pieces.where("full").select("container", F.concat(F.lit("w"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("bin"), "doc_id", "piece", "tokens", "loss_tokens")
    rest, done = pieces.where("NOT full").drop("full"), [alone]
    counts, before = _groups(rest, limits)
    for level in range(LEVELS):
        if not counts:
            break
        groups = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
        keyed = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece"), F.try_element_at(groups, F.col("container"))).cast("int"))
        result = cut(keyed.groupBy("container", "group").applyInPandas(_group_packer(level, limits), schema + ", again boolean"))
        rest = result.where("again").select("container", "doc_id", "piece", "tokens", "loss_tokens")
        next_counts, left = _groups(rest, limits)
        # One group has all the choice there is; where a level won little, another one would win less.
        end = level == LEVELS - 1 or left > WON * before or max(counts.values()) <= 1
        done.append(result.select(*alone.columns) if end else result.where("NOT again").select(*alone.columns))
        if end:
            break
        counts, before = next_counts, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """container, bins, documents, split_documents, tokens, unused_share of an assignment by packed."""
    by_doc = assigned.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    docs = by_doc.groupBy("container").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") > 1).alias("split_documents"), F.sum("tokens").alias("tokens"))
    bins = assigned.groupBy("container").agg(F.countDistinct("bin").alias("bins"))
    caps = capacities.groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    out = docs.join(bins, "container").join(small(caps), "container")
    unused = 1 - F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))
    return out.select("container", "bins", "documents", "split_documents", "tokens", F.round(unused, 6).alias("unused_share"))
