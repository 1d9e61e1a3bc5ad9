"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the mix goes to the source whose stretch of the cumulative weights holds the k-th golden-ratio point, so
every prefix of the mix is near its weights. The records of a source stand in a drawn order and are cut into blocks
of equally many tokens; the j-th slot of a source takes its j-th block. A source that is too small for its share is
gone through again, at most max_repeats times, and the mix is as long as the scarcest source allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import bucketed_positions, cut, small

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: A block has at most so many tokens, and the mix at least so many slots (unless its blocks would be under a token).
BLOCK_TOKENS, SLOTS = 65_536, 16_384
#: Records of a source that are put in order together: those whose draws share the upper bits.
DRAW_BITS = 12
#: Rows that a table of targets may have: it is a parameter, held by the driver.
MOST_TARGETS = 1000


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed lower case with `_` for blanks and `-`."""
    return F.translate(F.lower(F.trim(source)), "- ", "__")


def _targets(targets: DataFrame) -> DataFrame:
    known = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    known = known.where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share)")
    return known.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).where("max_repeats >= 1")


def _in_order(records: DataFrame, seed: int) -> DataFrame:
    """records with start: the tokens of its source's records that were drawn before it (two-level prefix sums)."""
    drawn = records.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.expr(f"shiftright(draw, {64 - DRAW_BITS})").cast("int"))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inner", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    # The records lie by source and bucket already, so they aren't moved again.
    out = placed.join(starts.hint("merge"), (placed["source"] == starts["_s"]) & (placed["bucket"] == starts["_b"]))
    return out.select("doc_id", "source", "tokens", (F.col("offset") + F.col("inner")).alias("start"))


class Mix:
    """The plan of a mix. documents: doc_id, source, tokens (one row each); targets: source, target_share, max_repeats.

    Records without id, of an unknown source or of 0 tokens aren't used. Sources of a target without records are left
    out and the other shares scaled up; shares() reports both. total: tokens of the mix; by default as many as the
    scarcest source allows. Empty tables give an empty mix.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17):
        spark = documents.sparkSession
        self.targets = small(cut(_targets(targets)))
        records = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("long")).where("doc_id IS NOT NULL AND tokens > 0")
        self.records = cut(records.join(small(self.targets.select("source")), "source", "left_semi"))
        sizes = self.records.groupBy("source").agg(F.sum("tokens").alias("n"))
        rows = self.targets.join(sizes, "source").orderBy("source").limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError("too many targets")
        weight = sum(r["target_share"] for r in rows) or 1.0
        self.weights = {r["source"]: r["target_share"] / weight for r in rows}
        room = {r["source"]: r["n"] * r["max_repeats"] for r in rows}
        self.total = int(min((room[s] / w for s, w in self.weights.items()), default=0))
        self.total = min(self.total, total) if total else self.total
        self.block = max(1, min(BLOCK_TOKENS, self.total // SLOTS))
        self.slots = self._slots(spark, self.total // self.block)
        self.placed = _in_order(self.records, seed)

    def _slots(self, spark, count: int) -> DataFrame:
        """slot, source, block: the golden-ratio schedule, with the rank of each slot among those of its source."""
        point = F.col("id") * F.lit(GOLDEN) + F.lit(0.5)
        point = point - F.floor(point)
        source, at = F.lit(None).cast("string"), 1.0
        for name, w in reversed(list(self.weights.items())):
            source, at = F.when(point < F.lit(at + (1e-9 if at == 1.0 else 0.0)), F.lit(name)).otherwise(source), at - w
        # Built from the last source on, so the first stretch that holds the point wins.
        slots = spark.range(count).select(F.col("id").alias("slot"), source.alias("source"))
        return bucketed_positions(slots, ["source"], "slot", 1 << 18, "block")

    def uses(self) -> DataFrame:
        """slot, source, doc_id, copy, tokens: every use of a record, in the slot that takes its block."""
        sizes = self.placed.groupBy("source").agg(F.sum("tokens").alias("whole"))
        limits = self.targets.select("source", "max_repeats").join(sizes, "source")
        last = self.slots.groupBy("source").agg(F.max("block").alias("last_block"))
        limits = small(cut(limits.join(last, "source")))
        need = (F.col("last_block") + 1) * F.lit(self.block)
        copies = self.placed.join(limits, "source")
        # Copies that start before what the source's slots take; those are the first ones.
        many = F.least(F.col("max_repeats").cast("long"), F.ceil((need - F.col("start")) / F.col("whole")).cast("long"))
        copies = copies.withColumn("many", many).where("many > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
        block = F.floor((F.col("start") + (F.col("copy") - 1) * F.col("whole")) / F.lit(self.block))
        blocks = copies.select("source", "doc_id", "tokens", F.col("copy").cast("int").alias("copy"), block.alias("block"))
        return blocks.join(self.slots.hint("shuffle_hash"), ["source", "block"]).select("slot", "source", "doc_id", "copy", "tokens")

    def chosen(self) -> DataFrame:
        """doc_id, source, repeats, tokens: the chosen records and how often each is used."""
        return self.uses().groupBy("doc_id", "source").agg(F.count("*").alias("repeats"), F.max("tokens").alias("tokens"))

    def shares(self) -> DataFrame:
        """source, target_share, reached_share, tokens, records, most_repeats, for every target."""
        by = self.chosen().groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats"))
        out = self.targets.select("source", "target_share").join(by, "source", "left")
        filled = out.select("source", "target_share", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "most_repeats")))
        all_ = F.sum("tokens").over(Window.partitionBy())
        return filled.select("source", "target_share", F.round(F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0), 6).alias("reached_share"), "tokens", "records", "most_repeats")
