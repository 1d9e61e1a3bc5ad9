"""What changed between consecutive full snapshots.

Every file key of a series (one branch of one project) has an ordinal that it keeps for good: a block, drawn by a hash
of the key, and its number there, in the order in which the keys of the block were first seen. A table of ordinals is
kept between runs and only ever extended. A snapshot's presence is a compressed bitmap over ordinals: 64 neighbouring
ones are a word, and words without a file aren't stored. The words of consecutive snapshots are compared with
AND-NOT: additions are cur & ~prev, removals prev & ~cur. Digest, size and line count are kept as vectors in the
order of the ordinals; the rank of a bit (the set bits below it) is its place in the vector, which shows the changes
among the common keys.

One shuffle carries the rows: by series and block. All later steps (removal of repeated rows, ordinals, words, the
step to the snapshot before) need no other, and a series is spread over as many blocks as the rows that were counted
in its snapshots ask for, so neither many files nor many snapshots of one branch are one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import bucketed_positions, cut, join_counted, kept, only_one, small

#: Rows of a series that share a block, about, when the series is first seen.
BLOCK_ROWS = 32_768
#: Seconds of created_at that are numbered together (see bucketed_positions).
ORDER_WIDTH = 30 * 86_400
_ORDINALS = "project_id bigint, branch string, blocks int, block int, key string, ordinal bigint"


def path_key(path: Column) -> Column:
    """Lower case, `/` only, without a leading `./`."""
    plain = F.translate(F.lower(path), "\\", "/")
    return F.when(plain.startswith("./"), F.substring(plain, 3, 1 << 30)).otherwise(plain)


def digest_value(digest: Column) -> Column:
    """The digest's bytes however they are spelled (case, blanks, an algorithm's name before `:`); null if unknown."""
    plain = F.trim(F.substring_index(digest, ":", -1))
    return F.when(plain != "", F.coalesce(F.unhex(plain), F.lower(plain).cast("binary")))


def complete_headers(headers: DataFrame, files: DataFrame) -> DataFrame:
    """One row per complete snapshot, with its series, its place in it, its files and the id of the next complete one.

    files: snapshot_id, key. A snapshot is complete if it has at least file_count distinct files. Repeated headers
    count once (the smallest row stands for an id); headers without id, project, branch, time or count are left out.
    """
    known = headers.select("id", "project_id", "branch", "created_at", "file_count").dropna()
    known = known.groupBy("id").agg(F.min(F.struct("project_id", "branch", "created_at", "file_count")).alias("h")).select("id", "h.*")
    # 96 bits of each key: two different paths of one snapshot don't meet in both hashes.
    keyed = files.select("snapshot_id", F.xxhash64("key").alias("a"), F.hash("key").alias("b")).distinct()
    counted = keyed.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    whole = known.join(counted, known["id"] == counted["snapshot_id"], "left").where(F.coalesce("n", F.lit(0)) >= F.col("file_count"))
    series = ["project_id", "branch"]
    placed = bucketed_positions(whole.select(*series, "created_at", "id", F.coalesce("n", F.lit(0)).alias("n")), series, "created_at", ORDER_WIDTH)
    first = placed.groupBy(*series).agg(F.min("id").alias("series"), F.sum("n").alias("rows"))
    placed = placed.join(first.withColumnsRenamed({c: f"_{c}" for c in series}), [F.col(c) == F.col(f"_{c}") for c in series])
    cur = placed.select("series", *series, "pos", "id", "n", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
    after = placed.select(F.col("series").alias("_s"), (F.col("pos") - 1).alias("_p"), F.col("id").alias("next_id"))
    return cur.join(after, (cur["series"] == after["_s"]) & (cur["pos"] == after["_p"]), "left").drop("_s", "_p")


_BLOCK = ["series", "block"]


def _numbered(rows: DataFrame, bases: DataFrame | None) -> DataFrame:
    """rows (series, block, key, first, had) with ordinal: had where a key has one, else the next of its block, in the order of first and key.

    bases: series, block, base, the first free number of each block; None if no key has a number yet.
    """
    if bases is None:
        return rows.withColumn("ordinal", (F.dense_rank().over(Window.partitionBy(*_BLOCK).orderBy("first", "key")) - 1).cast("long"))
    rank = F.dense_rank().over(Window.partitionBy(*_BLOCK, F.col("had").isNull()).orderBy("first", "key")) - 1
    rows = rows.withColumn("rank", rank).join(bases, _BLOCK, "left")
    return rows.withColumn("ordinal", F.coalesce("had", F.coalesce("base", F.lit(0)) + F.col("rank")).cast("long")).drop("rank", "base")


def snapshot_changes(headers: DataFrame, files: DataFrame, path: str | None = None) -> DataFrame:
    """snapshot_id, rel_path, change: files added, removed or changed from each complete snapshot to the next.

    headers: id, project_id, branch, created_at, file_count. files: snapshot_id, rel_path, sha256, size_bytes, loc.
    Other columns are ignored. Rows without snapshot or path are left out; an empty digest or a null is unknown and
    differs from nothing; of repeated rows of one file the known values count (the largest where they disagree).
    Empty tables give no rows. The first complete snapshot of a series has no changes. path: where the ordinals of
    keys are kept between runs.
    """
    rows = files.select(
        "snapshot_id", path_key(F.col("rel_path")).alias("key"), digest_value(F.col("sha256")).alias("digest"), F.col("size_bytes").alias("bytes"), F.col("loc").alias("lines")
    ).where(F.col("snapshot_id").isNotNull() & F.col("key").isNotNull())
    head = cut(complete_headers(headers, rows.select("snapshot_id", "key")))
    if path is None:
        return _changes(rows, head, None)
    with only_one(files.sparkSession, path) as mine:
        # A run that finds another one at the ordinals numbers the keys for itself alone.
        return _changes(rows, head, path if mine else None)


def _changes(rows: DataFrame, head: DataFrame, path: str | None) -> DataFrame:
    block = _BLOCK
    known = kept(rows.sparkSession, path, _ORDINALS) if path else None
    bases = None
    if known is not None:
        # A series keeps the number of blocks that it was given when it was first seen.
        given = known.groupBy("project_id", "branch").agg(F.max("blocks").alias("given"))
        head = cut(head.join(given, ["project_id", "branch"], "left").withColumn("blocks", F.coalesce("given", "blocks")).drop("given"))
        names = small(head.groupBy("series").agg(F.first("project_id").alias("project_id"), F.first("branch").alias("branch"), F.max("blocks").alias("blocks")))
        known = known.drop("blocks").join(names.drop("blocks"), ["project_id", "branch"]).select(*_BLOCK, "key", F.col("ordinal").alias("had"))
    placed = join_counted(rows, head.select("series", "pos", "next_id", "blocks", "n", "id", F.col("id").alias("snapshot_id")), ["snapshot_id"], "n")
    placed = placed.withColumn("block", F.expr("pmod(xxhash64(key), blocks)").cast("int")).drop("blocks", "snapshot_id").withColumn("had", F.lit(None).cast("long"))
    if known is not None:
        if not known.isEmpty():
            # Keys that are known come along as rows without a place, so no join is needed to find their ordinals.
            placed = placed.unionByName(known, allowMissingColumns=True)
            bases = small(cut(known.groupBy(*_BLOCK).agg((F.max("had") + 1).alias("base"))))
        ever = placed.groupBy(*_BLOCK, "key").agg(F.min("pos").alias("first"), F.max("had").alias("had"))
        added = _numbered(ever, bases).where("had IS NULL").join(names, "series")
        # What is numbered below reads the ordinals as they were before this, and so agrees.
        added.select("project_id", "branch", "blocks", "block", "key", "ordinal").write.mode("append").parquet(path)
    once = placed.repartition(*_BLOCK).groupBy(*_BLOCK, "key", "pos").agg(*(F.max(c).alias(c) for c in ("id", "next_id", "digest", "bytes", "lines", "had")))
    by_key = Window.partitionBy(*_BLOCK, "key")
    seen = once.withColumns({"first": F.min("pos").over(by_key), "had": F.max("had").over(by_key)})
    numbered = _numbered(seen, bases).where("pos IS NOT NULL").drop("first", "had")

    bit = (F.col("ordinal") % 64).cast("int")
    numbered = numbered.withColumn("word", F.floor(F.col("ordinal") / 64).cast("int")).withColumn("bit", bit)
    words = numbered.groupBy(*block, "word", "pos").agg(
        F.max("id").alias("id"),
        F.max("next_id").alias("next_id"),
        F.expr("bit_or(shiftleft(1L, bit))").alias("present"),
        F.sort_array(F.collect_list(F.struct("bit", "key", "digest", "bytes", "lines"))).alias("vector"),
    )
    step = Window.partitionBy(*block, "word").orderBy("pos")
    near = words.withColumns({
        "prev": F.when(F.lag("pos").over(step) == F.col("pos") - 1, F.lag("present").over(step)).otherwise(F.lit(0)),
        "prev_vector": F.when(F.lag("pos").over(step) == F.col("pos") - 1, F.lag("vector").over(step)),
        "next": F.when(F.lead("pos").over(step) == F.col("pos") + 1, F.lead("present").over(step)).otherwise(F.lit(0)),
    })
    both = near.withColumns({
        "added": F.when(F.col("pos") > 0, F.col("present").bitwiseAND(F.bitwise_not("prev"))).otherwise(F.lit(0)),
        "removed": F.when(F.col("next_id").isNotNull(), F.col("present").bitwiseAND(F.bitwise_not("next"))).otherwise(F.lit(0)),
        "common": F.col("present").bitwiseAND(F.col("prev")),
    })
    # A word that is whole in both neighbours and has the same vector needs no look at its bits.
    both = both.where((F.col("added") != 0) | (F.col("removed") != 0) | (F.col("vector") != F.col("prev_vector")))
    found = F.expr("""
        flatten(transform(vector, e -> filter(array(
          if(added & shiftleft(1L, e.bit) != 0, struct(id as snapshot_id, e.key as rel_path, 'added' as change), null),
          if(removed & shiftleft(1L, e.bit) != 0, struct(next_id as snapshot_id, e.key as rel_path, 'removed' as change), null),
          if(common & shiftleft(1L, e.bit) != 0
             and exists(array(prev_vector[bit_count(prev & ~shiftleft(-1L, e.bit))]),
                        p -> coalesce(p.digest <> e.digest, false) or coalesce(p.bytes <> e.bytes, false) or coalesce(p.lines <> e.lines, false)),
             struct(id as snapshot_id, e.key as rel_path, 'changed' as change), null)
        ), x -> x is not null)))""")
    return both.select(F.explode(found).alias("c")).select("c.*")
