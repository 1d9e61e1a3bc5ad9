"""Schemas that drift between files: every change of a field from one revision to the next, and one unified table.

1. Each file is parsed once to its fields (path, type, digest of the value).
2. Revisions of one installation are paired with the readable one before, in one pass over buckets of revision
   numbers; only the first and last of a bucket are paired by a join, so an installation with a third of all files
   isn't one task.
3. Names are profiled over the whole corpus: how often each appears and vanishes, its types, and a sketch of the
   values that it had when it appeared or vanished (the least hash in each of SKETCH buckets). A value that few names
   ever held weighs much: each shared hash counts one over how many other names hold it.
4. Two names are one setting if most appearances of the rarer one are swaps for the other, and their names are alike
   or their sketches share enough. A bipartite matching per revision pairs vanished with new fields of one meaning
   and value. The rest is added or removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.settings import assign, canonical, digest, fields, parse, similarity
from cairn.runtime import arrow_map, cut, small

#: Revision numbers of one installation that are put in order together.
REVISION_WIDTH = 256
#: Buckets of a value sketch, of which the least hash of each is kept.
SKETCH = 128
#: Two names are one setting if this share of the appearances of the rarer one are swaps for the other...
CONFIDENCE = 0.5
#: ... and their names are this similar, or the hashes their sketches share weigh so much.
NAMES_ALIKE, VALUES_ALIKE = 0.3, 0.6

_FIELD = "struct<path:string,type:string,digest:string,value:string>"
_FILE = pa.schema([
    ("install_id", pa.int64()), ("revision", pa.int64()), ("version", pa.string()),
    ("fields", pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("value", pa.string())]))),
])


def _reader(values: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for install, revision, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    found = {p: (t, d, v if values else None) for p, t, d, v in fields(parse(content))}
                    version = digest("".join(p + "\0" + t + d for p, (t, d, _) in sorted(found.items())))
                    for p in found:
                        p.encode()
                except (ValueError, RecursionError):
                    continue
                out.append({"install_id": install, "revision": revision, "version": version, "fields": [{"path": p, "type": t, "digest": d, "value": v} for p, (t, d, v) in sorted(found.items())]})
            yield pa.RecordBatch.from_pylist(out, schema=_FILE)

    return read


def _bucket() -> Column:
    return F.floor(F.col("revision") / REVISION_WIDTH).cast("long")


def readable_revisions(files: DataFrame, values: bool = False) -> DataFrame:
    """install_id, revision, bucket, fields of each readable revision, once, lying by installation and bucket.

    files: install_id, revision, content; other columns are ignored. Rows without installation or revision and
    contents that aren't JSON as a whole are passed over. Of deliveries that differ, the one with the least digest
    counts. values: whether fields carry their values as text.
    """
    known = files.select(F.col("install_id").cast("long"), F.col("revision").cast("long"), "content").dropna()
    read = arrow_map(known, _reader(values), f"install_id bigint, revision bigint, version string, fields array<{_FIELD}>")
    read = read.withColumn("bucket", _bucket()).repartition("install_id", "bucket")
    return read.groupBy("install_id", "bucket", "revision").agg(F.min_by("fields", "version").alias("fields"))


_KEY = ["install_id", "revision"]


def _differences(pairs: DataFrame) -> DataFrame:
    """install_id, revision, gone, new, retyped: arrays of fields, of pairs (before, fields) that differ in fields or types."""
    typed = lambda c: F.transform(c, lambda f: F.struct(f["path"], f["type"]))
    rows = pairs.where(typed(F.col("before")) != typed(F.col("fields")))
    rows = rows.withColumns({"old": F.expr("transform(before, f -> f.path)"), "cur": F.expr("transform(fields, f -> f.path)"), "types": F.expr("map_from_entries(transform(before, f -> struct(f.path, f.type)))")})
    retyped = F.expr("transform(filter(fields, f -> coalesce(types[f.path] <> f.type and types[f.path] <> 'null' and f.type <> 'null', false)), f -> f.path)")
    out = rows.select(*_KEY, F.expr("filter(before, f -> not array_contains(cur, f.path))").alias("gone"), F.expr("filter(fields, f -> not array_contains(old, f.path))").alias("new"), retyped.alias("retyped"))
    return out.where((F.size("gone") > 0) | (F.size("new") > 0) | (F.size("retyped") > 0))


def paired(revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The revisions, cut, and their differences: install_id, revision, gone, new, retyped. First revisions have none.

    revisions: readable_revisions. One pass over the buckets pairs all but the first of each, which then meets the
    last of the nearest bucket before; of these only what lies at an edge of its bucket is moved.
    """
    step = Window.partitionBy("install_id", "bucket").orderBy("revision")
    near = revisions.withColumns({"before": F.lag("fields").over(step), "is_last": F.lead("revision").over(step).isNull()})
    near = cut(near.withColumn("is_first", F.col("before").isNull()).withColumn("before", F.when(F.transform("before", lambda f: F.struct(f["path"], f["type"])) != F.transform("fields", lambda f: F.struct(f["path"], f["type"])), F.col("before"))))
    inside = near.where(F.col("before").isNotNull()).select(*_KEY, "before", "fields")
    edges = near.where("is_first OR is_last").select(*_KEY, "bucket", "is_first", "is_last")
    ends = edges.groupBy("install_id", "bucket").agg(F.min("revision").alias("first"), F.max("revision").alias("last"))
    links = ends.withColumn("last_before", F.lag("last").over(Window.partitionBy("install_id").orderBy("bucket"))).where(F.col("last_before").isNotNull())
    links = links.select(F.col("install_id").alias("i"), "first", "last_before")
    head = near.where("is_first").select(*_KEY, "fields").join(links, (F.col("install_id") == F.col("i")) & (F.col("revision") == F.col("first"))).drop("i", "first")
    tail = near.where("is_last").select(F.col("install_id").alias("i"), F.col("revision").alias("r"), F.col("fields").alias("before"))
    cross = head.join(tail, (F.col("install_id") == F.col("i")) & (F.col("last_before") == F.col("r"))).select(*_KEY, "before", "fields")
    return near.select(*_KEY, "fields"), cut(_differences(inside.unionByName(cross)))


def _similar(a: str, b: str) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64"), "double")(a, b)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("digest")).withColumn("bucket", F.pmod("h", F.lit(SKETCH)))


def profiles(revisions: DataFrame) -> DataFrame:
    """Per path: its canonical name, the files that have it, its types, and the least hash of its values in each of SKETCH buckets."""
    one = _bucketed(revisions.select(F.explode("fields").alias("f")).select("f.path", "f.type", "f.digest"))
    least = one.groupBy("path", "bucket").agg(F.count("*").alias("files"), F.collect_set("type").alias("types"), F.min("h").alias("h"))
    whole = least.groupBy("path").agg(F.sum("files").alias("files"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.collect_list("h").alias("hashes"))
    return cut(cut(whole).withColumn("name", F.pandas_udf(lambda s: s.map(canonical), "string")("path")))


def sketches(diffs: DataFrame, profiled: DataFrame) -> DataFrame:
    """name, sketch: of each name the least hash in each bucket of the values it had when it appeared or vanished.

    Each hash has the weight of one over how many other names hold it, then or at any time, at most 1.
    """
    named = small(profiled.select("path", "name"))
    changed = F.explode(F.transform(F.concat("gone", "new"), lambda f: F.struct(f["path"].alias("path"), f["digest"].alias("digest"))))
    by_path = _bucketed(diffs.select(changed.alias("f")).select("f.*")).groupBy("path", "bucket").agg(F.min("h").alias("h"))
    least = by_path.join(named, "path").groupBy("name", "bucket").agg(F.min("h").alias("h")).select("name", "h")
    ever = profiled.select("name", F.explode("hashes").alias("h")).unionByName(least).distinct()
    holders = ever.groupBy("h").agg(F.count("*").alias("n"))
    weighed = least.join(holders, "h").select("name", F.struct("h", (F.lit(1.0) / F.greatest(F.lit(1), F.col("n") - 1)).alias("w")).alias("x"))
    return weighed.groupBy("name").agg(F.collect_list("x").alias("sketch"))


def name_pairs(diffs: DataFrame, profiled: DataFrame, sketched: DataFrame | None = None) -> DataFrame:
    """a, b, votes, alike, values, forward, backward: names of which a vanished when b appeared with the same value.

    votes: in how many places; forward and backward: which share of b's appearances and of a's vanishings these are;
    alike: likeness of the names; values: the weight of what their sketches share. Only fields of one revision with
    the same value are paired, inside the row.
    """
    named = small(profiled.select("path", "name"))
    sketched = cut(sketches(diffs, profiled)) if sketched is None else sketched
    swaps = diffs.select(F.explode("gone").alias("g"), "new").select("g", F.explode(F.filter("new", lambda n: (n["digest"] == F.col("g.digest")) & (n["type"] == F.col("g.type")))).alias("n"))
    swaps = swaps.groupBy(F.col("g.path").alias("pa"), F.col("n.path").alias("pb")).agg(F.count("*").alias("votes"))
    side = lambda p: named.select(F.col("path").alias(f"p{p}"), F.col("name").alias(p))
    swaps = cut(swaps.join(side("a"), "pa").join(side("b"), "pb").where(F.col("a") != F.col("b")))
    pairs = cut(swaps.withColumn("alike", _similar("pa", "pb")).groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("alike").alias("alike")))

    def events(c: str, name: str) -> DataFrame:
        e = diffs.select(F.explode(F.transform(c, lambda f: f["path"])).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
        return e.join(named, "path").groupBy(F.col("name").alias(name)).agg(F.sum("n").alias(f"{name}_n"))

    sketch = lambda p: sketched.select(F.col("name").alias(p), F.col("sketch").alias(f"sketch_{p}"))
    pairs = pairs.join(events("new", "b"), "b").join(events("gone", "a"), "a").join(sketch("a"), "a", "left").join(sketch("b"), "b", "left")
    shared = F.aggregate(F.array_intersect("sketch_a", "sketch_b"), F.lit(0.0), lambda acc, x: acc + x["w"])
    return pairs.select("a", "b", "votes", "alike", F.coalesce(shared, F.lit(0.0)).alias("values"), (F.col("votes") / F.col("b_n")).alias("forward"), (F.col("votes") / F.col("a_n")).alias("backward"))


def synonyms(pairs: DataFrame, profiled: DataFrame) -> DataFrame:
    """name, base: each canonical name that is another spelling of a base setting, the one in most files."""
    both = pairs.select("a", "b", "votes", "alike", "values", "forward").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes", "alike", "values", F.col("backward").alias("forward"))
    )  # b: the candidate spelling, a: the base; forward: which share of b's own events this swap explains
    both = both.groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("alike").alias("alike"), F.max("values").alias("values"), F.max("forward").alias("forward"))
    strong = (F.col("forward") >= CONFIDENCE) & ((F.col("values") >= VALUES_ALIKE) | (F.col("alike") >= NAMES_ALIKE))
    files = profiled.groupBy("name").agg(F.sum("files").alias("n"))
    base, other = files.select(F.col("name").alias("a"), F.col("n").alias("na")), files.select(F.col("name").alias("b"), F.col("n").alias("nb"))
    rated = both.where(strong).join(base, "a").join(other, "b").where((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    # The same last part first, then the name in most files, evidence, and likeness of values and names.
    leaf = F.substring_index("a", ".", -1) == F.substring_index("b", ".", -1)
    best = F.max_by("a", F.struct(leaf, "na", "votes", "values", "alike", "a"))
    return rated.groupBy(F.col("b").alias("name")).agg(best.alias("base"))


def meanings(profiled: DataFrame, same: DataFrame) -> DataFrame:
    """path, meaning: the base name of the longest known part of the path, outside of a mere container."""
    keyed = profiled.select("path", F.split("name", r"\.").alias("seg"))
    parts = keyed.select("path", "seg", F.explode(F.sequence(F.lit(1), F.size("seg"))).alias("k")).withColumn("part", F.array_join(F.slice("seg", 1, F.col("k")), "."))
    known = same.select(F.col("name").alias("part"), "base")
    found = parts.join(small(known), "part").groupBy("path").agg(F.max_by(F.struct("k", "base"), "k").alias("s"))
    based = keyed.join(found.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left")
    rest = F.expr("slice(seg, s.k + 1, size(seg))")
    named = F.when(F.col("s").isNotNull(), F.concat(F.split("s.base", r"\."), rest)).otherwise(F.col("seg"))
    based = based.select("path", named.alias("seg"))
    # A setting that also stands on its own means the same inside an object that only groups settings.
    alone = profiled.where(~F.col("path").contains(".")).select(F.col("name").alias("head")).distinct()
    out = based.join(small(alone), F.try_element_at("seg", F.lit(2)) == F.col("head"), "left")
    meaning = F.when(F.col("head").isNotNull(), F.slice("seg", 2, F.size("seg"))).otherwise(F.col("seg"))
    # Twice, since a spelling inside an object may have a base of its own.
    out = out.select("path", F.array_join(meaning, ".").alias("m"))
    again = out.join(small(same), F.col("m") == F.col("name"), "left")
    return again.select("path", F.coalesce("base", "m").alias("meaning"))


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for install, revision, edges in zip(frame["install_id"], frame["revision"], frame["edges"]):
            scored = [(e["g"], e["n"], 1.0 + similarity(e["g"], e["n"]) + (0.5 if e["g"].count(".") == e["n"].count(".") else 0.0)) for e in edges]
            out += [(install, revision, a, b) for a, b in assign(scored)]
        yield pd.DataFrame(out, columns=["install_id", "revision", "old_field", "new_field"])


def schema_changes(files: DataFrame) -> DataFrame:
    """install_id, revision, change, old_field, new_field: see the module. files as for readable_revisions.

    renamed: the value is the same and both names mean one setting; added has old_field '', removed new_field '';
    retyped has the path in both. Going to or from null is no change of type. Empty tables give no rows; a field
    whose name has dots of its own is named like a nested one.
    """
    _, diffs, profiled, same = _learnt(files)
    return _changes(diffs, small(cut(meanings(profiled, same))))


def _learnt(files: DataFrame, values: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The revisions, their differences, the profiles of paths, and the synonyms among names."""
    revisions, diffs = paired(readable_revisions(files, values))
    profiled = profiles(revisions)
    return revisions, diffs, profiled, cut(synonyms(name_pairs(diffs, profiled), profiled))


def _changes(diffs: DataFrame, meant: DataFrame) -> DataFrame:
    key = ["install_id", "revision"]

    def side(c: str, p: str) -> DataFrame:
        one = diffs.select(*key, F.explode(c).alias("f")).select(*key, F.col("f.path").alias(p), F.col("f.digest").alias("digest"), F.col("f.type").alias("type"))
        return one.join(meant.select(F.col("path").alias("_p"), "meaning"), F.col(p) == F.col("_p")).drop("_p")

    gone, new = side("gone", "g"), side("new", "n")
    edges = gone.join(new, [*key, "digest", "type", "meaning"]).groupBy(*key).agg(F.collect_list(F.struct("g", "n")).alias("edges"))
    renamed = edges.mapInPandas(_match, "install_id bigint, revision bigint, old_field string, new_field string")
    named = renamed.groupBy(*key).agg(F.collect_list(F.struct("old_field", "new_field")).alias("renamed"))
    all_ = diffs.join(named, key, "left").withColumn("renamed", F.coalesce("renamed", F.expr("cast(array() as array<struct<old_field:string,new_field:string>>)")))

    changes = F.concat(
        F.expr("transform(renamed, r -> struct('renamed' as change, r.old_field as old_field, r.new_field as new_field))"),
        F.expr("transform(filter(gone, f -> not exists(renamed, r -> r.old_field = f.path)), f -> struct('removed' as change, f.path as old_field, '' as new_field))"),
        F.expr("transform(filter(new, f -> not exists(renamed, r -> r.new_field = f.path)), f -> struct('added' as change, '' as old_field, f.path as new_field))"),
        F.expr("transform(retyped, p -> struct('retyped' as change, p as old_field, p as new_field))"),
    )
    return all_.select(*key, F.explode(changes).alias("c")).select(*key, "c.*")


def _as_type(want: str) -> Column:
    """value as text of the type want, or null if it can't be taken for one without loss."""
    plain = F.regexp_extract("value", r'^"(.*)"$', 1)
    number = plain.rlike(r"^-?(0|[1-9]\d{0,14})(\.\d{1,14})?$") & ~plain.rlike(r"\.\d*0$")
    return (
        F.when(F.col("type") == F.lit(want), F.col("value"))
        .when((F.lit(want) == "string") & F.col("type").isin("number", "boolean"), F.concat(F.lit('"'), F.col("value"), F.lit('"')))
        .when((F.lit(want) == "number") & (F.col("type") == "string") & number, plain)
        .when((F.lit(want) == "boolean") & (F.col("type") == "string") & plain.isin("true", "false"), plain)
        .when((F.lit(want) == "array") & F.col("type").isin("number", "boolean", "string"), F.concat(F.lit("["), F.col("value"), F.lit("]")))
    )


TYPES = ["string", "number", "boolean", "array"]


def unified_settings(files: DataFrame) -> DataFrame:
    """install_id, revision, setting, type, value, conflict: every file's settings under the one name and type of each meaning.

    The name is the most frequent path of the meaning, the type the most frequent one of its values that aren't
    null; all rows of a setting have it. A value of another type is cast if nothing is lost ("5" and 5, true and
    "true", a single value as an array of one), and else is left as it was in conflict, with an empty value; conflict
    is '' elsewhere. A null has the value 'null'. Values are JSON texts. An object's keys are settings of their own, so
    objects have no row. Two paths of one file with one meaning give the value of the path in more files.
    """
    revisions, _, profiled, same = _learnt(files, values=True)
    meant = meanings(profiled, same).join(profiled.select("path", "files"), "path")
    best = meant.groupBy("meaning").agg(F.max_by("path", F.struct("files", "path")).alias("setting"))
    named = small(cut(meant.join(best, "meaning").select("path", "setting", "files")))
    values = revisions.select(*_KEY, F.explode("fields").alias("f")).select(*_KEY, "f.path", "f.type", "f.value").where("type <> 'object'")
    placed = values.join(named, "path").groupBy(*_KEY, "setting").agg(F.max_by(F.struct("type", "value"), F.struct("files", "path")).alias("v")).select(*_KEY, "setting", "v.type", "v.value")
    placed = cut(placed)
    counted = placed.where("type <> 'null'").groupBy("setting", "type").agg(F.count("*").alias("n"))
    types = small(cut(counted.groupBy("setting").agg(F.max_by("type", F.struct("n", "type")).alias("one"))))
    typed = placed.join(types, "setting", "left").withColumn("one", F.coalesce("one", F.lit("string")))
    cast = F.when(F.col("type") == "null", F.lit("null"))
    for want in TYPES:
        cast = cast.when(F.col("one") == want, _as_type(want))
    typed = typed.withColumn("cast", cast)
    return typed.select(*_KEY, "setting", F.col("one").alias("type"), F.coalesce("cast", F.lit("")).alias("value"), F.when(F.col("cast").isNull(), F.col("value")).otherwise(F.lit("")).alias("conflict"))
