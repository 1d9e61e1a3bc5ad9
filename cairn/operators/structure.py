"""What the tree of a project's files tells: directories, their layers and roles, listings, stacks, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths, stacks


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def directories(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, directory: every directory above a file, once. files: project, rel_path."""
    return files.select(F.col(project).alias("project"), F.explode(paths.ancestors(F.col("rel_path"))).alias("directory")).distinct()


def directory_layer(directory: Column) -> Column:
    """The layer of an application that a directory belongs to, by the names of its parts; null if none."""
    own, out = paths.parts(F.lower(directory)), None
    for layer, names in stacks.DIRECTORY_LAYERS.items():
        hit = F.arrays_overlap(own, _literals(names))
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out


def directory_roles(dirs: DataFrame) -> DataFrame:
    """dirs with side (pages, frontend, backend) and role: of the first side one role, of the others every one that is hit."""
    own = paths.parts(F.lower("directory"))
    roles = []
    for side, table in (("pages", stacks.PAGE_ROLES), ("frontend", stacks.FRONTEND_ROLES), ("backend", stacks.BACKEND_ROLES)):
        hits = [F.when(F.arrays_overlap(own, _literals(names)), F.struct(F.lit(side).alias("side"), F.lit(role).alias("role"))) for role, names in table.items()]
        roles += [F.coalesce(*hits)] if side == "pages" else hits
    return dirs.withColumn("r", F.explode(F.array_compact(F.array(*roles)))).select(*dirs.columns, "r.side", "r.role")


def walk_key(path: Column) -> Column:
    """What puts paths in the order of a walk: in each directory its files before its directories, each by upper-case name."""
    own = paths.parts(path)
    return F.transform(own, lambda p, k: F.struct(F.when(k == F.size(own) - 1, 0).otherwise(1).alias("deeper"), F.upper(p).alias("name")))


def listing(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, directory, place, name, is_dir, bytes: what each directory holds, directories first, by lower-case name.

    A name that several rows share is listed once, with the most bytes. The top directory is ''.
    """
    p = paths.parts(F.col("rel_path"))
    held = files.select(F.col(project).alias("project"), paths.parent(F.col("rel_path")).alias("directory"), F.element_at(p, -1).alias("name"), F.lit(False).alias("is_dir"), F.col("size").alias("bytes")).where(F.size(p) > 0)
    above = directories(files, project)
    inner = above.select("project", paths.parent(F.col("directory")).alias("directory"), paths.name(F.col("directory")).alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("bytes"))
    once = held.unionByName(inner).groupBy("project", "directory", "name", "is_dir").agg(F.max("bytes").alias("bytes"))
    order = Window.partitionBy("project", "directory").orderBy(F.col("is_dir").desc(), F.lower("name"), "name")
    return once.withColumn("place", F.row_number().over(order)).select("project", "directory", "place", "name", "is_dir", "bytes")


def directory_status(planned: DataFrame, project: str = "project_id") -> DataFrame:
    """project, directory, status: warning before included before excluded among all files below. planned: rel_path, status, severity."""
    rank = F.when(F.col("severity").isin("critical", "high"), 2).when(F.col("status") == "included", 1).otherwise(0)
    rows = planned.select(F.col(project).alias("project"), F.explode(paths.ancestors(F.col("rel_path"))).alias("directory"), rank.alias("rank"))
    most = rows.groupBy("project", "directory").agg(F.max("rank").alias("rank"))
    return most.select("project", "directory", F.element_at(_literals(["excluded", "included", "warning"]), F.col("rank") + 1).alias("status"))


def _marks(values: dict[str, list[str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), _literals(v)))), key)


def detected_stacks(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, place, stack, markers: the stacks that what lies at a project's root shows, most markers first.

    A stack with required names needs all of them and one more marker. Constant maps, so no join.
    """
    p = paths.parts(F.col("rel_path"))
    root = files.select(F.col(project).alias("project"), F.get(p, F.lit(0)).alias("name"), (F.size(p) == 1).alias("is_file")).where("name IS NOT NULL").distinct()
    names: dict[str, list[str]] = {}
    suffixes: dict[str, list[str]] = {}
    for k, (_, marks, ends, needed, _) in enumerate(stacks.STACKS):
        for m in [*needed, *marks]:
            names.setdefault(m, []).append(f"{k}")
        for m in ends:
            suffixes.setdefault(m[1:], []).append(f"{k}")
    suffix = F.regexp_extract("name", r"^.+\.([^.]*)$", 1)
    by_name = root.select("project", F.col("name").alias("marker"), F.explode(_marks(names, F.col("name"))).alias("k"))
    by_suffix = root.where("is_file").select("project", F.concat(F.lit("*."), suffix).alias("marker"), F.explode(_marks(suffixes, suffix)).alias("k"))
    found = by_name.unionByName(by_suffix).distinct().groupBy("project", F.col("k").cast("int").alias("k")).agg(F.sort_array(F.collect_set("marker")).alias("markers"))
    needed = F.element_at(F.array(*(_literals(s[3]) for s in stacks.STACKS)), F.col("k") + 1)
    whole = found.where((F.size(F.array_except(needed, "markers")) == 0) & ((F.size(needed) == 0) | (F.size("markers") > F.size(needed))))
    order = Window.partitionBy("project").orderBy(F.size("markers").desc(), "k")
    return whole.withColumn("place", F.row_number().over(order)).select("project", "place", F.element_at(_literals([s[0] for s in stacks.STACKS]), F.col("k") + 1).alias("stack"), "markers")


def ignored_by_stack(found: DataFrame) -> DataFrame:
    """project, directory: what the stacks of a project ignore, each once."""
    names = {s[0]: s[4] for s in stacks.STACKS}
    return found.select("project", F.explode(_marks(names, F.col("stack"))).alias("directory")).distinct()


def package_managers(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, managers: sorted, by files at the root."""
    table = {k: [v] for k, v in stacks.PACKAGE_MANAGERS.items()}
    rows = files.select(F.col(project).alias("project"), F.explode(_marks(table, F.translate("rel_path", "\\", "/"))).alias("manager"))
    return rows.groupBy("project").agg(F.sort_array(F.collect_set("manager")).alias("managers"))


def dependency_stack(declared: DataFrame) -> DataFrame:
    """project, part, label: what the names of dependencies tell. declared: project, kind, name (see manifests)."""
    table = {k: [f"{part}\t{label}"] for k, (label, part) in stacks.DEPENDENCY_STACK.items()}
    rows = declared.where(F.col("kind").isin("dependency", "dev_dependency", "peer_dependency", "optional_dependency")).select("project", F.explode(_marks(table, F.col("name"))).alias("x")).distinct()
    return rows.select("project", F.split_part("x", F.lit("\t"), F.lit(1)).alias("part"), F.split_part("x", F.lit("\t"), F.lit(2)).alias("label"))


def is_config(path: Column) -> Column:
    p, n = F.translate(path, "\\", "/"), F.lower(paths.name(path))
    workflow = p.startswith(stacks.WORKFLOWS) & (n.endswith(".yml") | n.endswith(".yaml"))
    return n.isin([c.lower() for c in stacks.CONFIG_FILES]) | workflow | n.startswith("dockerfile") | n.startswith(".env")


def config_checklist(files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, capability, present: what a project's configuration files show to be in use. files: project, rel_path."""
    rows = files.where(is_config(F.col("rel_path"))).select(F.col(project).alias("project"), F.lower(paths.name(F.col("rel_path"))).alias("name"), F.translate("rel_path", "\\", "/").alias("path"))
    flags = [F.max((F.col("path") if "/" in pattern else F.col("name")).rlike(pattern)).alias(label) for label, pattern in stacks.CHECKLIST.items()]
    wide = rows.groupBy("project").agg(*flags)
    return wide.select("project", F.explode(F.array(*(F.struct(F.lit(label).alias("capability"), F.col(f"`{label}`").alias("present")) for label in stacks.CHECKLIST))).alias("c")).select("project", "c.*")


def stripped_language(path: Column) -> Column:
    """The language as which comments are taken out of a file; null if it is none of them."""
    table = F.create_map(*(F.lit(x) for pair in stacks.STRIPPED_LANGUAGES.items() for x in pair))
    return F.when(F.lower(paths.name(path)).isin(stacks.MAKEFILES), "Makefile").otherwise(F.try_element_at(table, paths.extension(path)))
