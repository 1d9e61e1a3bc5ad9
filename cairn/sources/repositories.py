"""Tables over many git repositories, one task each: spark.read.format("gitrepository")."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.operators.history import LARGEST_BLOB, MOST_COMMITS
from cairn.sources.git import Repository

SCHEMAS = {
    "commits": "repository string, oid string, author string, email string, at bigint, summary string",
    "changes": "repository string, oid string, path string, inserted bigint, deleted bigint",
    "tree": "repository string, path string, oid string",
    "staged": "repository string, path string, oid string, content binary",
    "status": "repository string, path string, status string, old_path string",
    "blobs": "repository string, oid string, path string, commit_oid string, committed_at bigint, summary string, bytes bigint, content binary",
}


class _One(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.what, self.ref, self.hide = options.get("table", "commits"), options.get("ref", "HEAD"), options.get("since")
        self.most = int(options.get("most", MOST_COMMITS))

    def partitions(self) -> list[InputPartition]:
        return [_One(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo, name = Repository(partition.path), partition.path
        if self.what == "tree":
            for path, oid in repo.tree_of(self.ref).items():
                yield name, path, oid
        elif self.what == "staged":
            for row in repo.staged():
                yield (name, *row)
        elif self.what == "status":
            for row in repo.status():
                yield (name, *row)
        else:
            seen: set[str] = set()
            for entry in repo.log(self.ref, self.hide, self.most):
                if self.what == "commits":
                    yield name, entry["oid"], entry["author_name"], entry["author_email"], entry["committer_at"], entry["summary"]
                elif self.what == "changes":
                    for row in repo.changes(entry):
                        yield (name, entry["oid"], *row)
                else:
                    for path, _, oid in repo.tree(entry["tree"]):
                        if oid not in seen:
                            seen.add(oid)
                            body = repo.read(oid)[1]
                            # A blob that is too large is counted by its bytes and not carried.
                            yield name, oid, path, entry["oid"], entry["committer_at"], entry["summary"], len(body), body if len(body) <= LARGEST_BLOB else None


class GitSource(DataSource):
    """Options: table (commits, changes, tree, staged, status, blobs), ref, since (whose history is hidden), most (commits, 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "gitrepository"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
