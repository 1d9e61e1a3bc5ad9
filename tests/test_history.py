import subprocess

import pytest
from pyspark.sql import Row

from cairn.operators.history import blob_counters, by_author, churn, distinct_blobs, placed_findings, recent, tree_diff
from cairn.sources.git import Repository
from cairn.sources.repositories import GitSource


def git(folder, *a):
    who = ["-c", "user.name=Ada", "-c", "user.email=ada@h.example", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
    return subprocess.run(["git", *who, "-C", str(folder), *a], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    git(at, "init", "-q")
    (at / "src").mkdir()
    (at / "src/a.py").write_text("".join(f"line {k}\n" for k in range(400)))
    (at / "b.txt").write_text("b\n")
    git(at, "add", "-A"), git(at, "commit", "-qm", "first\n\nbody")
    (at / "src/a.py").write_text("".join(f"line {k}\n" for k in range(400) if k != 7) + "more\n")
    git(at, "commit", "-qam", "second")
    git(at, "mv", "b.txt", "c.txt"), git(at, "commit", "-qm", "third"), git(at, "tag", "-a", "v1", "-m", "tag")
    git(at, "gc", "-q", "--aggressive")
    (at / "d.txt").write_text("d\n"), git(at, "add", "d.txt"), (at / "e.txt").write_text("e\n")
    (at / "src/a.py").write_text("x\n"), (at / "c.txt").rename(at / "f.txt")
    return at


def test_objects_are_read_as_git_reads_them(repo):
    r = Repository(str(repo))
    log = list(r.log())
    assert [c["oid"] for c in log] == git(repo, "log", "--format=%H").split() and log[-1]["summary"] == "first" and log[0]["author_email"] == "ada@h.example"
    for c in log:
        assert {p: o for p, _, o in r.tree(c["tree"])} == {x.split("\t")[1]: x.split()[2] for x in git(repo, "ls-tree", "-r", c["oid"]).splitlines()}
        for _, _, oid in r.tree(c["tree"]):
            assert r.read(oid)[1].decode().strip() == git(repo, "cat-file", "blob", oid)
    assert r.resolve("v1") and r.commit(r.resolve("v1"))["oid"] == log[0]["oid"] and r.resolve("none") is None
    assert [c["summary"] for c in r.log(hide=log[1]["oid"])] == ["third"] and len(list(r.log(most=2))) == 2
    assert list(r.changes(log[1])) == [("src/a.py", 1, 1)]
    assert [(p, b) for p, _, b in r.staged()] == [("d.txt", b"d\n")]
    assert list(r.status()) == [("d.txt", "added", None), ("e.txt", "added", None), ("f.txt", "renamed", "c.txt"), ("src/a.py", "modified", None)]


def test_tables_of_repositories(spark, repo):
    spark.dataSource.register(GitSource)
    read = lambda t, **o: spark.read.format("gitrepository").options(table=t, **o).load(str(repo))
    commits = read("commits").withColumnRenamed("repository", "project_id")
    assert [tuple(r) for r in by_author(commits).select("author", "commits").collect()] == [("Ada", 3)]
    changes = read("changes").withColumnRenamed("repository", "project_id")
    got = {(r.path, r.churn, r.touches) for r in churn(changes, commits).collect()}
    assert got == {("src/a.py", 402, 2), ("b.txt", 2, 2), ("c.txt", 1, 1)}
    tree = lambda ref: read("tree", ref=ref).withColumnRenamed("repository", "project_id")
    first, last = git(repo, "log", "--format=%H").split()[-1], "HEAD"
    assert {tuple(r)[1:] for r in tree_diff(tree(first), tree(last)).collect()} == {("src/a.py", "modified", None), ("c.txt", "renamed", "b.txt")}
    blobs = read("blobs", most="0")
    assert blob_counters(blobs).first() == Row(blobs=3, too_large=0) and read("status").count() == 4 and read("staged").count() == 1


def test_blobs_and_findings(spark):
    rows = [(1, "ABCDEF0", "x/a.py", "src/a.py", 5, "c1", "t", "s"), (1, "abcdef012", "x/a.py", "src/a.py", 9, "c2", "t", "s"), (1, None, "y", "y", 1, "c", "t", None), (2, "abcdef0", "x/a.py", "b.py", 1, "c3", "t", None)]
    blobs = spark.createDataFrame(rows, "project_id long, oid string, relative string, repo_path string, at long, commit_oid string, committed_at string, summary string")
    assert {(r.project_id, r.short, r.at) for r in distinct_blobs(blobs, ["at"]).collect()} == {(1, "abcdef0", 9), (2, "abcdef0", 1)}
    found = spark.createDataFrame([(1, ".\\X\\a.py", 3, "r"), (1, "x/a.py", 3, "q"), (1, "none", 1, "r"), (None, "x/a.py", 1, "r"), (1, None, None, "r")], "project_id long, file string, line int, rule string")
    got = {(r.path, r.line, r.commit_oid, r.findings) for r in placed_findings(found, blobs).collect()}
    assert got == {("src/a.py", 3, "c2", 4)}
    assert [r.at for r in recent(blobs.select("project_id", "at"), 1, ["at"], ["project_id"]).orderBy("at").collect()] == [1, 9]
    assert recent(blobs, 0, ["at"]).count() == 4 and [r.at for r in recent(blobs, 2, ["at"]).collect()] == [9, 5]
