import random
import tempfile

from cairn.operators import snapshot_changes as module
from cairn.operators.snapshot_changes import snapshot_changes
from cairn.runtime import only_one

H = "id long, project_id long, branch string, created_at long, file_count long, id2 string, snapshot_id long"
R = "snapshot_id long, rel_path string, sha256 string, size_bytes long, loc long, id string, pos long"


def run(spark, headers, files, path=None):
    h = spark.createDataFrame([(*x, "extra", 7) for x in headers], H)
    f = spark.createDataFrame([(*x, "clash", 9) for x in files], R)
    rows = [tuple(r) for r in snapshot_changes(h, f, path).collect()]
    assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)
    return set(rows)


def brute(headers, files):
    known = {}
    for s, p, h, b, n in files:
        if s is None or p is None:
            continue
        k = p.lower().replace("\\", "/").removeprefix("./")
        h = (h or "").strip().lower().split(":")[-1] or None
        old = known.setdefault(s, {}).get(k, (None, None, None))
        known[s][k] = tuple(max((x for x in (u, v) if x is not None), default=None) for u, v in zip(old, (h, b, n)))
    heads = sorted({x for x in headers if None not in x}, key=lambda x: (x[1], x[2], x[3], x[0]))
    heads = [x for x in heads if len(known.get(x[0], {})) >= x[4]]
    out = set()
    for a, b in zip(heads, heads[1:]):
        if a[1:3] != b[1:3]:
            continue
        p, c = known.get(a[0], {}), known.get(b[0], {})
        out |= {(b[0], k, "added") for k in c.keys() - p.keys()} | {(b[0], k, "removed") for k in p.keys() - c.keys()}
        out |= {(b[0], k, "changed") for k in c.keys() & p.keys() if any(x is not None and y is not None and x != y for x, y in zip(p[k], c[k]))}
    return out


def test_spellings_unknown_values_and_incomplete_snapshots(spark):
    headers = [(1, 1, "b", 10, 2), (2, 1, "b", 20, 2), (3, 1, "b", 30, 9), (4, 1, "b", 40, 0), (5, 1, "b", 50, 1), (5, 1, "b", 50, 1), (9, None, "b", 5, 1)]
    files = [
        (1, ".\\A\\x.py", "AB" * 32, 5, 1), (1, "y", None, None, None), (2, "a/X.py", "sha256:" + "ab" * 32, 5, 1), (2, "Y", "cd" * 32, 3, None),
        (3, "z", "00", 1, 1), (5, "./q", "", 1, None), (5, "q", None, 1, None), (None, "q", None, 1, 1), (5, None, None, 1, 1),
    ]
    assert run(spark, headers, files) == {(4, "a/x.py", "removed"), (4, "y", "removed"), (5, "q", "added")} == brute(headers, files)


def test_random_series_against_brute_force(spark):
    rng = random.Random(5)
    headers, files = [], []
    for s in range(40):
        headers.append((s, s % 3, "main", 1000 + rng.randrange(40) * 86_400 * 20 + s, 0 if s == 7 else 3))
        names = [f"dir/F{k}.py" for k in range(150) if rng.random() < 0.7] if s != 7 else []
        for n in names:
            files.append((s, rng.choice(["", "./", ".\\"]) + rng.choice([n, n.upper(), n.replace("/", "\\")]), rng.choice([None, "", "aa", "AA", "sha256:aa", "bb"]), rng.choice([None, 1, 1, 2]), rng.choice([None, 4, 4])))
    assert run(spark, headers, files) == brute(headers, files)


def test_one_hot_series_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 100)
    n = 1500
    headers = [(1, 1, "b", 1, n), (2, 1, "b", 2, n)]
    files = [(1, f"f{k}", "aa", 1, 1) for k in range(n)] + [(2, f"f{k}", "aa" if k % 2 else "bb", 1, 1) for k in range(1, n + 1)]
    assert run(spark, headers, files) == brute(headers, files)


def test_empty_tables(spark):
    assert run(spark, [], []) == set() == run(spark, [(1, 1, "b", 1, 0)], [])


def test_long_series_and_kept_ordinals(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    rng, path = random.Random(6), tempfile.mkdtemp() + "/ordinals"
    headers = [(s, s % 2, "b", 100 + s, 0) for s in range(30)]
    files = [(s, f"f{k}", rng.choice(["aa", "bb", None]), 1, 1) for s in range(30) for k in range(20 + s) if rng.random() < 0.8]
    early = [f for f in files if f[0] < 20]
    assert run(spark, headers[:20], early, path) == brute(headers[:20], early)
    first = {(r.project_id, r.branch, r.key): (r.block, r.ordinal) for r in spark.read.parquet(path).collect()}
    assert run(spark, headers, files, path) == brute(headers, files) == run(spark, headers, files, path)
    rows = spark.read.parquet(path).collect()
    last = {(r.project_id, r.branch, r.key): (r.block, r.ordinal) for r in rows}
    assert len(rows) == len(last) > len(first) and all(last[k] == v for k, v in first.items())
    assert len({(p, b, o) for (p, b, _), o in last.items()}) == len(last)


def test_only_one_run_extends_ordinals(spark):
    path = tempfile.mkdtemp() + "/ordinals"
    headers, files = [(1, 1, "b", 1, 0), (2, 1, "b", 2, 0)], [(1, "k", "aa", 1, 1), (2, "l", "aa", 1, 1)]
    with only_one(spark, path) as mine, only_one(spark, path) as other:
        assert mine and not other
        assert run(spark, headers, files, path) == brute(headers, files)
    assert run(spark, headers, files, path) == brute(headers, files) and spark.read.parquet(path).count() == 2


def test_declared_counts_say_nothing_of_blocks(spark):
    headers = [(1, 1, "b", 1, 0), (2, 1, "b", 2, 0)]
    files = [(s, f"f{k}", "aa", 1, 1) for s in (1, 2) for k in range(1500) if k % 7 != s]
    assert run(spark, headers, files) == brute(headers, files)
