import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import classify, detect, manifests, paths, policy, redact, sizes
from cairn.operators import findings, graph, lines, parts, rules, store
from cairn.operators.redaction import label_map, redacted_lines

GH = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
CASES = [
    ('SECRET_TOKEN = "placeholder-token-for-fixture-only"', "secret_like_line", "low"), ('password = "hunter22x"', "secret_like_line", "high"), ("Authorization: Bearer abcdefghijklmnop1234", "secret_like_line", "high"),
    (f"x {GH}", "github-token", "critical"), ("-----BEGIN RSA PRIVATE " + "KEY-----", "secret_like_line", "critical"), ("DATABASE_URL=", "secret_like_line", "medium"), ("12345678:" + "a" * 35, "telegram-bot-token", "critical"),
    ("u = http://me:pw@h/x", "url-credentials", "high"), ("h: Basic dXNlcjpwYXNzd29yZA==", "http-auth-credentials", "high"), ("# a token is made", None, None), ("Basic training", None, None), ("SECRET_PATTERNS: token=abc", None, None), ("éTOKEN=abc", None, None),
    ("v = q8Zr2LmX0pVt7YbNc4Ks", "high-entropy-token", "medium"),
]


def test_secret_cascade(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, content string").withColumn("s", detect.secret(F.col("content")))
    got = {r.k: (r.s.rule, r.s.confidence) if r.s else (None, None) for r in df.collect()}
    assert got == {k: (c[1], c[2]) for k, c in enumerate(CASES)}


def test_risky_code(spark):
    rows = [("eval(x)", {"python-eval", "js-eval"}), ("medieval (x)", set()), ("a.innerHTML == b", set()), ("a.innerHTML = b", {"inner-html"}), ("subprocess.run(c, shell = True)", {"subprocess-shell-true"}), ("localStorage.setItem('jwt', t)", {"local-storage-token"}), ("pickle.loads(b)", {"pickle-load"}), ("yaml.load(f)", {"unsafe-yaml-load"}), ("document.write(x)", {"document-write"}), ("exec (x)", {"python-exec"})]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, content string")
    assert {r.k: set(r.rules) for r in df.select("k", F.transform(detect.risky(F.col("content")), lambda x: x["rule"]).alias("rules")).collect()} == {k: r[1] for k, r in enumerate(rows)}


def test_lines_end_as_written(spark):
    texts = ["", "a", "a\n", "a\r\nb\r\n", "\n\n", "a\n\nb"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, text string")
    got = {}
    for r in lines.numbered_lines(df).collect():
        got.setdefault(r.k, []).append((r.line, r.content))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {1: ["a"], 2: ["a"], 3: ["a", "b"], 4: ["", ""], 5: ["a", "", "b"]}


def test_paths_and_classes(spark):
    rows = ["a\\b\\Main.PY", ".env", "x.tar.gz", "Dockerfile.dev", "tests/unit.spec.ts", "docs/readme.md", "Makefile.in", "", "src/latest.txt", "n\u00e4me.md"]
    p = F.col("p")
    df = spark.createDataFrame([(r,) for r in rows], "p string").select("p", paths.extension(p).alias("e"), paths.extension_key(p).alias("k"), paths.parent(p).alias("d"), paths.depth(p).alias("n"), paths.is_test(p).alias("t"), classify.is_text(p).alias("x"), classify.language(p).alias("l"), classify.plan_group(p).alias("g"), paths.ancestors(p).alias("a"), paths.suspicious(p).alias("s"))
    got = {r.p: r for r in df.collect()}
    assert got["a\\b\\Main.PY"][1:10] == ("py", "py", "a/b", 3, False, True, "Python", "python_source", ["a", "a/b"])
    assert (got[".env"].e, got[".env"].k, got[".env"].x) == ("", "[no extension]", True) and (got["x.tar.gz"].e, got["x.tar.gz"].x) == ("gz", False)
    assert got["Dockerfile.dev"].k == "dockerfile" and got["tests/unit.spec.ts"].t and not got["src/latest.txt"].t and got["Makefile.in"].l == "Makefile"
    assert got[""].s == "empty" and got["n\u00e4me.md"].s == "non-ascii"


def test_safety_modes(spark):
    rows = [".env", ".env.example", "my_secret.txt", "a.pem", "a.zip", "a.py"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    for mode, want in (("safe", [".env", "my_secret.txt", "a.pem", "a.zip"]), ("balanced", [".env", "a.pem"]), ("full", [])):
        assert [r.p for r in df.where(policy.safety(F.col("p"), mode).isNotNull()).collect()] == want
    assert sizes and [r.s for r in df.select(policy.sensitive_severity(F.col("p")).alias("s")).collect()] == ["critical", None, None, "critical", None, None]


def test_ignore_rules(spark):
    r = rules.Rules.parse("# c\nbuild_out/\n*.log # x\n!keep.log\n!pinned/\n[!a]bc?.txt\n", ["tmp"])
    df = spark.createDataFrame([(p,) for p in ["a/x.log", "a/keep.log", "x/pinned/y.log", "deep/build_out/z.py", "q.TMP", "xbcd.txt", "abcd.txt", "ok.py"]], "rel_path string")
    got = {x.rel_path: x.r for x in df.select("rel_path", r.reason(F.col("rel_path")).alias("r")).collect()}
    assert got == {"a/x.log": "file rule: *.log", "a/keep.log": None, "x/pinned/y.log": None, "deep/build_out/z.py": "directory rule: build_out", "q.TMP": "custom extension rule: .tmp", "xbcd.txt": "file rule: [!a]bc?.txt", "abcd.txt": None, "ok.py": None}
    planned = rules.plan(df.withColumn("size", F.lit(5)), r).collect()
    assert {p.rel_path for p in planned if p.status == "included"} == {"a/keep.log", "x/pinned/y.log", "abcd.txt", "ok.py"}


def test_redaction_leaves_no_value(spark):
    text = f'api_key = "{GH}"\nplain\nurl = "https://u:sup3rs3cret@h/x"\n'
    out = redacted_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(out) == 2 and all(GH not in r.redacted and "sup3rs3cret" not in r.redacted for r in out)
    assert redact.redact_line("nothing here") == "nothing here" and redact.redact_line(None) is None and redact.message(f"k {GH}").endswith(redact.MASK)


def test_labels_follow_the_first_sight(spark):
    df = spark.createDataFrame([(2, "token=bbbbbb1\ntoken=aaaaaa1"), (1, "x\ntoken=cccccc1"), (3, "token=cccccc1 ")], "doc_id long, text string")
    got = {r.secret: r.label for r in label_map(df, "doc_id").collect()}
    assert got == {"cccccc1": "<REDACTED:s1>", "bbbbbb1": "<REDACTED:s2>", "aaaaaa1": "<REDACTED:s3>"}


def test_scan_and_gate(spark):
    df = spark.createDataFrame([("app\\main.py", f"x = '{GH}'\neval(x)\n"), ("k.pem", None), ("n.bin", "eval(x)")], "rel_path string, text string")
    found = findings.scan(df)
    rows = {(r.rule, r.severity, r.line) for r in found.collect()}
    assert rows == {("github-token", "critical", 1), ("python-eval", "critical", 2), ("js-eval", "high", 2), ("sensitive_file", "critical", None)}
    assert findings.gate(found, "critical").first() == (3, True) and findings.summary(found).first().critical == 3


def test_imports_and_scores(spark):
    rows = [(1, 1, "app\\main.py", "import core.util, os\nfrom . import side\nfrom .pkg import x\n"), (2, 1, "core\\util.py", ""), (3, 1, "app\\pkg\\__init__.py", None), (4, 1, "web\\a.ts", "import {b} from './b';\nconst c = require('../lib')\n"), (5, 1, "web\\b.tsx", ""), (6, 1, "lib\\index.js", ""), (7, 2, "web\\b.ts", "")]
    df = spark.createDataFrame(rows, "doc_id long, project_id long, rel_path string, text string")
    edges = graph.import_edges(df)
    assert {(r.source, r.target) for r in edges.collect()} == {("app/main.py", "core/util.py"), ("app/main.py", "app/pkg/__init__.py"), ("web/a.ts", "web/b.tsx"), ("web/a.ts", "lib/index.js")}
    scores = {r.rel_path: r.score for r in graph.key_file_scores(df, edges).collect()}
    assert scores["app\\main.py"] == 45 and scores["core\\util.py"] == 8 + 12 + 5 and scores["lib\\index.js"] == 8 + 5
    go = spark.createDataFrame([(1, 9, "main.go", 'import "example/m/pkg"\n'), (2, 9, "pkg\\b.go", ""), (3, 9, "pkg\\a.go", "")], "doc_id long, project_id long, rel_path string, text string")
    assert [(r.source, r.target) for r in graph.import_edges(go, go_module=spark.createDataFrame([(9, "example/m")], "project long, module string")).collect()] == [("main.go", "pkg/a.go")]


def test_budget_and_parts(spark):
    df = spark.createDataFrame([("p", "a", 60.0, 60), ("p", "b", 40.0, 50), ("p", "c", 10.0, 30), ("p", "z", 0.0, 0), ("q", "a", 1.0, 500)], "group string, id string, importance double, tokens long")
    assert {(r.group, r.id) for r in parts.budget_fit(df, 100).where("included").collect()} == {("p", "a"), ("p", "c"), ("p", "z")}
    entries = spark.createDataFrame([("x", "20", "a", 60), ("x", "20", "B", 60), ("x", "20", "c", 40), ("x", "10", "d", 200), ("x", "10", "e", 1), ("y", "10", "f", 1)], "archive string, group string, path string, size long")
    assert {(r.archive, r.path, r.part) for r in parts.archive_parts(entries, 100).collect()} == {("x", "d", 1), ("x", "e", 2), ("x", "a", 3), ("x", "B", 4), ("x", "c", 4), ("y", "f", 1)}
    assert parts.part_target(512 * parts.MIB) == 500 * parts.MIB and parts.part_target(1) == 1


def test_store(spark):
    runs = spark.createDataFrame([(1, 7, 10), (1, 7, 12), (2, 7, 11), (3, 7, None), (4, 8, 5)], "id long, project_id long, finished_at long")
    assert {(r.id, r.finished_at) for r in store.retained(runs, 1).collect()} == {(1, 12), (4, 5)}
    now, then = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, sha256 string"), spark.createDataFrame([("b", "3"), ("c", "1")], "rel_path string, sha256 string")
    assert {tuple(r) for r in store.last_export_diff(now, then).collect()} == {("a", "added"), ("b", "modified"), ("c", "deleted")}


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("x/package.json", '{"dependencies": {"a": "^1"}, "scripts": {"t": "run"}}', [("dependency", "a", "^1"), ("script", "t", "run")]), ("package.json", "{", []), ("package.json", "[]", []),
        ("go.mod", "module m/x\nrequire a/b v1 // c\nrequire (\n  c/d v2\n)\n", [("module", "m/x", ""), ("dependency", "a/b", "v1"), ("dependency", "c/d", "v2")]),
        ("requirements-dev.txt", "# c\nflask>=2\n-r x\nrich\n", [("dependency", "flask", ">=2"), ("dependency", "rich", "")]), ("Makefile", "all: x\n\tcc y:\nz.o:\n", [("target", "all", ""), ("target", "z.o", "")]),
        ("docker-compose.yml", "services:\n  web:\n    image: a:1\n    ports:\n      - '80:80'\nvolumes:\n  v:\n", [("service", "web", ""), ("service.image", "web", "a:1"), ("service.ports", "web", "80:80")]), (None, None, []),
    ],
)
def test_manifests(path, text, want):
    assert manifests.declared(path, text) == want


def test_import_edges_of_go_files_are_in_the_query(spark, tmp_path):
    from cairn.queries import projects

    rows = [(1, 9, "go.mod", "module example/m\n\ngo 1.22\n"), (2, 9, "main.go", 'package main\n\nimport "example/m/pkg"\n'), (3, 9, "pkg/a.go", "package pkg\n")]
    now = datetime.datetime(2026, 1, 1)
    full = [(i, t, "go", "s", len(t), p, r, now) for i, p, r, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, project_id long, rel_path string, indexed_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.source, r.target) for r in projects.import_edges(spark, str(tmp_path)).collect()] == [("main.go", "pkg/a.go")]
