import json

import pytest

from cairn.__main__ import main
from cairn.operators.parts import planned_parts


@pytest.fixture
def folder(tmp_path, spark):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\npassword = 'hunter22x'\neval(x)\n")
    (tmp_path / "node_modules/b.py").write_text("eval(x)\n")
    (tmp_path / ".exportignore").write_text("*.tmp\n")
    (tmp_path / ".env").write_text("A=1\n")
    (tmp_path / "c.tmp").write_text("c")
    return tmp_path


def test_commands_and_codes(folder, capsys):
    assert main(["preview", str(folder)]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["command"] == "preview" and {r["status"]: r["files"] for r in got["summary"]} == {"included": 2, "excluded": 2}
    assert main(["scan", str(folder), "--fail-on", "critical"]) == 3
    got = json.loads(capsys.readouterr().out)
    assert {(f["rule"], f["severity"]) for f in got["findings"]} == {("secret_like_line", "high"), ("python-eval", "critical"), ("js-eval", "high"), ("sensitive_file", "critical")} and got["gating"] == 2
    assert main(["reports", str(folder)]) == 0 and len(json.loads(capsys.readouterr().out)["reports"]) > 10
    settings = folder / "s.toml"
    settings.write_text("colour = 1")
    assert main(["scan", str(folder), "--settings", str(settings)]) == 2 == main(["none", str(folder)]) == main(["scan"])
    assert main(["preview", str(folder / "missing")]) == 1


def test_hooks_see_the_plan_of_parts(spark):
    entries = spark.createDataFrame([("a", "g", f"p{k}", 6) for k in range(4)], "archive string, group string, path string, size long")
    seen = []
    placed = planned_parts(entries, 12, [lambda plan: seen.append({(r.part, r.files, r.bytes) for r in plan.collect()})])
    assert seen == [{(1, 2, 12), (2, 2, 12)}] and placed.count() == 4
