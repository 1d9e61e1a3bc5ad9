import pytest

from cairn.config import ConfigError, allow_list, budget, layered, model_limits, project_config, user_profiles
from cairn.operators.findings import exit_code, gates
from cairn.reports import Catalogue, run


def test_project_settings_are_strict():
    assert project_config('export_profile = "quick"\ntoken_budget = 5\nextra_ignored_dirs = ["out"]\nredact_secrets = true') == {"export_profile": "quick", "token_budget": 5, "extra_ignored_dirs": ["out"], "redact_secrets": True}
    for text in ("colour = 1", 'token_budget = "5"', "token_budget = true", "token_budget = -1", "extra_ignored_dirs = [1]", "token_budget ="):
        with pytest.raises(ConfigError):
            project_config(text)
    assert project_config("") == {}


def test_allow_lists():
    assert allow_list('schema_version = 1\n[[allow]]\nfingerprint = "0123456789abcdef"\nreason = "test data"\n') == {"0123456789abcdef": "test data"}
    for text in ('[[allow]]\nfingerprint = "0123456789ABCDEF"\nreason = "x"', '[[allow]]\nfingerprint = "0123"\nreason = "x"', '[[allow]]\nfingerprint = "0123456789abcdef"', "deny = 1", "[[allow]"):
        with pytest.raises(ConfigError):
            allow_list(text)


def test_profiles_and_limits():
    got = user_profiles('{"description": "d", "profiles": {" a ": {"token_budget": 1}, "": {}, "b": 3}}')
    assert got.description == "d" and got.profiles == {"a": {"token_budget": 1}} and got.skipped == ["", "b"]
    assert user_profiles(None).profiles == {} == user_profiles("[]").profiles
    with pytest.raises(ConfigError):
        user_profiles("{")
    limits = model_limits('{"Big-2": 900}', {"big-1": 100, "small": 8})
    assert limits == {"big-1": 100, "small": 8, "Big-2": 900} and model_limits(None, {"x": 1}) == {"x": 1}
    for text in ("{", "[1]", '{"a": -1}', '{"a": true}', '{"a": "1"}'):
        with pytest.raises(ConfigError):
            model_limits(text, {})
    assert [budget(x, limits) for x in ("200k", " 1M ", "7", "+7", "small", "SMALL", "big-2", "sma")] == [200_000, 1_000_000, 7, 7, 8, 8, 900, 8]
    for text in ("", "big", "none", "-5", "5x"):
        with pytest.raises(ConfigError):
            budget(text, limits)


def test_later_layers_override_earlier_ones():
    assert layered({"a": 1, "b": 2}, None, {"b": 3, "c": None}) == ({"a": 1, "b": 3}, {"a": 0, "b": 2})


def test_a_failing_report_stops_no_other(spark):
    out = Catalogue()
    out.add("one", ("quick",), "", lambda s, d: s.range(3))
    out.add("two", ("quick", "security"), "", lambda s, d: s.range(1).select("missing"))
    out.add("three", ("security",), "", lambda s, d: s.range(2))
    with pytest.raises(ValueError):
        out.add("one", (), "", lambda s, d: s.range(1))
    with pytest.raises(ValueError):
        out.add("four", ("slow",), "", lambda s, d: s.range(1))
    told, counts = [], {}
    write = lambda n, df: counts.update({n: df.count()})
    assert [r[:2] for r in run(out, "full", spark, "", write, tell=told.append)] == [("one", "done"), ("two", "failed"), ("three", "done")]
    assert counts == {"one": 3, "three": 2} and [p.kind for p in told if p.step == "two"] == ["started", "log", "finished"]
    assert [r[:2] for r in run(out, "security", spark, "", write, cancelled=lambda: True)] == [("two", "cancelled"), ("three", "cancelled")]
    assert {(r.report, r.runs) for r in out.table(spark).where("profile = 'quick'").collect()} == {("one", True), ("two", True), ("three", False)}


def test_codes_of_a_run(spark):
    assert [exit_code(0), exit_code(3), exit_code(3, failed=True), exit_code(0, arguments=False)] == [0, 3, 1, 2]
    rows = spark.createDataFrame([("Critical",), ("low",), (None,)], "severity string")
    assert {(r.fail_on, r.gating, r.exit_code) for r in gates(rows).collect()} == {("critical", 1, 3), ("high", 1, 3), ("medium", 1, 3), ("low", 2, 3)}
    assert all(r.exit_code == 0 for r in gates(rows.limit(0)).collect())
