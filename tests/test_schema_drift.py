import json

from cairn.functions.settings import assign, canonical, fields, kind, similarity
from cairn.operators.schema_drift import name_pairs, paired, profiles, readable_revisions, schema_changes, sketches, synonyms, unified_settings

S = "settings_id long, install_id long, revision long, content string, path string, fields string"


def table(spark, rows):
    return spark.createDataFrame([(k, *r, "p", "clash") for k, r in enumerate(rows)], S)


def changes(spark, rows):
    out = [tuple(r) for r in schema_changes(table(spark, rows)).collect()]
    assert len(out) == len(set(out)) and not any(v is None for r in out for v in r)
    return set(out)


def test_names_and_values():
    assert canonical("cfg_max-textFile_MB_v2") == canonical("MaxTextFileMb") == "maxtextfilemb"
    assert similarity("window_geometry", "window_rect") >= 0.3 > similarity("redact_secrets", "watch_enabled")
    assert [kind(v) for v in (None, True, 1, 1.5, "a", [], {})] == ["null", "boolean", "number", "number", "string", "array", "object"]
    assert fields({"a": 1})[0][2] == fields({"a": 1.0})[0][2] != fields({"a": True})[0][2]
    assert {f[0] for f in fields({"a": {"b": [{"c": 1}]}})} == {"a", "a.b"}


def test_matching_is_of_greatest_weight():
    assert assign([("a", "x", 2.0), ("a", "y", 1.9), ("b", "x", 1.8)]) == [("a", "y"), ("b", "x")]
    assert assign([]) == []


def test_changes_by_hand(spark):
    one = {"max_text_file_mb": 5, "theme": "dark", "some_future_field": {"nested": True}, "n": None, "gone": 1}
    two = {"maxTextFileMb": 5, "ui": {"theme": "dark"}, "SomeFutureField": {"nested": True}, "n": 3, "fresh": [1]}
    rows = [(1, 1, json.dumps(one)), (1, 1, json.dumps(one, indent=2)), (1, 2, "{broken"), (1, 3, ""), (1, 4, None), (1, 5, json.dumps(two)), (2, 9, json.dumps({"theme": "light"})), (None, 1, "{}"), (3, None, "{}")]
    assert changes(spark, rows) == {
        (1, 5, "renamed", "max_text_file_mb", "maxTextFileMb"), (1, 5, "renamed", "theme", "ui.theme"), (1, 5, "added", "", "ui"), (1, 5, "renamed", "some_future_field", "SomeFutureField"),
        (1, 5, "renamed", "some_future_field.nested", "SomeFutureField.nested"), (1, 5, "removed", "gone", ""), (1, 5, "added", "", "fresh"),
    }


def test_retyped_and_rename_with_another_value(spark):
    rows = [(1, 1, '{"a": 1, "b": "x", "c_d": 1}'), (1, 300, '{"a": "1", "b": null, "cD": 2}'), (1, 9000, '{"a": [1], "b": 2, "cD": 2.0}')]
    assert changes(spark, rows) == {
        (1, 300, "retyped", "a", "a"), (1, 300, "removed", "c_d", ""), (1, 300, "added", "", "cD"), (1, 9000, "retyped", "a", "a"),
    }


def test_synonyms_are_learnt_from_swaps(spark):
    rows = []
    for k in range(6):
        rows += [(k, 1, json.dumps({"theme": f"t{k}", "keep": True})), (k, 2, json.dumps({"appearance": f"t{k}", "keep": True}))]
    rows += [(9, 1, '{"redact": true, "keep": true}'), (9, 2, '{"watch": true, "keep": true}')]
    got = changes(spark, rows)
    assert {(k, 2, "renamed", "theme", "appearance") for k in range(6)} <= got
    assert {(9, 2, "removed", "redact", ""), (9, 2, "added", "", "watch")} <= got


def test_unified_table(spark):
    rows = [(1, 1, '{"max_text_file_mb": 5, "limits": {"x": 1}}'), (2, 1, '{"max_text_file_mb": 8}'), (1, 2, '{"maxTextFileMb": 7}'), (1, 3, '{"limits": {"max_text_file_mb": 6}}'), (1, 4, "[1, 2]")]
    got = {tuple(r) for r in unified_settings(table(spark, rows)).collect()}
    assert {(i, r, v) for i, r, s, _, v, _ in got if s == "max_text_file_mb"} == {(1, 1, "5"), (2, 1, "8"), (1, 2, "7"), (1, 3, "6")}


def test_empty_tables(spark):
    assert changes(spark, []) == set() == changes(spark, [(1, 1, "null"), (1, 2, "[]")])
    assert unified_settings(table(spark, [])).count() == 0


def test_sketches_decide(spark):
    rows = []
    for k in range(8):
        rows += [(k, 1, json.dumps({"root": f"/srv/{k}", "redact": True})), (k, 2, json.dumps({"place": f"/srv/{k}", "watch": True})), (k, 3, json.dumps({"place": f"/srv/{k}"}))]
        # What every other name holds as well says nothing.
        rows += [(100 + k, 1, json.dumps({f"name{k}": True})), (100 + k, 2, "{}")]
    _, diffs = paired(readable_revisions(table(spark, rows)))
    profiled = profiles(readable_revisions(table(spark, rows)))
    known = lambda sketched=None: {(r.name, r.base) for r in synonyms(name_pairs(diffs, profiled, sketched), profiled).collect()}
    assert known() == {("root", "place")}
    none = sketches(diffs, profiled).limit(0)
    assert known(none) == set()


def test_every_setting_has_one_type(spark):
    rows = [(1, 1, '{"a": 1, "b": "x", "c": [1], "d": true}'), (1, 2, '{"a": "2", "b": 3, "c": 5, "d": "false"}'), (1, 3, '{"a": "many", "b": true, "c": null, "d": 7}'), (2, 1, '{"a": 4.5, "b": "y", "c": [2], "d": false}'), (3, 1, '{"a": "1.50"}'), (4, 1, '{"a": 8}'), (5, 1, '{"a": 9}')]
    got = {(i, r, s): (t, v, c) for i, r, s, t, v, c in unified_settings(table(spark, rows)).collect()}
    assert {s: t for (_, _, s), (t, _, _) in got.items()} == {"a": "number", "b": "string", "c": "array", "d": "boolean"}
    assert [got[k][1:] for k in ((1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "a"), (3, 1, "a"))] == [("1", ""), ("2", ""), ("", '"many"'), ("4.5", ""), ("", '"1.50"')]
    assert [got[1, 2, s][1:] for s in "bcd"] == [('"3"', ""), ("[5]", ""), ("false", "")] and [got[1, 3, s][1:] for s in "bcd"] == [('"true"', ""), ("null", ""), ("", "7")]
