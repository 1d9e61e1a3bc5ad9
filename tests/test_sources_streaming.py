import zipfile

import pytest

from cairn.operators.rules import Rules
from cairn.sources import files as source
from cairn.streaming import scan


def test_directory_texts_and_snapshot(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes("print('\u00e9')\n\n".encode())
    (tmp_path / "y.txt").write_bytes("\u043f\u0440\u0438\u0432\u0435\u0442".encode("cp1251"))
    (tmp_path / "z.png").write_bytes(b"\x00\x01")
    rows = source.texts(source.directory(spark, str(tmp_path)))
    got = {r.rel_path: r for r in rows.collect()}
    assert set(got) == {"a/x.py", "y.txt", "z.png"} and got["a/x.py"].text.startswith("print") and got["y.txt"].text == "\u043f\u0440\u0438\u0432\u0435\u0442" and got["z.png"].text is None
    assert {r.rel_path: r["loc"] for r in source.snapshot(rows).collect()} == {"a/x.py": 1, "y.txt": 1, "z.png": 0}
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "Node_Modules").mkdir()
    (tmp_path / "Node_Modules" / "m.js").write_text("m")
    (tmp_path / "link.txt").symlink_to(tmp_path / "y.txt")
    assert {r.rel_path: r.content is None for r in source.directory(spark, "file://" + str(tmp_path), largest=5).collect()} == {".env": False, "a/x.py": True, "y.txt": True, "z.png": False}
    assert [r.rel_path for r in source.directory(spark, str(tmp_path), "*.py").collect()] == ["a/x.py"] and source.directory(spark, str(tmp_path / "a")).count() == 1


def test_zip_members_stay_inside(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ok/x.txt", "hi")
        z.writestr("../evil.txt", "no")
        z.writestr("/abs.txt", "no")
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "b.zip", "w") as z:
        z.writestr("C:/x.txt", "no")
        z.writestr("y.txt", "yes")
    (tmp_path / "no.zip").write_text("no archive")
    got = {(r.archive.rsplit("/", 1)[1], r.rel_path, bytes(r.content)) for r in source.zip_members(spark, str(tmp_path)).collect()}
    assert got == {("a.zip", "ok/x.txt", b"hi"), ("b.zip", "y.txt", b"yes")}


@pytest.mark.parametrize(
    "content, text",
    [
        (b"", ""), (b"abc", "abc"), ("\u00e9".encode(), "\u00e9"), (b"\xef\xbb\xbfa", "a"), ("\u043f\u0440\u0438\u0432\u0435\u0442".encode("cp1251"), "\u043f\u0440\u0438\u0432\u0435\u0442"), ("ab".encode("utf-16"), "ab"),
        (b"\x98", "\u0428"), (None, None),
    ],
)
def test_encodings_are_tried_in_order(content, text):
    assert source.decode(content) == text


def test_texts_of_reports(spark):
    rows = [(1, bytearray(b"")), (2, bytearray(b"a\xffb")), (3, bytearray(b"x" * 50)), (4, bytearray(b"a\0b")), (5, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    assert {r.id: r.text for r in source.report_text(df, 40).collect()} == {1: "", 2: "a\ufffdb", 3: None, 4: None, 5: None}
    assert {r.id: r.text for r in source.report_text(df).collect()}[3] == "x" * 50


def test_walks_leave_out_what_is_not_looked_into(spark):
    df = spark.createDataFrame([("b/x.txt",), ("a.txt",), (".git/c",), ("build-1/d",), ("B/.tox/e",)], "rel_path string")
    rows = source.walked(df, Rules.parse("build-*/\n")).orderBy("walk").collect()
    assert [r.rel_path for r in rows] == ["a.txt", "b/x.txt"]


def test_zip_parts_dump_and_copies(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, "a.txt", bytearray(b"1")), ("x", 2, "b.txt", bytearray(b"2"))], "archive string, part int, path string, content binary")
    assert source.zip_parts(rows, str(tmp_path)).count() == 2 and sorted(p.name for p in tmp_path.glob("*.zip")) == ["x.part001.zip", "x.part002.zip"]
    token = "ghp_" + "a1B2" * 9
    texts = spark.createDataFrame([("B.txt", 1, "t", "b"), ("a.txt", 2048, "t", f"x\nkey {token}\n"), ("c.bin", 1, "t", None)], "rel_path string, size long, modified string, text string")
    source.text_dump(texts, str(tmp_path / "dump"))
    dump = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))
    assert dump.index("File: a.txt") < dump.index("File: B.txt") and "Size: 2,048 bytes" in dump and token not in dump and "<REDACTED" in dump
    source.text_dump(texts, str(tmp_path / "plain"), redact=False)
    assert token in "".join(p.read_text() for p in (tmp_path / "plain").glob("part-*"))
    files = spark.createDataFrame([(1, "a", bytearray(b"1")), (1, "b", bytearray(b"2")), (2, "a", bytearray(b"3"))], "project_id long, rel_path string, content binary")
    chosen = spark.createDataFrame([(1, "a", "copied"), (1, "b", "safety"), (2, "a", "diff")], "project_id long, rel_path string, outcome string")
    source.copied(files, chosen, str(tmp_path / "copy"))
    assert [(r.project_id, r.rel_path) for r in spark.read.parquet(str(tmp_path / "copy")).collect()] == [(1, "a")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"x\ntoken = 'v{k}alue'\n" if k % 3 else "nothing") for k in range(20)], "doc_id long, text string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    query = scan.scan_stream(scan.arriving(spark, str(tmp_path / "in"), rows.schema, per_trigger=2), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, scan.secret_lines(rows).collect()))
