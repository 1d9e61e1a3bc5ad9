import pytest

from cairn.llm.tokens import count, token_counts


def test_counts():
    assert count(None) == 0 == count("") and count("hello world") == 2
    assert count("a b\n" * 5000) == pytest.approx(4 * 5000, rel=0.5)
    assert count("x" * 500_000) > 1000 and count(" " * 500_000) > 0 and count("\ud800 bad") > 0


def test_tables(spark):
    df = spark.createDataFrame([(1, "Title\nbody text here", "s", 9), (1, "Title\nbody text here", "s", 9), (2, None, None, 1), (3, "", "t", 1), (None, "x", "t", 1)], "doc_id long, text string, source string, tokens long")
    rows = {r.doc_id: r for r in token_counts(df, ("source",)).collect()}
    assert set(rows) == {1, 2, 3} and rows[2].tokens == 0 == rows[3].tokens and 0 < rows[1].loss_tokens < rows[1].tokens and rows[1].source == "s"
    assert token_counts(df.limit(0)).count() == 0
