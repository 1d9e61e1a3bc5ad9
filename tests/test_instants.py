import tempfile
from datetime import datetime, timezone

import pytest

from cairn.functions.instants import instant
from cairn.operators.instants import extend_dictionary, normalised_instants

NY, BERLIN = ("America/New_York", "en_US"), ("Europe/Berlin", "de_DE")


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "raw, zone, want",
    [
        ("2024-03-05 10:00:00", NY, us(2024, 3, 5, 15)),
        ("2024-03-05T10:00:00Z", (None, None), us(2024, 3, 5, 10)),
        (" 2024-03-05T10:00:00.123456789+05:45\n", NY, us(2024, 3, 5, 4, 15) + 123456),
        ("03/05/2024 10:00 PM", NY, us(2024, 3, 6, 3)),
        ("05.03.2024 10:00", BERLIN, us(2024, 3, 5, 9)),
        ("13/03/2024 10:00:00", NY, None),
        ("5. März 2024, 10:00 Uhr", BERLIN, us(2024, 3, 5, 9)),
        ("Tue, 05 Mar 2024 10:00:00 +0100", NY, us(2024, 3, 5, 9)),
        ("Tue Mar 5 10:00:00 2024 +0100", NY, us(2024, 3, 5, 9)),
        ("1709632800 +0100", NY, 1709632800000000),
        ("1709632800.5", NY, 1709632800500000),
        ("1709632800123", NY, 1709632800123000),
        ("20240305100000", BERLIN, us(2024, 3, 5, 9)),
        ("20240305T100000Z", BERLIN, us(2024, 3, 5, 10)),
        ("2024-11-03 01:30:00", NY, None),
        ("2024-11-03 01:30:00 EDT", NY, us(2024, 11, 3, 5, 30)),
        ("2024-11-03 01:30:00 EST", NY, us(2024, 11, 3, 6, 30)),
        ("2024-03-10T02:30:00[America/New_York]", BERLIN, None),
        ("2024-03-10 05:30:00 America/Los_Angeles", BERLIN, us(2024, 3, 10, 12, 30)),
        ("2024-07-01 12:00:00 IST", ("Asia/Kolkata", "en_IN"), us(2024, 7, 1, 6, 30)),
        ("2024-07-01 12:00:00 IST", NY, None),
        ("2024-07-01 12:00:00 -03", ("America/Sao_Paulo", "pt_BR"), us(2024, 7, 1, 15)),
        ("2013-06-01 12:00:00 MSK", ("Europe/Moscow", "ru_RU"), us(2013, 6, 1, 8)), ("2015-06-01 12:00:00 MSK", ("Europe/Moscow", "ru_RU"), us(2015, 6, 1, 9)), ("2024-07-01 12:00:00 EST", NY, None),
        ("2024-02-30 10:00:00", NY, None),
        ("2024-02-03 25:00:00", NY, None),
        ("2024-02-03 10:00:60", NY, None),
        ("0", NY, None), ("-1", NY, None), ("-62135596800", NY, None), ("pending", NY, None), ("", NY, None), (None, NY, None), ("2024-02-03 10:00:00", (None, None), None), ("2024-02-03", NY, None),
    ],
)
def test_forms(raw, zone, want):
    assert instant(raw, *zone) == want


def test_records(spark):
    rows = [
        ("a", 1, "1709632800", None, None, 5), ("a", 1, "1709632800", None, None, 6), ("a", 2, "x", *NY, 1), ("a", 3, None, *NY, 1), ("a", 4, "1", *NY, 1), ("a", 4, "2", *NY, 1), ("b", 1, "2024-03-05 10:00:00", *NY, 1), ("b", None, "5", *NY, 1),
    ]
    df = spark.createDataFrame(rows, "source_table string, record_id long, raw string, tz_name string, locale string, utc_us long")
    assert {tuple(r) for r in normalised_instants(df).collect()} == {("a", 1, 1709632800000000), ("b", 1, us(2024, 3, 5, 15))}
    assert normalised_instants(df.limit(0)).count() == 0


def test_dictionary_is_extended_and_never_parsed_twice(spark):
    path = tempfile.mkdtemp() + "/dictionary"
    make = lambda raws: spark.createDataFrame([(r, None, None) for r in raws], "raw string, tz_name string, locale string")
    assert extend_dictionary(make(["5", "x", "5"]), path).count() == 2
    assert extend_dictionary(make(["5", "7"]), path).count() == 3
    assert {(r.raw, r.utc_us) for r in extend_dictionary(make([]), path).collect()} == {("5", 5_000_000), ("7", 7_000_000), ("x", None)}


def test_a_value_of_many_rows_and_a_kept_dictionary(spark):
    path = tempfile.mkdtemp() + "/dictionary"
    df = spark.range(60_000).selectExpr("'a' AS source_table", "id AS record_id", "if(id % 3 = 0, '1709632800', cast(1700000000 + id AS string)) AS raw", "cast(null AS string) AS tz_name", "cast(null AS string) AS locale")
    first = normalised_instants(df, path)
    assert first.count() == 60_000 and first.where("record_id % 3 = 0 AND utc_us <> 1709632800000000").count() == 0
    written = extend_dictionary(df.limit(0), path).count()
    assert normalised_instants(df, path).count() == 60_000 and extend_dictionary(df, path).count() == written == 40_001


def test_a_broken_dictionary_is_an_error(spark):
    path = tempfile.mkdtemp()
    with open(path + "/part.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        extend_dictionary(spark.createDataFrame([("5", None, None)], "raw string, tz_name string, locale string"), path).count()
