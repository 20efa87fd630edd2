import pytest

from landweave.operators.timestamps import instant_text, normalise_timestamps, parse_instant, update_dictionary

CASES = [
    ("2018-10-28 01:02:04+0100", "Europe/Dublin", "DMY", "2018-10-28T00:02:04.000000Z"),
    ("2014-02-24T06:48:03.867285254-08:00", "UTC", "DMY", "2014-02-24T14:48:03.867285Z"),
    ("2020-10-25 01:16:51 GMT", "Europe/Dublin", "DMY", "2020-10-25T01:16:51.000000Z"),
    ("2020-10-25 01:16:51 IST", "Europe/Dublin", "DMY", "2020-10-25T00:16:51.000000Z"),
    ("25.10.2020 01:15:41", "Europe/Dublin", "DMY", "ambiguous"),
    ("29.03.2020 01:51:43", "Europe/Dublin", "DMY", "nonexistent"),
    ("2019-10-06T02:10", "Australia/Lord_Howe", "DMY", "nonexistent"),
    ("03/04/2020 05:06", "America/Chicago", "MDY", "2020-03-04T11:06:00.000000Z"),
    ("03/04/2020 05:06", "UTC", "DMY", "2020-04-03T05:06:00.000000Z"),
    ("27-03-22 02:24 AM", "Asia/Kolkata", "DMY", "2022-03-26T20:54:00.000000Z"),
    ("22-03-27 02:24 AM", "UTC", "YMD", "2022-03-27T02:24:00.000000Z"),
    ("18 May 2017, 4:04 pm", "Asia/Kolkata", "DMY", "2017-05-18T10:34:00.000000Z"),
    ("April 12, 2021, 8:33 am", "UTC", "MDY", "2021-04-12T08:33:00.000000Z"),
    ("Fri, 01 Apr 2022 13:50:08 +0100", "UTC", "DMY", "2022-04-01T12:50:08.000000Z"),
    ("10 April 2019 01:15 UTC+05:30", "UTC", "DMY", "2019-04-09T19:45:00.000000Z"),
    ("2012-07-02T16:03:34+05:30[Asia/Kolkata]", "UTC", "DMY", "2012-07-02T10:33:34.000000Z"),
    ("20120522T043632Z", "Asia/Kolkata", "DMY", "2012-05-22T04:36:32.000000Z"),
    ("20150529 194250", "UTC", "DMY", "2015-05-29T19:42:50.000000Z"),
    ("1428139011", "Asia/Kolkata", "DMY", "2015-04-04T09:16:51.000000Z"),
    ("1339663129571", "UTC", "DMY", "2012-06-14T08:38:49.571000Z"),
    ("1341480203247224", "UTC", "DMY", "2012-07-05T09:23:23.247224Z"),
    ("०५/०५/२०१९ ११:४१:१०", "UTC", "DMY", "2019-05-05T11:41:10.000000Z"),
    ("01-Apr-2021", "UTC", "DMY", "2021-04-01T00:00:00.000000Z"),
    ("31/02/2023", "UTC", "DMY", "unreadable"), ("25:61", "UTC", "DMY", "unreadable"), ("0000-00-00 00:00:00", "UTC", "DMY", "unreadable"),
    ("as per register", "UTC", "DMY", "unreadable"), ("अज्ञात", "UTC", "DMY", "unreadable"), ("2023-13-45", "UTC", "DMY", "unreadable"),
    ("2020-01-01 10:00", "", "DMY", "unreadable"), ("   ", "UTC", "DMY", "blank"), (None, "UTC", "DMY", "blank"),
]


@pytest.mark.parametrize(("text", "zone", "order", "expected"), CASES)
def test_parse(text, zone, order, expected):
    assert instant_text(*parse_instant(text, zone, order)) == expected


def test_rows_keep_columns_and_repeats(spark):
    sources = spark.createDataFrame([("a", "Asia/Kolkata", "DMY")], "source_system string, time_zone string, date_order string")
    rows = spark.createDataFrame([(1, "a", "2020-01-01", "x"), (1, "a", "2020-01-01", "x"), (2, "b", "2020-01-01", "y"), (3, None, None, "z")], "id long, s string, t string, instant_utc string")
    out = {(r["id"], r["instant_utc"]) for r in normalise_timestamps(rows, "t", "s", sources).collect()}
    assert out == {(1, "2019-12-31T18:30:00.000000Z"), (2, "unreadable"), (3, "blank")}
    assert normalise_timestamps(rows, "t", "s", sources).count() == 4
    assert normalise_timestamps(rows.limit(0), "t", "s", sources).count() == 0


def test_dictionary_grows_by_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    schema = "__ts_text string, __ts_zone string, __ts_order string"
    update_dictionary(spark.createDataFrame([("2020-01-01", "UTC", "DMY")] * 3, schema), path)
    table, _ = update_dictionary(spark.createDataFrame([("2020-01-01", "UTC", "DMY"), ("2020-01-02", "UTC", "DMY")], schema), path)
    assert table.count() == 2
    assert spark.read.parquet(path).count() == 2
