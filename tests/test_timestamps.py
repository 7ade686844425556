from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from memloom.operators.timestamps import ABBREVIATIONS, normalised

CASES = [
    ("2024-05-06T07:08:09Z", None, None, "2024-05-06T07:08:09.000000Z"),
    ("2024-05-06", "Asia/Tokyo", None, "2024-05-06"),
    (" 2024-05-06t07:08:09z ", None, None, "2024-05-06T07:08:09.000000Z"),
    ("2024-05-06 07:08:09.123456789+05:30", None, None, "2024-05-06T01:38:09.123456Z"),
    ("20240506T070809Z", None, None, "2024-05-06T07:08:09.000000Z"),
    ("20240506", None, None, "2024-05-06"),
    ("1715000000", None, None, "2024-05-06T12:53:20.000000Z"),
    ("1715000000.25", None, None, "2024-05-06T12:53:20.250000Z"),
    ("1715000000123", None, None, "2024-05-06T12:53:20.123000Z"),
    ("1715000000123456", None, None, "2024-05-06T12:53:20.123456Z"),
    ("171500000012", None, None, "none"),
    ("Mon, 06 May 2024 07:08:09 -0400", None, None, "2024-05-06T11:08:09.000000Z"),
    ("Mon, 06 May 2024 07:08:09 GMT", "Asia/Tokyo", None, "2024-05-06T07:08:09.000000Z"),
    ("06.05.2024 07:08", "Europe/Berlin", "DMY", "2024-05-06T05:08:00.000000Z"),
    ("05/06/2024 7:08 PM", "America/New_York", "MDY", "2024-05-06T23:08:00.000000Z"),
    ("05/06/2024 12:08 AM", "America/New_York", "MDY", "2024-05-06T04:08:00.000000Z"),
    ("05/06/2024", None, "YMD", "none"),
    ("13/06/2024", None, "MDY", "none"),
    ("6 May 2024, 07:08:09", "Asia/Kolkata", "DMY", "2024-05-06T01:38:09.000000Z"),
    ("May 6, 2024, 7:08:09 AM", None, None, "2024-05-06T07:08:09.000000Z"),
    ("2024-05-06 07:08:09 America/New_York", None, None, "2024-05-06T11:08:09.000000Z"),
    ("2024-05-06T07:08:09+02:00[Europe/Berlin]", None, None, "2024-05-06T05:08:09.000000Z"),
    ("2024-05-06T07:08:09[Europe/Berlin]", "Asia/Tokyo", None, "2024-05-06T05:08:09.000000Z"),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, "ambiguous"),
    ("2024-10-27 02:30:00+01:00", "Europe/Berlin", None, "2024-10-27T01:30:00.000000Z"),
    ("2024-03-31 02:30:00", "Europe/Berlin", None, "none"),
    ("2024-03-31 03:00:00", "Europe/Berlin", None, "2024-03-31T01:00:00.000000Z"),
    ("2024-10-27 03:00:00", "Europe/Berlin", None, "2024-10-27T02:00:00.000000Z"),
    ("2024-04-07 02:15:00", "Australia/Sydney", None, "ambiguous"),
    ("2024-02-29", None, None, "2024-02-29"),
    ("2023-02-29", None, None, "none"),
    ("2024-13-01", None, None, "none"),
    ("2024-05-06 25:00:00", None, None, "none"),
    ("2024-05-06 07:08:09 Mars/Base", None, None, "none"),
    ("unknown", None, None, "none"),
    ("?", None, None, "none"),
    ("", None, None, "none"),
    (None, None, None, None),
]


def test_notations(spark):
    rows = [(i, v, z, o) for i, (v, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, value string, tz string, date_order string")
    got = {r["i"]: r["norm"] for r in normalised(df, "value", "tz", "date_order").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


def test_abbreviations_are_fixed_offsets(spark):
    """In summer and in winter alike, whatever the adapter's zone; an offset written beside one counts."""
    cases = [(f"2024-{m:02d}-15 {t}", "Asia/Tokyo", None, (datetime(2024, m, 15, 12) - timedelta(minutes=off)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")) for m in (1, 7) for name, off0 in ABBREVIATIONS.items() for t, off in ((f"12:00:00 {name}", off0), (f"12:00 PM {name}", off0), (f"12:00:00+02:00 {name}", 120))]
    df = spark.createDataFrame(cases, "value string, tz string, date_order string, want string")
    assert [tuple(r) for r in normalised(df, "value", "tz", "date_order").where("NOT (norm <=> want)").select("value", "norm", "want").collect()] == []


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "value string, tz string, date_order string, zone string, y int")
    out = normalised(df, "value", "tz", "date_order")
    assert out.count() == 0 and set(df.columns) < set(out.columns)


@pytest.mark.parametrize("text", ["x" * 100_000, "9" * 5000, "2024-05-06" * 1000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text, None, None)], "value string, tz string, date_order string")
    assert normalised(df, "value", "tz", "date_order").first()["norm"] == "none"
