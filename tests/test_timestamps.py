import datetime as dt

import pytest

from paperloom.operators import timestamps as ts


def second(*args, offset=0):
    return int((dt.datetime(*args) - dt.datetime(1970, 1, 1)).total_seconds()) - offset


CASES = [
    ("2024-04-16", second(2024, 4, 16), "exact"), (' "2024/04/16"\n', second(2024, 4, 16), "exact"), ("04/06/2023", second(2023, 4, 6), "exact"),
    ("12.7.2022", second(2022, 7, 12), "exact"), ("20220630", second(2022, 6, 30), "exact"), ("18-MAY-2022", second(2022, 5, 18), "exact"),
    ("27 Jul 2027", second(2027, 7, 27), "exact"), ("July 11, 2021", second(2021, 7, 11), "exact"), ("May 26 2021", second(2021, 5, 26), "exact"),
    ("2025-W52-3", second(2025, 12, 24), "exact"), ("2021-092", second(2021, 4, 2), "exact"), ("2020-366", second(2020, 12, 31), "exact"),
    ("1803342814", 1803342814, "exact"), ("1696128202282", 1696128202, "exact"), ("1637790936555661", 1637790936, "exact"), ("1683886320.0", 1683886320, "exact"),
    ("2024-05-04T07:59:48.814Z", second(2024, 5, 4, 7, 59, 48), "exact"), ("2027-05-09t07:50:31.746z", second(2027, 5, 9, 7, 50, 31), "exact"),
    ("Sat, 08 Feb 2025 05:35:29 +0900", second(2025, 2, 8, 5, 35, 29, offset=32400), "exact"), ("2023-06-29T07:24:00-03:30", second(2023, 6, 29, 7, 24, offset=-12600), "exact"),
    ("2022-01-23 12:11 JST", second(2022, 1, 23, 12, 11, offset=32400), "exact"), ("20230120T133339Z", second(2023, 1, 20, 13, 33, 39), "exact"),
    ("05/08/2026 12:23 AM", second(2026, 5, 8, 0, 23, offset=7200), "zoned"), ("2024-11-08T09:13:07[Asia/Tokyo]", second(2024, 11, 8, 9, 13, 7, offset=32400), "zoned"),
    ("2021-09-17 15:28:45 America/New_York", second(2021, 9, 17, 15, 28, 45, offset=-14400), "zoned"), ("2024-04-27 00:23:00,508164", second(2024, 4, 27, 0, 23, offset=7200), "zoned"),
    ("27.10.2024 02:30", second(2024, 10, 27, 2, 30, offset=7200), "ambiguous"), ("2024-03-31 02:38:53", second(2024, 3, 31, 2, 38, 53, offset=3600), "nonexistent"),
    ("2024-02-30", None, "unreadable"), ("31.04.2024", None, "unreadable"), ("2024", None, "unreadable"), ("2025-03", None, "unreadable"), ("Q3 2025", None, "unreadable"),
    ("25:00", None, "unreadable"), ("soon", None, "unreadable"), ("", None, "unreadable"), (None, None, "unreadable"), ("2024-01-01 25:10", None, "unreadable"),
    ("2024-01-01 10:00 XYZ", None, "unreadable"), ("x" * 50_000, None, "unreadable"), ("9" * 300, None, "unreadable"),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("home", "Europe/Berlin"), (None, None)], "project string, time_zone string")


def test_formats_and_zones(spark, zones):
    rows = [(i, v, "home", 2024, "x", -1) for i, (v, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, value string, project string, year int, zone_key string, utc_second long")
    got = {r.i: (r.utc_second, r.status, r.year) for r in ts.normalise(df, "value", "project", zones).collect()}
    for i, (value, instant, status) in enumerate(CASES):
        assert got[i] == (instant, status, 2024), (value, got[i], instant, status)


def test_unknown_project_counts_as_utc_and_rows_are_kept(spark, zones):
    df = spark.createDataFrame([("2024-01-01 10:00", None), ("2024-01-01 10:00", None), ("2024-01-01 10:00", "other")], "value string, project string")
    got = ts.normalise(df, "value", "project", zones).collect()
    assert [r.utc_second for r in got] == [second(2024, 1, 1, 10)] * 3


def test_empty(spark, zones):
    df = spark.createDataFrame([], "value string, project string")
    assert ts.normalise(df, "value", "project", zones).count() == 0
    assert ts.normalise(spark.createDataFrame([("2024-01-01", "home")], "value string, project string"), "value", "project", zones.limit(0)).count() == 1
