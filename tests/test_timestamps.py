from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wordloom.operators.timestamps import normalize_timestamps

FEEDS = [("utc", "UTC", "ymd"), ("ny", "America/New_York", "mdy"), ("berlin", "Europe/Berlin", "dmy"), ("tokyo", "Asia/Tokyo", "ymd")]


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, s, "x") for i, (v, s) in enumerate(rows)], "row_id long, createdAt string, source string, zone_name string")
    feeds = spark.createDataFrame(FEEDS, "source string, zone_name string, date_style string")
    out = normalize_timestamps(df, feeds, **kw).orderBy("row_id")
    assert out.columns == ["row_id", "createdAt", "source", "zone_name", "utc_us", "utc_us_plain"]
    return [(r["utc_us"], r["utc_us_plain"]) for r in out.collect()]


def test_notations(spark):
    cases = [
        ("1735839373.1", "ny", us(2025, 1, 2, 17, 36, 13) + 100_000),
        ("1735819527167", None, us(2025, 1, 2, 12, 5, 27) + 167_000),
        ("1735817666417209", "ny", us(2025, 1, 2, 11, 34, 26) + 417_209),
        ("2025-01-02T13:09:55.233208974Z", "utc", us(2025, 1, 2, 13, 9, 55) + 233_208),
        ("20250102T073002Z", "ny", us(2025, 1, 2, 7, 30, 2)),
        ("2025-01-03T00:10+01", "utc", us(2025, 1, 2, 23, 10)),
        ("Fri, 03 Jan 2025 15:36:02 +0100", "ny", us(2025, 1, 3, 14, 36, 2)),
        ("10 Jan 2025, 10:24:30 (UTC+5:30)", "ny", us(2025, 1, 10, 4, 54, 30)),
        ("Wed Jan 08 11:37:37 CST 2025", "utc", us(2025, 1, 8, 17, 37, 37)),
        ("2025-01-04T01:55:36+09:00[Asia/Tokyo]", "utc", us(2025, 1, 3, 16, 55, 36)),
        ("02/01/2025 20:18:21", "berlin", us(2025, 1, 2, 19, 18, 21)),
        ("02/01/2025 3:21:47 AM", "ny", us(2025, 2, 1, 8, 21, 47)),
        ("05.01.25 00:01:49", "berlin", us(2025, 1, 4, 23, 1, 49)),
        ("Jan 8, 2025, 12:05:33 AM", "ny", us(2025, 1, 8, 5, 5, 33)),
        ("2025-01-03T12:59:39,600", "tokyo", us(2025, 1, 3, 3, 59, 39) + 600_000),
        (" 2025-01-03 12:59 ", "utc", us(2025, 1, 3, 12, 59)),
    ]
    assert [u for u, _ in run(spark, [c[:2] for c in cases])] == [c[2] for c in cases]


def test_no_moment(spark):
    bad = ["", " ", None, "unknown", "a few hours ago", "2025-02-30 10:00:00", "2025-13-01 10:00:00", "2025-01-02 24:00:00", "2025-01-02 10:61:00", "2025-01-27", "10:20:30", "31/04/2025 10:00:00", "2025-01-02 10:00:00 QQQ", "2025-01-02 13:00:00 PM", "9" * 5000]
    assert all(u is None for u, _ in run(spark, [(b, "berlin") for b in bad]))


def test_plain_only_on_utc(spark):
    assert [p for _, p in run(spark, [("2025-01-02 00:51:09", "utc"), ("2025-01-02 00:51:09", None), ("2025-01-02 00:51:09", "ny"), ("2025-01-02 00:51", "utc")])] == [True, True, False, False]


def test_daylight_saving_policy(spark):
    twice, skipped = ("11/02/2025 01:30:00", "ny"), ("03/09/2025 02:30:00", "ny")
    assert [u for u, _ in run(spark, [twice, skipped])] == [us(2025, 11, 2, 5, 30), us(2025, 3, 9, 7, 30)]
    assert [u for u, _ in run(spark, [twice, skipped], ambiguous="second", nonexistent="after")] == [us(2025, 11, 2, 6, 30), us(2025, 3, 9, 6, 30)]
    assert [u for u, _ in run(spark, [twice, skipped], ambiguous="null", nonexistent="null")] == [None, None]
    with pytest.raises(ValueError):
        run(spark, [twice], ambiguous="maybe")


def test_empty_table(spark):
    assert run(spark, [("x", "ny")])[:0] == []
    df = spark.createDataFrame([], "row_id long, createdAt string, source string")
    feeds = spark.createDataFrame(FEEDS, "source string, zone_name string, date_style string")
    assert normalize_timestamps(df, feeds).where(F.lit(True)).count() == 0
