"""Timestamps: notations, and local times against the zone database."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Row

from docassay.operators import timestamps

META = "doc_id long, site string, cover_metadata struct<document_date:string>, cover_date string, creation_date string, zone string"
SITES = [("LON", "Europe/London", True), ("CHI", "America/Chicago", False), ("SYD", "Australia/Sydney", True), ("JKT", "Asia/Jakarta", True), ("TYO", "Asia/Tokyo", False)]


def normal(spark, rows):
    meta = spark.createDataFrame([(i, s, Row(document_date=a), b, c, "clash") for i, (s, a, b, c) in enumerate(rows)], META)
    sites = spark.createDataFrame(SITES, "site string, time_zone string, day_first boolean")
    return {(r.doc_id, r.field): r.iso for r in timestamps.unambiguous(spark, meta, sites).collect()}


def test_notations(spark):
    cases = [
        ("LON", "2019-05-24", "2019-05-24"), ("CHI", "12/07/2019", "2019-12-07"), ("LON", "12/07/2019", "2019-07-12"), ("LON", "31/02/2021", None), ("LON", "2020-13-05", None),
        ("LON", "14 octobre 2013", "2013-10-14"), ("LON", "20. März 2020", "2020-03-20"), ("LON", "September 21 2014", "2014-09-21"), ("LON", "2018年7月1日", "2018-07-01"), ("LON", "20181223", "2018-12-23"),
        ("LON", "05-Oct-20", "2020-10-05"), ("LON", "  8 Oct 2016 ", "2016-10-08"), ("LON", "Q3 2021", None), ("LON", "Mar 2022", None), ("LON", "2019", None), ("LON", "TBD", None), ("LON", "", None), ("LON", None, None),
        ("LON", "1358559490", "2013-01-19T01:38:10Z"), ("LON", "1390320712339", "2014-01-21T16:11:52Z"), ("LON", "D:20130309062739+08'00'", "2013-03-08T22:27:39Z"), ("LON", "D:20131101170347Z", "2013-11-01T17:03:47Z"),
        ("LON", "2018-01-09T02:30:58.918245Z", "2018-01-09T02:30:58Z"), ("JKT", "2014-12-26 05:45:02 WIB", "2014-12-25T22:45:02Z"), ("CHI", "2022-07-21 04:33:34 CDT", "2022-07-21T09:33:34Z"), ("LON", "2012-09-01 18:09:37 BST", "2012-09-01T17:09:37Z"),
        ("LON", "Sun, 25 Oct 2020 01:24:13 +0200", "2020-10-24T23:24:13Z"), ("CHI", "05/23/2018 2:28 PM", "2018-05-23T19:28:00Z"), ("JKT", "26/11/2024 12:05 AM", "2024-11-25T17:05:00Z"), ("CHI", "00/00/0000", None), ("LON", "2019-05-24 25:00:00", None),
        ("XXX", "12/07/2019", None), ("XXX", "2019-07-12", "2019-07-12"), (None, "2019-07-12 10:00:00", None),
    ]
    got = normal(spark, [(s, t, None, None) for s, t, _ in cases])
    for i, (_, text, want) in enumerate(cases):
        assert got.get((i, "document_date")) == want, text


def brute(zone, wall):
    """The first instant whose wall clock shows the time; a skipped time moves forward by the gap."""
    tz = ZoneInfo(zone)
    first = wall.replace(tzinfo=tz, fold=0).astimezone(UTC)
    return first.strftime("%Y-%m-%dT%H:%M:%SZ")


def test_local_times_against_the_zone_database(spark):
    rng, rows, want = random.Random(5), [], []
    turns = [datetime(2021, 3, 28, 1, 0), datetime(2021, 10, 31, 1, 0), datetime(2021, 3, 14, 2, 0), datetime(2021, 11, 7, 1, 0), datetime(2021, 4, 4, 2, 0), datetime(2021, 10, 3, 2, 0)]
    for site, zone, _ in SITES:
        times = [t + timedelta(minutes=rng.randrange(-180, 180)) for t in turns for _ in range(12)] + [datetime(1971, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 365 * 60)) for _ in range(40)]
        for t in times:
            rows.append((site, t.strftime("%Y-%m-%d %H:%M:%S"), None, None))
            want.append(brute(zone, t))
    got = normal(spark, rows)
    assert [got[i, "document_date"] for i in range(len(rows))] == want


def test_years_outside_of_the_table(spark):
    """Wall times long before and long behind any table of offsets, at the turns of 2150, 2839 and 9998 too."""
    walls = [datetime(1965, 3, 2, 10), datetime(1850, 6, 1, 12), datetime(1700, 6, 1, 12), datetime(1, 5, 1, 1), datetime(2149, 6, 1, 8, 30), datetime(2150, 1, 1, 10), datetime(9998, 7, 1, 12)]
    walls += [datetime(y, m, d, h, 30) for y in (2150, 2438, 2439, 2839, 5000) for m in (3, 4, 10, 11) for d in range(1, 31, 3) for h in (1, 2)]
    rows = [(site, f"{w.year:04d}-{w:%m-%d %H:%M:%S}", None, None) for site, _, _ in SITES for w in walls]
    want = [datetime_text(zone, w) for _, zone, _ in SITES for w in walls]
    got = normal(spark, rows)
    assert [got[i, "document_date"] for i in range(len(rows))] == want


def datetime_text(zone, wall):
    at = wall.replace(tzinfo=ZoneInfo(zone), fold=0)
    utc = wall - at.utcoffset()
    return f"{utc.year:04d}-{utc:%m-%dT%H:%M:%SZ}"


def test_status(spark):
    texts = ["2021-03-28 01:30:00", "2021-10-31 01:30:00", "2021-06-01 12:00:00", "2021-06-01", "2021-06-01T12:00:00Z", "1358559490", "nothing 1"]
    meta = spark.createDataFrame([(i, "LON", Row(document_date=t), None, None, "") for i, t in enumerate(texts)], META)
    sites = spark.createDataFrame(SITES, "site string, time_zone string, day_first boolean")
    got = {r.doc_id: (r.iso, r.status) for r in timestamps.resolved(spark, meta, sites).collect()}
    assert got == {0: ("2021-03-28T01:30:00Z", "NONEXISTENT"), 1: ("2021-10-31T00:30:00Z", "AMBIGUOUS"), 2: ("2021-06-01T11:00:00Z", "UNIQUE"), 3: ("2021-06-01", "DAY"), 4: ("2021-06-01T12:00:00Z", "ZONED"), 5: ("2013-01-19T01:38:10Z", "EPOCH")}


def test_intervals_meet():
    for _, zone, _ in SITES:
        found = timestamps.offset_intervals(zone)
        assert all(a[1] == b[0] and a[2:] != b[2:] for a, b in zip(found, found[1:]))
        for start, end, offset, _ in found[1:60]:
            assert datetime.fromtimestamp((start + end) // 2, ZoneInfo(zone)).utcoffset().total_seconds() == offset


def test_empty_and_repeated(spark):
    meta = spark.createDataFrame([(1, "LON", Row(document_date="2019-05-24"), None, None, "")] * 2, META)
    sites = spark.createDataFrame(SITES, "site string, time_zone string, day_first boolean")
    assert timestamps.unambiguous(spark, meta, sites).count() == 1
    assert timestamps.unambiguous(spark, meta.limit(0), sites).count() == 0
    assert timestamps.unambiguous(spark, meta, sites.limit(0)).count() == 1
