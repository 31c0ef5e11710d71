import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from dateline.functions.times import contains_digit, time_attribute, with_parsed_time

RUN = dt.datetime(2026, 1, 2, 3, 4, 5)


def parse_all(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    run = F.lit(str(RUN)).cast("timestamp")
    parsed = with_parsed_time(rows, "raw", run, "at").orderBy("i")
    text = parsed.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    return [dt.datetime.fromisoformat(r["at"]) for r in text.collect()]


CASES = {
    None: RUN,
    "": RUN,
    "   ": RUN,
    "soon": RUN,
    "1763098200123": dt.datetime(2025, 11, 14, 5, 30, 0, 123000),
    " 1763098200 ": dt.datetime(2025, 11, 14, 5, 30),
    "176309820": RUN,
    "2025-11-14T05:30:00Z": dt.datetime(2025, 11, 14, 5, 30),
    "2025-11-14t05:30:00z": dt.datetime(2025, 11, 14, 5, 30),
    "2025-11-14T05:30:00+01:00": dt.datetime(2025, 11, 14, 4, 30),
    "2025-11-14T05:30:00-01:30:30": dt.datetime(2025, 11, 14, 7, 0, 30),
    "2025-11-14T05:30:00.123456789Z": dt.datetime(2025, 11, 14, 5, 30, 0, 123456),
    "2025-11-14T05:30:00.5+00:00": dt.datetime(2025, 11, 14, 5, 30, 0, 500000),
    "2025-11-14T24:00:00Z": dt.datetime(2025, 11, 15),
    "2025-12-31T23:59:60Z": dt.datetime(2025, 12, 31, 23, 59, 59),
    "2025-11-14T24:00:01Z": RUN,
    "2025-02-30T00:00:00Z": RUN,
    "2025-13-01T00:00:00Z": RUN,
    "2025-11-14T05:30:00+19:00": RUN,
    "2025-11-14T05:30:00+01:60": RUN,
    "2025-11-14": RUN,
    "2025-11-14T05:30:00": RUN,
    "2025-11-14T05:30Z": RUN,
    "14 Nov 2025": dt.datetime(2025, 11, 14),
    "4 Nov 2025": dt.datetime(2025, 11, 4),
    "004 Nov 2025": dt.datetime(2025, 11, 4),
    "Nov 14, 2025": dt.datetime(2025, 11, 14),
    "November 14, 2025": dt.datetime(2025, 11, 14),
    "14 November 2025": dt.datetime(2025, 11, 14),
    "31 Feb 2025": dt.datetime(2025, 2, 28),
    "31 Feb 2024": dt.datetime(2024, 2, 29),
    "31 April 2025": dt.datetime(2025, 4, 30),
    "32 Jan 2025": RUN,
    "0 Jan 2025": RUN,
    "1 Jan 0000": RUN,
    "14 nov 2025": RUN,
    "14 NOV 2025": RUN,
    "14 Novem 2025": RUN,
    "Nov 14 2025": RUN,
    "Updated 14 Nov 2025 at 5:30 PM": dt.datetime(2025, 11, 14),
    "Updated 14 November 2025": RUN,
    "Updated 14 May 2025": dt.datetime(2025, 5, 14),
    "x1 May 2025": dt.datetime(2025, 5, 1),
    "131 Jan 2025": dt.datetime(2025, 1, 31),
    "14 Nov 20256": dt.datetime(2025, 11, 14),
    "14 November 2025 or 5 May 2024": RUN,
    "Fri, 14 Nov 2025 10:00:00 GMT": dt.datetime(2025, 11, 14),
}


def test_parse_time_table(spark):
    got = parse_all(spark, list(CASES))
    assert dict(zip(CASES, got, strict=True)) == CASES


MONTHS = "January February March April May June July August September October November December".split()


def plain_parse(raw):
    """The decision list of the survey, said again without Spark (no epochs)."""
    text = raw.strip(" \t\n")
    short = [m[:3] for m in MONTHS]

    def day(y, m, d):
        if not 1 <= d <= 31 or y < 1:
            return None
        following = dt.date(y + m // 12, m % 12 + 1, 1)
        last = (following - dt.timedelta(days=1)).day
        return dt.datetime(y, m, min(d, last))

    for names in (short, MONTHS):
        if found := re.fullmatch(r"(\d{1,19}) (\w+) (\d{4})", text, re.A):
            if found[2] in names:
                return day(int(found[3]), names.index(found[2]) + 1, int(found[1])) or RUN
        if found := re.fullmatch(r"(\w+) (\d{1,19}), (\d{4})", text, re.A):
            if found[1] in names:
                return day(int(found[3]), names.index(found[1]) + 1, int(found[2])) or RUN
    if (found := re.search(r"(\d{1,2}) ([A-Za-z]{3,}) (\d{4})", text)) and found[2] in short:
        return day(int(found[3]), short.index(found[2]) + 1, int(found[1])) or RUN
    return RUN


def test_parse_time_on_generated_texts(spark):
    rng = random.Random(7)
    raws = []
    for _ in range(800):
        month = rng.choice(MONTHS)
        month = rng.choice([month, month[:3], month.lower(), month[:4]])
        day, year = rng.choice([str(rng.randint(0, 33)), f"{rng.randint(1, 31):03d}"]), rng.randint(1990, 2030)
        shape = rng.choice(["{d} {m} {y}", "{m} {d}, {y}", "On {d} {m} {y}.", "{m} {d} {y}", " {d} {m} {y}\n", "{d}{m}{y}"])
        raws.append(shape.format(d=day, m=month, y=year))
    assert parse_all(spark, raws) == [plain_parse(r) for r in raws]


def test_contains_digit(spark):
    samples = ["a1", "a", "", None, "1\n", "١", "1 ", "1\x0b"]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [r[0] for r in frame.orderBy("i").select(contains_digit(F.col("s"))).collect()]
    assert got == [True, False, False, False, False, False, False, True]


@pytest.mark.parametrize(
    ("attrs", "text", "want"),
    [
        ([("class", "x"), ("datetime", " 2025 ")], "t", "2025"),
        ([("id", "n1"), ("data-UPDATED", "2025")], "t", "2025"),
        ([("updated", "never"), ("x", "7")], "t", "7"),
        ([("date", "1\n2"), ("x", "none")], "at 5", "at 5"),
        ([("time", "a1"), ("date", "b2")], "t", "a1"),
        ([], "  14 Nov ", "14 Nov"),
        ([], "none", ""),
        ([("x", "y")], None, ""),
    ],
)
def test_time_attribute(spark, attrs, text, want):
    rows = [([{"k": k, "v": v} for k, v in attrs], text)]
    frame = spark.createDataFrame(rows, "attrs array<struct<k string, v string>>, text string")
    assert frame.select(time_attribute(F.col("attrs"), F.col("text"))).first()[0] == want


def test_iso_years_of_other_lengths(spark):
    raws = ["+12025-11-14T05:30:00Z", "-0044-03-15T12:00:00Z", "0000-01-01T00:00:00Z", "+2025-11-14T05:30:00Z", "+999999-01-01T00:00:00Z"]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    parsed = with_parsed_time(rows, "raw", F.lit(str(RUN)).cast("timestamp"), "at").orderBy("i")
    days = [r[0] for r in parsed.select(F.unix_seconds("at")).collect()]

    def seconds(year, month, day, clock):
        # 400 years are a whole number of days, so any year is like one that Python has.
        shift = (2000 - year) // 400 + 1
        at = dt.datetime(year + 400 * shift, month, day, tzinfo=dt.timezone.utc).timestamp() + clock
        return int(at) - shift * 146097 * 86400

    run = int(RUN.replace(tzinfo=dt.timezone.utc).timestamp())
    # A plus sign needs five digits; a year no timestamp can hold is the time of the run.
    assert days == [seconds(12025, 11, 14, 19800), seconds(-44, 3, 15, 43200), seconds(0, 1, 1, 0), run, run]
