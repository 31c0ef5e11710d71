"""Times: attributes, date styles, timeline slots, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.text import time_text
from dateline.functions.times import time_attribute, with_parsed_time
from dateline.operators.timeline import latest_slot, slots
from dateline.plans import inputs
from dateline.streaming.feeds import run_available, slot_counts, table_stream, without_repeats


def time_attributes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")

    def attrs(*pairs: tuple[str, Column | str]) -> Column:
        return F.array(
            *[F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.lit(v)).alias("v")) for k, v in pairs]
        )

    cases = [
        attrs(("class", "stamp"), ("DateTime", F.concat(F.lit(" "), day, F.lit("\t")))),
        attrs(("id", F.concat(F.lit("n"), key)), ("data-published", day)),
        attrs(("updated", "never"), ("data-x", key.cast("string"))),
        attrs(("class", "plain")),
        attrs(("datetime", F.concat(day, F.lit("\n"), day)), ("title", "none")),
        attrs(("timestamp", "soon"), ("class", "x"), ("date", day), ("time", key.cast("string"))),
        F.expr("cast(array() as array<struct<k: string, v: string>>)"),
        attrs(("lang", "en"), ("data-count", F.concat(F.lit("  "), key))),
    ]
    chosen = cases[-1]
    for i, case in enumerate(cases[:-1]):
        chosen = F.when(key % 8 == i, case).otherwise(chosen)
    text = F.when(key % 3 == 0, F.concat(F.lit("Updated "), day)).otherwise("no date")
    rows = inputs.events(spark, folder).select("event_id", chosen.alias("attrs"), text.alias("text"))
    return rows.select("event_id", time_attribute(F.col("attrs"), F.col("text")).alias("raw"))


_SHAPES = 14


def smart_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    ts, key = F.col("ts"), F.col("event_id")
    clock = F.date_format(ts, "HH:mm:ss")
    day = F.date_format(ts, "yyyy-MM-dd")
    shapes = [
        F.unix_millis(ts).cast("string"),
        F.unix_seconds(ts).cast("string"),
        F.concat(day, F.lit("T"), clock, F.lit("Z")),
        F.concat(day, F.lit("t"), clock, F.lit(".25+01:30")),
        F.date_format(ts, "d MMM yyyy"),
        F.date_format(ts, "MMM d, yyyy"),
        F.date_format(ts, "MMMM d, yyyy"),
        F.concat(F.lit("Updated "), F.date_format(ts, "d MMM yyyy"), F.lit(" at 5:30 PM")),
        F.date_format(ts, "  dd MMMM yyyy "),
        F.concat(day, F.lit("T"), clock),
        F.date_format(ts, "'31 Feb' yyyy"),
        F.lower(F.date_format(ts, "d MMM yyyy")),
        F.concat(F.lit("Updated "), F.date_format(ts, "d MMMM yyyy")),
        F.lit(""),
    ]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(key % _SHAPES == i, shape).otherwise(raw)
    rows = inputs.events(spark, folder).select("event_id", raw.alias("raw"))
    timed = with_parsed_time(rows, "raw", inputs.run_ts(), "at")
    return timed.select("event_id", "raw", time_text(F.col("at")).alias("at"))


def _slot_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slot_start", time_text(F.col("slot_start"))).withColumn(
        "slot_end", time_text(F.col("slot_end"))
    )


def timeline_2h(spark: SparkSession, folder: str) -> DataFrame:
    return _slot_text(slots(inputs.events(spark, folder), "ts", "event_type"))


def timeline_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _slot_text(slots(inputs.events(spark, folder), "ts", "event_type", slide="30 minutes"))


def timeline_asof(spark: SparkSession, folder: str) -> DataFrame:
    as_of = F.lit("2024-01-15 13:45:00").cast("timestamp")
    return latest_slot(inputs.events(spark, folder), "ts", as_of).select("event_id", "event_type", "value")


def stream_dedup_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Two-hour counts as a stream emits them: only slots the watermark has closed."""
    schema = inputs.table(spark, folder, "events").schema
    stream = table_stream(spark, folder, "events.parquet", schema)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = slot_counts(without_repeats(timed, "event_id", "ts"), "ts", "event_type")
    return _slot_text(run_available(counts, "slots"))


QUERIES = {
    "time_attribute": time_attributes,
    "smart_timestamp": smart_timestamps,
    "timeline_2h": timeline_2h,
    "timeline_sliding": timeline_sliding,
    "timeline_asof": timeline_asof,
    "stream_dedup_timeline": stream_dedup_timeline,
}

_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _slots(condition: str = "true") -> str:
    return f"""
SELECT strftime(s, {_STAMP}) AS slot_start, strftime(s + INTERVAL 2 HOUR, {_STAMP}) AS slot_end, event_type, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') AS s FROM events)
WHERE {condition} GROUP BY s, event_type"""


SQL = {
    "time_attribute": """
WITH listed AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d') AS d,
         CASE WHEN event_id % 3 = 0 THEN 'Updated ' || strftime(ts, '%Y-%m-%d') ELSE 'no date' END AS text
  FROM events)
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN event_id::VARCHAR WHEN 5 THEN d WHEN 7 THEN event_id::VARCHAR
  ELSE CASE WHEN event_id % 3 = 0 THEN text ELSE '' END END AS raw
FROM listed""",
    "smart_timestamp": f"""
SELECT event_id, raw, strftime(CASE k
  WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts
  WHEN 3 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE
  WHEN 9 THEN run WHEN 11 THEN run WHEN 13 THEN run
  WHEN 10 THEN make_timestamp(year(ts), 3, 1, 0, 0, 0.0) - INTERVAL 1 DAY
  WHEN 12 THEN CASE WHEN month(ts) = 5 THEN date_trunc('day', ts) ELSE run END
  ELSE date_trunc('day', ts) END, {_STAMP}) AS at
FROM (SELECT event_id, ts, TIMESTAMP '{inputs.RUN_TIME}' AS run, event_id % {_SHAPES} AS k,
  CASE event_id % {_SHAPES}
    WHEN 0 THEN (epoch_us(ts) // 1000)::VARCHAR
    WHEN 1 THEN (epoch_us(ts) // 1000000)::VARCHAR
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 3 THEN strftime(ts, '%Y-%m-%dt%H:%M:%S.25+01:30')
    WHEN 4 THEN strftime(ts, '%-d %b %Y')
    WHEN 5 THEN strftime(ts, '%b %-d, %Y')
    WHEN 6 THEN strftime(ts, '%B %-d, %Y')
    WHEN 7 THEN strftime(ts, 'Updated %-d %b %Y at 5:30 PM')
    WHEN 8 THEN strftime(ts, '  %d %B %Y ')
    WHEN 9 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 10 THEN strftime(ts, '31 Feb %Y')
    WHEN 11 THEN lower(strftime(ts, '%-d %b %Y'))
    WHEN 12 THEN strftime(ts, 'Updated %-d %B %Y')
    ELSE '' END AS raw
  FROM events)""",
    "timeline_2h": _slots(),
    "timeline_sliding": f"""
SELECT strftime(s, {_STAMP}) AS slot_start, strftime(s + INTERVAL 2 HOUR, {_STAMP}) AS slot_end, event_type, count(*) AS n
FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2024-01-01') - INTERVAL (30 * i) MINUTE AS s
      FROM events, range(4) r(i))
GROUP BY s, event_type""",
    "timeline_asof": """
SELECT event_id, event_type, value FROM events
WHERE ts > TIMESTAMP '2024-01-15 11:45:00' AND ts <= TIMESTAMP '2024-01-15 13:45:00'""",
    "stream_dedup_timeline": _slots(
        "s + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"
    ),
}
