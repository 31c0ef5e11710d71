"""Article and event streams: file source, duplicates, timeline slots."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dateline.functions.text import TIME_FORMAT
from dateline.operators.timeline import slots
from dateline.schemas import ARTICLE
from dateline.session import scratch_path

LATENESS = "1 day"


def article_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Articles of every run's JSON-lines files, with ``publish_ts`` and ``crawled_ts``.

    A time that cannot be read is null; see ``undated``. Files are taken in the order of
    their modification times, so with ``files_per_trigger`` these decide what is late.
    """
    reader = spark.readStream.schema(ARTICLE).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(folder)
    return rows.withColumn("publish_ts", F.try_to_timestamp("publishTime", F.lit(TIME_FORMAT))).withColumn(
        "crawled_ts", F.try_to_timestamp("crawledAt", F.lit(TIME_FORMAT))
    )


def table_stream(spark: SparkSession, folder: str, files: str, schema: T.StructType) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def without_repeats(rows: DataFrame, key: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """First row per key; the key is remembered until the watermark has passed it.

    Rows without a key are known by their body, if they have that column. Rows later than
    the watermark are dropped by Spark; ``run_available`` counts them and ``left_out``
    finds them. Rows without a time are left to ``undated``.
    """
    body = F.col("body") if "body" in rows.columns else F.lit(None).cast("string")
    known = F.struct(F.col(key).alias("key"), F.when(F.col(key).isNull(), body).alias("body"))
    dated = rows.where(F.col(ts).isNotNull()).withColumn("_known", known)
    return dated.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["_known"]).drop("_known")


def undated(rows: DataFrame, ts: str) -> DataFrame:
    """Rows whose time is missing or cannot be read; to be kept in a table of their own."""
    return rows.where(F.col(ts).isNull())


def left_out(rows: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Rows of the stream's input, read as a table, whose key was never emitted: late ones."""
    seen = emitted.select(F.col(key).alias("_seen")).distinct()
    return rows.join(seen, rows[key].eqNullSafe(seen["_seen"]), "left_anti")


def slot_counts(rows: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Timeline slots of a watermarked stream; a slot is final when it is emitted."""
    return slots(rows, ts, *keys)


def run_available(
    stream: DataFrame, name: str, mode: str = "append", dropped: list[int] | None = None
) -> DataFrame:
    """Process all files present, then return what was emitted (runs the stream).

    ``dropped`` gets the number of late rows the watermark has dropped in each batch.

    Output and state go to the shared folder, so a lost executor costs a retry only.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if dropped is not None:
        dropped += [
            sum(int(op["numRowsDroppedByWatermark"]) for op in progress["stateOperators"])
            for progress in (json.loads(p.json) for p in query.recentProgress)
        ]
    try:
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)  # no files, so no output
