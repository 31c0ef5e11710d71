"""Shards that all have the corpus's mixture of sources.

Rows of a source are put in a seeded random order; a row's place in it, divided by the
size of the source, is its fractional rank. All rows sorted by fractional rank run
through every source at an even pace, so cutting that order into equal parts gives
every shard each source's share, to within one row, and row counts at most one apart.

Places in an order are counted without one task or one group seeing all rows: the
rows are sorted by ranges, numbered within, and the ranges' sizes give the offsets. A
null source is a source of its own. Repeated rows are told apart by their place in a
written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dateline.session import broadcast_within, cut

SHARDS = 8
SEED = 20


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``at``: the row's place, from 0, in the given order, which must not tie.

    Runs a job that writes the sorted rows. One row per sorted range is broadcast.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = cut(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "order")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    placed = table.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("at", F.col("_offset") + within).drop("_id", "_part", "_offset")


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` and the columns in ``keep``. Runs jobs."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *keep,
    ).withColumn("row", F.monotonically_increasing_id())
    slim = cut(slim, "slim").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "row"))
    by_source = cut(numbered(slim, "source", "h", "row"), "ranked")
    sources = by_source.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sources = cut(sources, "sources").withColumnRenamed("source", "_source")
    width = F.coalesce(F.octet_length("_source"), F.lit(0)) + 48
    met = by_source.join(broadcast_within(sources, width), F.col("source").eqNullSafe(F.col("_source")))
    # Where in its first step a source begins, so that small sources do not all meet.
    phase = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / (1 << 20)
    paced = met.withColumn("pace", (F.col("at") - F.col("first") + phase) / F.col("n"))
    paced = paced.drop("at", "first", "n", "_source")
    total = slim.count()
    placed = numbered(paced, "pace", "source", "row").withColumn(
        "shard", F.expr(f"cast((at * {shards}) div {max(total, 1)} as int)")
    )
    begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("at") - begin).select(
        "doc_id", "source", "size", "text_crc32", "shard", "slot", *keep
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the texts as Parquet below ``path``, one folder a shard, in slot order."""
    rows = assigned(docs, shards, seed, ("text",))
    ordered = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
