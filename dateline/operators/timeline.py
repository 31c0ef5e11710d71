"""Slots of the timeline: the latest two hours, and earlier ones to browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "2 hours"


def slots(rows: DataFrame, ts: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows per slot and key; ``slide`` shorter than a slot makes slots overlap."""
    window = F.window(ts, SLOT, slide) if slide else F.window(ts, SLOT)
    return (
        rows.groupBy(window.alias("slot"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("slot.start").alias("slot_start"), F.col("slot.end").alias("slot_end"), *keys, "n")
    )


def latest_slot(rows: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """Rows of the two hours up to ``as_of``."""
    return rows.where((F.col(ts) > as_of - F.expr(f"interval {SLOT}")) & (F.col(ts) <= as_of))
