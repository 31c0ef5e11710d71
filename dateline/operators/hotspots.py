"""Articles grouped by place and category.

A hotspot's article list is kept as rows, not as one array: a single place may hold a
third of all articles. Only bounded parts (the cards) are ever gathered.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.operators.ranking import first_per_group

# Categories with their display names, the cards of a panel, the header.
CATEGORIES = {
    "POLITICS": "Politics",
    "BUSINESS": "Business",
    "TECHNOLOGY": "Technology",
    "HEALTH": "Health",
    "WAR": "War",
}
PANEL_CARDS = 5
HEADER = "Breaking near "

KEY = ("lat", "lon", "category", "location")


def category_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "category string, display_name string")


def same_key(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> Column:
    """Equal keys, nulls equal to each other: a point outside all countries has one."""
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in key])


def hotspot_counts(articles: DataFrame) -> DataFrame:
    """One row per hotspot with its number of articles."""
    return articles.groupBy(*KEY).agg(F.count("*").alias("n_articles"))


def hotspots(articles: DataFrame, order: Sequence[Column], keep: int = PANEL_CARDS) -> DataFrame:
    """One row per hotspot: number of articles and the first ``keep`` in list order."""
    card = F.struct("rank", "title", "source", "url", "timestamp")
    top = (
        first_per_group(articles, KEY, order, keep, rank="rank")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(card)).alias("top"))
    )
    counts = hotspot_counts(articles)
    return counts.join(top, same_key(counts, top), "inner").select(*[counts[k] for k in KEY], "n_articles", "top")


def cards(articles: DataFrame, order: Sequence[Column], keep: int = PANEL_CARDS) -> DataFrame:
    """The panel of every hotspot: header and the first cards, numbered from 1."""
    first = first_per_group(articles, KEY, order, keep, rank="card")
    header = F.concat(F.lit(HEADER), F.col("location"))
    return first.select(*KEY, "card", header.alias("header"), "title", "source", "url")


def with_visibility(rows: DataFrame, categories: Collection[str]) -> DataFrame:
    """Flag the rows a category filter shows; no category selected shows all."""
    shown = F.col("category").isin(*categories) if categories else F.lit(True)
    return rows.withColumn("visible", F.coalesce(shown, F.lit(False)))


def without(rows: DataFrame, removed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows whose hotspot is not among the removed ones; a null in the key equals a null."""
    gone = removed.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [rows[k].eqNullSafe(gone[f"_{k}"]) for k in key]
    return rows.join(gone, same, "left_anti")


def clear_all(rows: DataFrame) -> DataFrame:
    """No hotspots, with the columns they had."""
    return rows.limit(0)


def majority(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The commonest label of each group (ties: the smallest), with its count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return first_per_group(counts, [group], [F.col("n").desc(), F.col(label)])
