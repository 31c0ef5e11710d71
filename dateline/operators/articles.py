"""Stored articles: duplicates, expiry and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.operators.ranking import first_per_group


def latest(articles: DataFrame, key: str = "id", crawled: str = "crawledAt", *ties: str) -> DataFrame:
    """One row per id: the latest crawl wins, then the tie columns in ascending order.

    An article without an id is known by its body. A hash of the whole row breaks what
    ties remain, so the result does not depend on the order of rows.
    """
    body = F.col("body") if "body" in articles.columns else F.lit(None).cast("string")
    known = articles.withColumn("_known", F.struct(F.col(key).alias("id"), F.when(F.col(key).isNull(), body).alias("body")))
    plain = [F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in articles.dtypes]
    order = [F.col(crawled).desc(), *[F.col(t) for t in ties], F.xxhash64(*plain)]
    return first_per_group(known, ["_known"], order).drop("_known")


def live(articles: DataFrame, as_of: Column, crawled: str = "crawled_ts") -> DataFrame:
    """Articles crawled within the day before ``as_of``; older ones have expired."""
    age = F.expr("interval 1 day")
    return articles.where((F.col(crawled) > as_of - age) & (F.col(crawled) <= as_of))


def headline_view(articles: DataFrame, publish_ts: Column) -> DataFrame:
    """What the globe shows of an article: title, source, url, epoch milliseconds."""
    return articles.select("title", "source", "url", F.unix_millis(publish_ts).alias("timestamp"))
