"""Pages stand in for fetching: a URL without a row is a failed fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dateline.session import spread


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``url`` and ``html``, spread over the cores."""
    return spread(spark.read.parquet(path))


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``urls`` with their page; failed fetches drop out."""
    return urls.join(pages, "url")


def failed(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``urls`` without a page."""
    return urls.join(pages.select("url"), "url", "left_anti")
