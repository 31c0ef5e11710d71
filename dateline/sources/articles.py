"""Article files: JSON lines in, JSON lines, JSON and Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dateline.functions.text import batch_name, clean_body, domain_label, file_suffix, has_body, strip
from dateline.schemas import ARTICLE

_FIELDS = ARTICLE.fieldNames()
SUFFIX = "*.{jsonl,json}"  # what others and what Spark's own writer call JSON lines


def _lines(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    scan = spark.read.option("pathGlobFilter", suffix).text(paths)
    return scan.where(strip(F.col("value")) != "").select("value", F.input_file_name().alias("file"))


def _parsed(spark: SparkSession, paths: str | list[str], strict: bool, suffix: str) -> DataFrame:
    """Lines with ``keys``, a map of all their keys to text, null for a malformed line.

    The map comes out of a generator, below which no later filter goes, so that each line
    is parsed once.
    """
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    keys = F.from_json("value", T.MapType(T.StringType(), T.StringType()), mode)
    return _lines(spark, paths, suffix).select("value", "file", F.inline_outer(F.array(F.struct(keys.alias("keys")))))


def read_articles(
    spark: SparkSession, paths: str | list[str], strict: bool = False, suffix: str = SUFFIX
) -> DataFrame:
    """Articles with a body, cleaned, of all JSON-lines files in the folders.

    ``attrs`` holds every key of the line but ``body``, also keys outside the schema.
    ``strict`` fails on a malformed line; otherwise such lines are left to
    ``rejected_articles``.
    """
    parsed = _parsed(spark, paths, strict, suffix).where("keys is not null")
    attrs = F.map_filter("keys", lambda k, v: k != "body")
    return with_clean_body(
        parsed.select(
            *[F.col("keys")[name].alias(name) for name in _FIELDS],
            F.transform_values(attrs, lambda k, v: F.coalesce(v, F.lit("null"))).alias("attrs"),
            "file",
        )
    )


def rejected_articles(
    spark: SparkSession, paths: str | list[str], suffix: str = SUFFIX
) -> DataFrame:
    """Malformed lines with the file they are in."""
    parsed = _parsed(spark, paths, False, suffix)
    return parsed.where("keys is null").select("file", F.col("value").alias("line"))


def with_clean_body(articles: DataFrame) -> DataFrame:
    """Drop rows without a body and clean the others'."""
    return articles.where(has_body(F.col("body"))).withColumn("body", clean_body(F.col("body")))


def with_batch(articles: DataFrame, base_host: Column, run_ts: Column, fmt: str) -> DataFrame:
    """Add the run's ``batch`` name and the site's ``domain``."""
    domain = domain_label(base_host)
    return articles.withColumn("domain", domain).withColumn(
        "batch", batch_name(run_ts, domain, file_suffix(F.lit(fmt)))
    )


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Few files per output folder: small groups together, a hot one split."""
    return df.hint("rebalance", *keys) if keys else df


def write_jsonl(articles: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append one JSON object per article, in field order, nulls kept."""
    columns = [*_FIELDS, *partition_by]
    (
        _grouped(articles.select(*dict.fromkeys(columns)), list(partition_by))
        .write.mode("append")
        .option("ignoreNullFields", False)
        .option("encoding", "UTF-8")
        .partitionBy(*partition_by)
        .json(path)
    )


def write_batch(articles: DataFrame, path: str, base_host: Column, run_ts: Column) -> None:
    """Append a run's articles below its site's ``domain`` and its ``batch`` name."""
    write_jsonl(with_batch(articles, base_host, run_ts, "JSON"), path, ("domain", "batch"))


def write_json_by_id(articles: DataFrame, path: str) -> None:
    """Single-article access: JSON partitioned by the first two id characters."""
    keyed = articles.select(*_FIELDS).withColumn("prefix", F.substring("id", 1, 2))
    (
        _grouped(keyed, ["prefix"])
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .partitionBy("prefix")
        .json(path)
    )


def write_parquet(articles: DataFrame, path: str, partition_by: tuple[str, ...] = ("source",)) -> None:
    (
        _grouped(articles, list(partition_by))
        .write.mode("append")
        .partitionBy(*partition_by)
        .parquet(path)
    )
