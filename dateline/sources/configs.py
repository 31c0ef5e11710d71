"""Site configurations: what to follow and what to read on each site."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.text import host_of
from dateline.operators.selectors import compiled
from dateline.schemas import SITE_CONFIG
from dateline.sources.json_rows import with_parsed

_FIELDS = SITE_CONFIG.fieldNames()


# Where configurations are looked for when no folder is given.
DEFAULT_FOLDER = "configs"

_USABLE = "_corrupt_record is null and baseUrl is not null"


def _scan(spark: SparkSession, folder: str | None) -> DataFrame:
    """One row per ``*.json`` file with its text and what could be read of it."""
    try:
        texts = (
            spark.read.option("pathGlobFilter", "*.json")
            .text(folder or DEFAULT_FOLDER, wholetext=True)
            .withColumn("file", F.input_file_name())
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no configuration folder {folder or DEFAULT_FOLDER}", stacklevel=3)
        texts = spark.createDataFrame([], "value string, file string")
    return with_parsed(texts, "value", SITE_CONFIG)


def read_site_configs(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """One row per readable ``*.json`` file of ``folder``; other files are ignored.

    A missing folder gives no rows and a warning.
    """
    return _scan(spark, folder).where(_USABLE).select(*_FIELDS, "file")


def rejected_site_configs(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Files that are not a site configuration, with their text."""
    return _scan(spark, folder).where(f"not ({_USABLE})").select("file", F.col("value").alias("text"))


def _compiled(configs: DataFrame) -> DataFrame:
    """Sites with compiled selectors, and ``_usable`` unless one cannot be compiled."""
    lists = {"topics": "topicSelectors", "links": "articleSelectors"}
    singles = {"title": "articleTitle", "time": "articleTime", "body": "articleBody"}
    exploded = configs.select(
        F.col("baseUrl").alias("site"),
        host_of(F.col("baseUrl")).alias("host"),
        F.col("maxDepth").alias("max_depth"),
        *[compiled(F.col(source)).alias(name) for name, source in lists.items()],
        *[F.get(compiled(F.array(source)), 0).alias(name) for name, source in singles.items()],
    )
    usable = F.lit(True)
    for name in lists:
        usable = usable & F.forall(name, lambda steps: steps.isNotNull())
    for name in singles:
        usable = usable & F.col(name).isNotNull()
    return exploded.withColumn("_usable", F.coalesce(usable, F.lit(False)))


def rejected_sites(configs: DataFrame, rules: DataFrame) -> DataFrame:
    """``site, host, reason`` of the configurations that ``site_table`` leaves out."""
    known = rules.select(F.col("host").alias("_host")).distinct()
    sites = _compiled(configs).join(known, F.col("host") == F.col("_host"), "left")
    reason = F.when(~F.col("_usable"), "selector").when(F.col("_host").isNull(), "robots")
    return sites.select("site", "host", reason.alias("reason")).where("reason is not null")


def site_table(configs: DataFrame, rules: DataFrame) -> DataFrame:
    """Configurations with compiled selectors and the robots rules of their host.

    A site without a robots row, or with a selector that cannot be compiled, is left
    out; ``rejected_sites`` lists these. The key ``site`` is the base URL; ``host`` becomes the articles' source.
    ``rules`` comes from ``sources.robots.robots_rules``.
    """
    return _compiled(configs).where("_usable").drop("_usable").join(rules, "host")
