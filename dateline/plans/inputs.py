"""Tables the queries start from: the given ones, and inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.text import host_of
from dateline.session import spread
from dateline.sources.pages import read_pages

RUN_TIME = "2026-01-02 03:04:05"
AGENT = "dateline/1.0"


def run_ts() -> Column:
    return F.lit(RUN_TIME).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_pages(spark, f"{folder}/pages.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hosts(page_table: DataFrame) -> DataFrame:
    return page_table.select(host_of(F.col("url")).alias("host")).distinct()


def site_configs(page_table: DataFrame) -> DataFrame:
    """One configuration per host; the link selector depends on the host's first label."""
    selector = (
        F.when(F.col("host").startswith("m."), "a[href^='/t']")
        .when(F.col("host").startswith("www."), "li > a[href*=th]")
        .when(F.col("host").startswith("blog."), "a[href~=^/[A-Z]]")
        .otherwise("nav > ul > li > a[href]")
    )
    return hosts(page_table).select(
        F.concat(F.lit("https://"), "host").alias("baseUrl"),
        F.array(F.lit("nav > ul > li > a[href]")).alias("topicSelectors"),
        F.array(selector).alias("articleSelectors"),
        F.lit("h1").alias("articleTitle"),
        F.lit("time[datetime]").alias("articleTime"),
        F.lit("article > p").alias("articleBody"),
        F.lit(3).alias("maxDepth"),
    )


def robots_texts(page_table: DataFrame) -> DataFrame:
    """Robots text per host; hosts below ``.org`` have none."""
    text = (
        F.when(F.col("host").endswith(".org"), F.lit(None))
        .when(F.col("host").startswith("m."), "User-agent: *\nDisallow: /\n")
        .when(
            F.col("host").startswith("www."),
            "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /th # no\nAllow: /the\n",
        )
        .when(
            F.col("host").startswith("blog."),
            "user-agent: *\ndisallow: /a\n\nUser-Agent: Dateline\nDisallow: /*e$\nAllow: /w*re$\n",
        )
        .otherwise("User-agent: *\nDisallow:\n")
    )
    return hosts(page_table).select("host", text.alias("txt"))


def borders(nations: DataFrame) -> DataFrame:
    """Invented borders on a grid of five by five, one or two features per nation.

    By key: a triangle; a rectangle with a hole, unclosed; a concave ring; two parts.
    Every fifth nation is covered once more by a later feature (the first one wins),
    every seventh has no name, every eleventh an empty polygon ahead of its own.
    """
    key = F.col("n_nationkey")
    west = (key % 5) * 70.0 - 175.0
    south = F.floor(key / 5) * 34.0 - 85.0

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[F.array(west + dx, south + dy) for dx, dy in corners])

    triangle = ring((0.5, 0.5), (60.25, 3.5), (30.0, 31.75), (0.5, 0.5))
    box = ring((1.0, 1.0), (55.0, 1.0), (55.0, 30.0), (1.0, 30.0))
    hole = ring((10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0))
    concave = ring((0.0, 0.0), (58.5, 0.0), (58.5, 30.0), (29.0, 8.25), (0.0, 30.0), (0.0, 0.0))
    left = ring((0.0, 0.0), (20.0, 0.0), (20.0, 28.5), (0.0, 28.5), (0.0, 0.0))
    right = ring((35.5, 5.0), (64.0, 12.0), (40.0, 31.0), (35.5, 5.0))
    empty = F.expr("cast(array() as array<array<array<double>>>)")
    shape = (
        F.when(key % 4 == 0, F.array(F.array(triangle)))
        .when(key % 4 == 1, F.array(F.array(box, hole)))
        .when(key % 4 == 2, F.array(F.array(concave)))
        .otherwise(F.array(F.array(left), F.array(right)))
    )
    polys = F.when(key % 11 == 0, F.concat(F.array(empty), shape)).otherwise(shape)
    name = F.when(key % 7 == 6, F.lit("Unknown")).otherwise(F.initcap("n_name"))
    own = nations.select(key.cast("int").alias("feature_idx"), name.alias("name"), polys.alias("polys"))
    cover = nations.where(key % 5 == 0).select(
        (key + 100).cast("int").alias("feature_idx"),
        F.concat(F.lit("Greater "), F.initcap("n_name")).alias("name"),
        F.array(F.array(ring((-3.0, -3.0), (66.0, -3.0), (66.0, 33.0), (-3.0, 33.0)))).alias("polys"),
    )
    return own.unionByName(cover)


# The same borders for the checking SQL: feature, part and vertices in order.
SQL_EDGES = """
rings AS (
  SELECT n_nationkey AS key, n_nationkey AS feature_idx,
         CASE WHEN n_nationkey % 7 = 6 THEN 'Unknown'
              ELSE upper(n_name[1:1]) || lower(substr(n_name, 2)) END AS name,
         (CASE WHEN n_nationkey % 11 = 0 THEN 1 ELSE 0 END) AS part,
         CASE n_nationkey % 4
           WHEN 0 THEN [[0.5, 0.5], [60.25, 3.5], [30.0, 31.75], [0.5, 0.5]]
           WHEN 1 THEN [[1.0, 1.0], [55.0, 1.0], [55.0, 30.0], [1.0, 30.0]]
           WHEN 2 THEN [[0.0, 0.0], [58.5, 0.0], [58.5, 30.0], [29.0, 8.25], [0.0, 30.0], [0.0, 0.0]]
           ELSE [[0.0, 0.0], [20.0, 0.0], [20.0, 28.5], [0.0, 28.5], [0.0, 0.0]] END AS ring
  FROM nation
  UNION ALL
  SELECT n_nationkey, n_nationkey,
         CASE WHEN n_nationkey % 7 = 6 THEN 'Unknown'
              ELSE upper(n_name[1:1]) || lower(substr(n_name, 2)) END,
         (CASE WHEN n_nationkey % 11 = 0 THEN 2 ELSE 1 END),
         [[35.5, 5.0], [64.0, 12.0], [40.0, 31.0], [35.5, 5.0]]
  FROM nation WHERE n_nationkey % 4 = 3
  UNION ALL
  SELECT n_nationkey, n_nationkey + 100, 'Greater ' || upper(n_name[1:1]) || lower(substr(n_name, 2)), 0,
         [[-3.0, -3.0], [66.0, -3.0], [66.0, 33.0], [-3.0, 33.0]]
  FROM nation WHERE n_nationkey % 5 = 0),
vertices AS (
  SELECT key, feature_idx, name, part, len(ring) AS n, unnest(range(len(ring))) AS i, ring FROM rings),
edges AS (
  SELECT feature_idx, name, part, i AS edge,
         (key % 5) * 70.0::DOUBLE - 175.0 + ring[i + 1][1]::DOUBLE AS lon_a,
         (key // 5) * 34.0::DOUBLE - 85.0 + ring[i + 1][2]::DOUBLE AS lat_a,
         (key % 5) * 70.0::DOUBLE - 175.0 + ring[(i + 1) % n + 1][1]::DOUBLE AS lon_b,
         (key // 5) * 34.0::DOUBLE - 85.0 + ring[(i + 1) % n + 1][2]::DOUBLE AS lat_b
  FROM vertices)"""


def event_points(rows: DataFrame) -> DataFrame:
    """Each event at a place computed from its id with whole numbers."""
    return rows.withColumn("lon", F.col("event_id") * 7919 % 36000 / 100.0 - 180.0).withColumn(
        "lat", F.col("event_id") * 104729 % 18000 / 100.0 - 90.0
    )


SQL_POINTS = """
points AS (
  SELECT *, (event_id * 7919 % 36000) / 100.0::DOUBLE - 180.0 AS lon,
            (event_id * 104729 % 18000) / 100.0::DOUBLE - 90.0 AS lat
  FROM events)"""

EVENT_CATEGORIES = {
    "signup": "POLITICS",
    "error": "WAR",
    "click": "BUSINESS",
    "view": "TECHNOLOGY",
    "purchase": "HEALTH",
}


def event_articles(rows: DataFrame) -> DataFrame:
    """Events as placed articles: forty places, five categories."""
    category = F.lit(None).cast("string")
    for kind, name in EVENT_CATEGORIES.items():
        category = F.when(F.col("event_type") == kind, name).otherwise(category)
    place = F.col("user_id") % 40
    return rows.select(
        "event_id",
        (place * 4.0 - 80.0).alias("lat"),
        (place * 9.0 - 180.0).alias("lon"),
        category.alias("category"),
        F.concat(F.lit("Place "), place).alias("location"),
        F.concat(F.lit("Story "), "event_id").alias("title"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"),
        F.concat(F.lit("https://news.example.com/"), "event_id").alias("url"),
        F.unix_millis("ts").alias("timestamp"),
        "ts",
    )


SQL_ARTICLES = """
placed AS (
  SELECT event_id, (user_id % 40) * 4.0::DOUBLE - 80.0 AS lat, (user_id % 40) * 9.0::DOUBLE - 180.0 AS lon,
         CASE event_type WHEN 'signup' THEN 'POLITICS' WHEN 'error' THEN 'WAR' WHEN 'click' THEN 'BUSINESS'
                         WHEN 'view' THEN 'TECHNOLOGY' WHEN 'purchase' THEN 'HEALTH' END AS category,
         'Place ' || (user_id % 40) AS location, 'Story ' || event_id AS title,
         'src' || (user_id % 20) AS source, 'https://news.example.com/' || event_id AS url,
         epoch_us(ts) // 1000 AS "timestamp", ts
  FROM events)"""


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
