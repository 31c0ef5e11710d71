"""Places: sphere arithmetic, borders, countries, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.geo import (
    clamp,
    hotspot_anchor,
    latlon_to_point,
    length,
    point_to_latlon,
    round2,
)
from dateline.operators.countries import border_edges, country_counts, country_grid, with_country
from dateline.operators.hotspots import cards, category_names, hotspot_counts, hotspots, majority, with_visibility, without
from dateline.plans import inputs
from dateline.session import scratch_path
from dateline.sources.geojson import read_features

ORDER = ("timestamp", "event_id")
#: Features that the reader leaves out: no geometry, another one, and one without coordinates.
NO_SHAPE = (
    ',{"type":"Feature","properties":{"name_en":"none"},"geometry":null}'
    ',{"type":"Feature","properties":{"name_en":"spot"},"geometry":{"type":"Point","coordinates":[1.5,2.5]}}'
    ',{"type":"Feature","properties":{"name_en":"bare"},"geometry":{"type":"Polygon"}}'
)


def _order() -> list[Column]:
    return [F.col(name) for name in ORDER]


def _six(value: Column) -> Column:
    return F.round(value, 6) + 0.0


def latlon_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.event_points(inputs.events(spark, folder))
    point, anchor = latlon_to_point(F.col("lat"), F.col("lon")), hotspot_anchor(F.col("lat"), F.col("lon"))
    return rows.select("event_id", point.alias("p"), anchor.alias("a")).select(
        "event_id",
        *[_six(F.col(f"p.{axis}")).alias(axis) for axis in "xyz"],
        *[_six(F.col(f"a.{axis}")).alias(f"anchor_{axis}") for axis in "xyz"],
        _six(length(F.col("a"))).alias("height"),
    )


def point_latlons(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.event_points(inputs.events(spark, folder))
    point = latlon_to_point(F.col("lat"), F.col("lon"))
    back = point_to_latlon(F.col("p"))
    return rows.select("event_id", point.alias("p")).select("event_id", back.alias("b")).select(
        "event_id", _six(F.col("b.lat")).alias("lat"), _six(F.col("b.lon")).alias("lon")
    )


def math_scalars(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value") - 10
    return inputs.events(spark, folder).select(
        "event_id", clamp(value, -2.5, 15).alias("clamped"), round2(value / 8).alias("rounded")
    )


def _borders(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.borders(inputs.table(spark, folder, "nation"))


def ring_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = border_edges(_borders(spark, folder), 300.5)
    return edges.withColumn("length", _six(F.col("length")))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    grid = country_grid(_borders(spark, folder))
    return with_country(inputs.event_points(inputs.events(spark, folder)), grid)


def country_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select("event_id", "country")


def countries(spark: SparkSession, folder: str) -> DataFrame:
    return country_counts(_placed(spark, folder))


def country_filter(spark: SparkSession, folder: str) -> DataFrame:
    placed = _placed(spark, folder).where(F.col("country").isin("Greater Algeria", "Canada", "Unknown"))
    return placed.select("event_id", "country", "event_type")


def geojson_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Borders written as one GeoJSON file per region, read back as features."""
    path = scratch_path(spark, "geojson")
    nations = inputs.table(spark, folder, "nation")
    single = F.size("polys") == 1
    geometry = F.when(
        single,
        F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.col("polys")[0]), F.lit("}")),
    ).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json("polys"), F.lit("}")))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.when(F.col("name") == "Unknown", F.lit("{}")).otherwise(F.to_json(F.struct(F.col("name").alias("name_en")))),
        F.lit(',"geometry":'),
        geometry,
        F.lit("}"),
    )
    borders = inputs.borders(nations).select(
        "feature_idx", (F.col("feature_idx") % 100).alias("n_nationkey"), feature.alias("feature")
    )
    # The nations of one region: a fixed handful of features.
    files = (
        borders.join(nations, "n_nationkey")
        .groupBy("n_regionkey")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature_idx", "feature"))), lambda f: f["feature"]), ",").alias("features"))
        .select("n_regionkey", F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit(NO_SHAPE + "]}")).alias("value"))
    )
    files.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    features = read_features(spark, path)
    region = F.regexp_extract("file", "n_regionkey=([0-9]+)", 1).cast("int")
    polys = features.select(region.alias("region"), "feature_idx", "name", F.posexplode("polys").alias("part", "poly"))
    return polys.select(
        "region",
        "feature_idx",
        "name",
        "part",
        F.size("poly").cast("long").alias("n_rings"),
        F.try_element_at("poly", F.lit(1))[0][0].alias("lon"),
        F.try_element_at("poly", F.lit(1))[0][1].alias("lat"),
    )


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.event_articles(inputs.events(spark, folder))


def hotspot_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = hotspots(_articles(spark, folder), _order())
    top = F.array_join(F.transform("top", lambda c: c["title"]), " | ")
    return groups.select("lat", "lon", "category", "location", "n_articles", top.alias("top"))


def hotspot_cards(spark: SparkSession, folder: str) -> DataFrame:
    return cards(_articles(spark, folder), _order())


def category_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_visibility(_articles(spark, folder), ["POLITICS", "WAR"])
    counts = rows.groupBy("category", "visible").agg(F.count("*").alias("n"))
    return counts.join(category_names(spark), "category", "left")


def hotspot_remove(spark: SparkSession, folder: str) -> DataFrame:
    groups = hotspot_counts(_articles(spark, folder))
    return without(groups, groups.where("n_articles % 2 = 0"))


def place_category(spark: SparkSession, folder: str) -> DataFrame:
    return majority(_articles(spark, folder), "location", "category")


QUERIES = {
    "latlon_point": latlon_points,
    "point_latlon": point_latlons,
    "math_scalars": math_scalars,
    "ring_edges": ring_edges,
    "country_lookup": country_lookup,
    "country_counts": countries,
    "country_filter": country_filter,
    "geojson_scan": geojson_scan,
    "hotspot_groups": hotspot_groups,
    "hotspot_cards": hotspot_cards,
    "category_filter": category_filter,
    "hotspot_remove": hotspot_remove,
    "place_category": place_category,
}


def _point(radius: float, lat: str = "lat", lon: str = "lon") -> list[str]:
    phi, lam = f"radians({lat})", f"radians({lon})"
    return [
        f"({radius} * cos({phi}) * cos({lam}))",
        f"(-{radius} * sin({phi}))",
        f"({radius} * cos({phi}) * sin({lam}))",
    ]


def _round(value: str) -> str:
    return f"round({value}, 6) + 0.0"


_P, _A = _point(300.0), _point(302.5)
_EDGE = " + ".join(
    f"pow({b} - {a}, 2)" for a, b in zip(_point(300.5, "lat_a", "lon_a"), _point(300.5, "lat_b", "lon_b"), strict=True)
)
# The ring's edge from vertex i-1 to i, as the crossing test takes it.
_COUNTRY = f"""
{inputs.SQL_EDGES},
{inputs.SQL_POINTS},
hits AS (
  SELECT event_id, feature_idx, part, min(name) AS name, count(*) AS crossings
  FROM points, edges
  WHERE (lat_b > lat) <> (lat_a > lat)
    AND lon < (lon_a - lon_b) * (lat - lat_b) / (lat_a - lat_b) + lon_b
  GROUP BY event_id, feature_idx, part),
located AS (
  SELECT event_id, arg_min(name, feature_idx) AS country FROM hits WHERE crossings % 2 = 1 GROUP BY event_id),
placed AS (SELECT events.*, country FROM events LEFT JOIN located USING (event_id))"""

SQL = {
    "latlon_point": f"""
WITH {inputs.SQL_POINTS}
SELECT event_id, {", ".join(f'{_round(v)} AS {n}' for v, n in zip(_P, "xyz", strict=True))},
       {", ".join(f'{_round(v)} AS anchor_{n}' for v, n in zip(_A, "xyz", strict=True))}, 302.5::DOUBLE AS height
FROM points""",
    "point_latlon": f"""
WITH {inputs.SQL_POINTS},
p AS (SELECT event_id, {", ".join(f'{v} AS {n}' for v, n in zip(_P, "xyz", strict=True))} FROM points)
SELECT event_id, {_round("-degrees(asin(y / 300.0))")} AS lat, {_round("degrees(atan2(z, x))")} AS lon FROM p""",
    "math_scalars": """
SELECT event_id, greatest(-2.5::DOUBLE, least(15.0::DOUBLE, value - 10)) AS clamped,
       floor((value - 10) / 8 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS rounded FROM events""",
    "ring_edges": f"""
WITH {inputs.SQL_EDGES}
SELECT '' AS file, feature_idx, part::INTEGER AS part, edge::INTEGER AS edge, lon_a, lat_a, lon_b, lat_b, {_round(f'sqrt({_EDGE})')} AS length FROM edges""",
    "country_lookup": f"WITH {_COUNTRY} SELECT event_id, country FROM placed",
    "country_counts": f"WITH {_COUNTRY} SELECT country, count(*) AS n FROM placed WHERE country IS NOT NULL GROUP BY country",
    "country_filter": f"""
WITH {_COUNTRY}
SELECT event_id, country, event_type FROM placed WHERE country IN ('Greater Algeria', 'Canada', 'Unknown')""",
    "geojson_scan": f"""
WITH {inputs.SQL_EDGES},
parts AS (SELECT key % 100 AS nation, feature_idx, name, part, CASE WHEN feature_idx < 100 AND key % 4 = 1 THEN 2 ELSE 1 END AS n_rings,
                 (key % 5) * 70.0::DOUBLE - 175.0 + ring[1][1]::DOUBLE AS lon, (key // 5) * 34.0::DOUBLE - 85.0 + ring[1][2]::DOUBLE AS lat
          FROM rings
          UNION ALL
          SELECT n_nationkey, n_nationkey, min(name), 0, 0, NULL, NULL FROM nation JOIN rings ON key = n_nationkey AND feature_idx = n_nationkey
          WHERE n_nationkey % 11 = 0 GROUP BY n_nationkey),
numbered AS (SELECT *, (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY feature_idx) - 1)::INTEGER AS pos
             FROM parts JOIN nation ON n_nationkey = nation)
SELECT n_regionkey AS region, pos AS feature_idx, name, part::INTEGER AS part, n_rings::BIGINT AS n_rings, lon, lat FROM numbered""",
    "hotspot_groups": f"""
WITH {inputs.SQL_ARTICLES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lat, lon, category, location ORDER BY "timestamp", event_id) AS k FROM placed)
SELECT lat, lon, category, location, count(*) AS n_articles,
       string_agg(title, ' | ' ORDER BY k) FILTER (WHERE k <= 5) AS top
FROM ranked GROUP BY lat, lon, category, location""",
    "hotspot_cards": f"""
WITH {inputs.SQL_ARTICLES}
SELECT * FROM (
  SELECT lat, lon, category, location,
         row_number() OVER (PARTITION BY lat, lon, category, location ORDER BY "timestamp", event_id)::INTEGER AS card,
         'Breaking near ' || location AS header, title, source, url FROM placed) WHERE card <= 5""",
    "category_filter": f"""
WITH {inputs.SQL_ARTICLES}
SELECT category, category IN ('POLITICS', 'WAR') AS visible, count(*) AS n,
       CASE category WHEN 'POLITICS' THEN 'Politics' WHEN 'BUSINESS' THEN 'Business' WHEN 'TECHNOLOGY' THEN 'Technology'
                     WHEN 'HEALTH' THEN 'Health' ELSE 'War' END AS display_name
FROM placed GROUP BY category""",
    "hotspot_remove": f"""
WITH {inputs.SQL_ARTICLES}
SELECT lat, lon, category, location, count(*) AS n_articles FROM placed
GROUP BY lat, lon, category, location HAVING count(*) % 2 = 1""",
    "place_category": f"""
WITH {inputs.SQL_ARTICLES},
counts AS (SELECT location, category, count(*) AS n FROM placed GROUP BY location, category)
SELECT location, category, n FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, category) AS k FROM counts) WHERE k = 1""",
}
