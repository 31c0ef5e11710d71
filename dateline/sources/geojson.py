"""Country borders from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.schemas import GEOJSON, MULTIPOLYGON, POLYGON


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``(file, feature_idx, name, polys)`` of feature collections, one per file.

    A polygon becomes a multi-polygon of one. Features without usable geometry are
    left out; their position still counts. A missing path or a malformed file is an error.
    A file is one row, so it must fit into a task; cut larger collections into files.
    """
    collections = spark.read.schema(GEOJSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    features = collections.select(
        F.input_file_name().alias("file"), F.posexplode("features").alias("feature_idx", "f")
    )
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polys = F.when(kind == "Polygon", F.array(F.from_json(text, POLYGON))).when(
        kind == "MultiPolygon", F.from_json(text, MULTIPOLYGON)
    )
    return features.select(
        "file",
        "feature_idx",
        F.coalesce(F.col("f.properties.name_en"), F.lit("Unknown")).alias("name"),
        polys.alias("polys"),
    ).where(text.isNotNull() & F.col("polys").isNotNull())
