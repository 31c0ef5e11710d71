"""The embedding store: one row per id with its vector and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.schemas import EMBEDDING


def attrs_of(df: DataFrame, skip: tuple[str, ...] = ("body",)) -> Column:
    """All columns but the body as text; null and nested values as JSON."""
    pairs = []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        column = F.col(field.name)
        scalar = field.dataType.simpleString() not in ("binary", "variant") and not hasattr(
            field.dataType, "elementType"
        ) and not hasattr(field.dataType, "keyType") and not hasattr(field.dataType, "fields")
        text = column.cast("string") if scalar else F.to_json(column)
        pairs += [F.lit(field.name), F.coalesce(text, F.lit("null"))]
    return F.create_map(*pairs)


def write_store(embeddings: DataFrame, path: str) -> None:
    """Replace the store by ``(id, vector, attrs)`` rows."""
    rows = embeddings.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in EMBEDDING.fields]
    )
    rows.write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``vector`` and ``title`` (empty where none); unordered."""
    store = spark.read.schema(EMBEDDING).parquet(path)
    title = F.coalesce(F.try_element_at("attrs", F.lit("title")), F.lit(""))
    return store.select("id", "vector", title.alias("title"))


def points_with_text(points: DataFrame, titles: DataFrame) -> DataFrame:
    """``(id, x, y, z)`` points joined to their titles, with the text shown on hover."""
    text = F.concat(F.lit("ID: "), F.col("id"), F.lit("<br>Title: "), F.col("title"))
    return points.join(titles, "id").select("id", "x", "y", "z", text.alias("hover"))
