"""Vectors: pooling, neighbours, fuzzy graph, embeddings, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.operators.clusters import central_rows, cluster_members, cluster_summary, kmeans_topics
from dateline.operators.clusters import pca_3d as reduce_3d
from dateline.operators.embed import hashed_words, mean_pool, shape
from dateline.operators.fuzzy import fuzzy_graph as weigh
from dateline.operators.hotspots import majority
from dateline.operators.neighbours import neighbours
from dateline.plans import inputs
from dateline.session import scratch_path
from dateline.sources.vectors import attrs_of, points_with_text, read_store, write_store

TOPICS = 8


LANGUAGES = ("en", "de", "fr", "es")
CELLS = 24  # also at these sizes the search goes through several cells


def _six(value: Column) -> Column:
    return F.round(value, 6) + 0.0


def mean_pools(spark: SparkSession, folder: str) -> DataFrame:
    pooled = mean_pool(inputs.embeddings(spark, folder), "label")
    return pooled.select("label", "n", F.posexplode("mean").alias("pos", "mean")).withColumn(
        "mean", _six(F.col("mean"))
    )


def embedding_shape(spark: SparkSession, folder: str) -> DataFrame:
    return shape(inputs.embeddings(spark, folder))


def _titled(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.documents(spark, folder).select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", F.md5(F.col("text").cast("binary"))).alias("title"), "source"
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v.cast("double"))


def _every_third(vector: Column, first: int) -> Column:
    return F.filter(vector, lambda v, i: i % 3 == first)


def _weighted(vector: Column) -> Column:
    """All components, each with its place."""
    return _total(F.transform(vector, lambda v, i: v.cast("double") * (i + 1)))


def vector_join(spark: SparkSession, folder: str) -> DataFrame:
    vector = F.col("vector")
    # Every component counts: x sums the first, fourth, ... of them, and so on.
    points = inputs.embeddings(spark, folder).select(
        "id", *[_six(_total(_every_third(vector, k))).alias(axis) for k, axis in enumerate("xyz")]
    )
    return points_with_text(points, _titled(spark, folder))


def store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Articles joined to their vectors by id, stored, and scanned in id order."""
    path = scratch_path(spark, "store")
    rows = _titled(spark, folder).withColumn("title", F.when(F.col("id") % 4 != 0, F.col("title")))
    joined = rows.join(inputs.embeddings(spark, folder).select("id", "vector"), "id")
    with_attrs = joined.withColumn("attrs", F.map_filter(attrs_of(rows, ("id",)), lambda k, v: v != "null"))
    write_store(with_attrs.withColumn("id", F.sha2(F.col("id").cast("string"), 256)), path)
    return (
        read_store(spark, path)
        .orderBy("id")
        .select("id", "title", F.size("vector").alias("n"), _six(_weighted(F.col("vector"))).alias("digest"))
    )


def cosine_knn(spark: SparkSession, folder: str) -> DataFrame:
    rows = neighbours(inputs.embeddings(spark, folder), 5, pivots=CELLS)
    return rows.withColumn("distance", _six(F.col("distance")))


def fuzzy_graph(spark: SparkSession, folder: str) -> DataFrame:
    graph = weigh(neighbours(inputs.embeddings(spark, folder), 5, pivots=CELLS), 5)
    return graph.withColumn("weight", F.round("weight", 5) + 0.0)


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hashed_words(inputs.documents(spark, folder), "text")
    return vectors.select("doc_id", F.posexplode_outer("vector").alias("code", "weight")).where("weight > 0").select(
        "doc_id", "code", (F.round(F.col("weight").cast("double"), 5) + 0.0).alias("weight")
    )


def pca_3d(spark: SparkSession, folder: str) -> DataFrame:
    points = reduce_3d(inputs.embeddings(spark, folder))
    return points.select("id", *[_six(F.col(axis)).alias(axis) for axis in "xyz"])


def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_topics(inputs.embeddings(spark, folder), TOPICS)


def kmeans_separated(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of vectors that lie close to one axis per language; a topic is named by its smallest id."""
    near = F.array(*[
        F.when(F.col("lang") == code, 10.0).otherwise(0.0) + F.pmod(F.col("doc_id") * (k + 3), F.lit(17)) / 100
        for k, code in enumerate(LANGUAGES)
    ])
    docs = inputs.documents(spark, folder).select(F.col("doc_id").alias("id"), near.alias("vector"))
    found = kmeans_topics(docs, len(LANGUAGES))
    names = found.groupBy("topic").agg(F.min("id").alias("named"))
    return found.join(names, "topic").select("id", "named")


def cluster_inspect(spark: SparkSession, folder: str) -> DataFrame:
    summary = cluster_summary(cluster_members(inputs.embeddings(spark, folder), "label"), "label")
    return summary.select("label", "size", _six(F.col("mean_distance")).alias("mean_distance"), _six(F.col("max_distance")).alias("max_distance"))


def cluster_central(spark: SparkSession, folder: str) -> DataFrame:
    rows = central_rows(cluster_members(inputs.embeddings(spark, folder), "label"), "label", "id", 3)
    return rows.join(_titled(spark, folder), "id", "left").select(
        "label", "rank", "id", "title", _six(F.col("distance")).alias("distance")
    )


def cluster_source(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest article source of each cluster."""
    rows = inputs.embeddings(spark, folder).join(_titled(spark, folder), "id")
    return majority(rows, "label", "source")


QUERIES = {
    "mean_pool": mean_pools,
    "embedding_shape": embedding_shape,
    "vector_join": vector_join,
    "store_roundtrip": store_roundtrip,
    "cosine_knn": cosine_knn,
    "fuzzy_graph": fuzzy_graph,
    "embed_text": embed_text,
    "pca_3d": pca_3d,
    "kmeans_topics": kmeans_clusters,
    "kmeans_separated": kmeans_separated,
    "cluster_inspect": cluster_inspect,
    "cluster_central": cluster_central,
    "cluster_source": cluster_source,
}

_TITLED = """
titled AS (
  SELECT doc_id AS id, source || ' ' || md5(text) AS title, source FROM documents)"""
_KNN = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT a.id, b.id AS neighbour,
         CASE WHEN a.id = b.id THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_cosine_similarity(a.e, b.e)) END AS distance
  FROM v a, v b),
knn AS (
  SELECT * FROM (
    SELECT id, neighbour, distance,
           row_number() OVER (PARTITION BY id ORDER BY id <> neighbour, round(distance, 9), neighbour)::INTEGER AS rank
    FROM pairs) WHERE rank <= 5)"""
_MEANS = """
flat AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM flat GROUP BY label, pos)"""
_MEMBERS = f"""
{_MEANS},
members AS (
  SELECT f.id, f.label, n AS size, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS distance
  FROM flat f JOIN means USING (label, pos) GROUP BY f.id, f.label, n)"""



def _third(k: int) -> str:
    return f"round(list_sum(list_transform(list_filter(embedding, lambda v, i: i % 3 = {k}), lambda v: v::DOUBLE)), 6) + 0.0"


SQL = {
    "mean_pool": f"WITH {_MEANS} SELECT label, n, pos::INTEGER AS pos, round(m, 6) + 0.0 AS mean FROM means",
    "embedding_shape": "SELECT count(*) AS n, max(len(embedding)) AS dimensions FROM embeddings",
    "vector_join": f"""
WITH {_TITLED}
SELECT id, {_third(1)} AS x, {_third(2)} AS y, {_third(0)} AS z,
       'ID: ' || id || '<br>Title: ' || title AS hover
FROM embeddings JOIN titled ON id = vec_id""",
    "store_roundtrip": f"""
WITH {_TITLED}
SELECT sha256(id::VARCHAR) AS id, CASE WHEN titled.id % 4 <> 0 THEN title ELSE '' END AS title,
       len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)), 6) + 0.0 AS digest
FROM embeddings JOIN titled ON titled.id = vec_id""",
    "cosine_knn": f"WITH {_KNN} SELECT id, rank, neighbour, round(distance, 6) + 0.0 AS distance FROM knn",
    "fuzzy_graph": f"""
WITH RECURSIVE {_KNN},
rho AS (SELECT id, coalesce(min(distance) FILTER (WHERE distance > 0), 0.0) AS rho, avg(distance) AS mean FROM knn GROUP BY id),
gaps AS (SELECT k.id, list(greatest(0.0::DOUBLE, distance - rho)) AS g, any_value(rho) AS rho, any_value(mean) AS mean
         FROM knn k JOIN rho USING (id) WHERE k.rank > 1 GROUP BY k.id),
search(id, step, lo, hi, mid, done) AS (
  SELECT id, 0, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE, false FROM gaps
  UNION ALL
  SELECT id, step + 1,
         CASE WHEN good OR high THEN lo ELSE mid END,
         CASE WHEN NOT good AND high THEN mid ELSE hi END,
         CASE WHEN good THEN mid WHEN high THEN (lo + mid) / 2
              WHEN hi = 'infinity'::DOUBLE THEN mid * 2 ELSE (mid + hi) / 2 END,
         good
  FROM (
    SELECT s.*, done OR abs(list_sum(list_transform(g, lambda x: exp(-x / mid))) - log2(5)) < 1e-5 AS good,
           list_sum(list_transform(g, lambda x: exp(-x / mid))) > log2(5) AS high
    FROM search s JOIN gaps USING (id) WHERE step < 64)),
scaled AS (SELECT id, greatest(s.mid, 1e-3 * mean) AS sigma, rho FROM search s JOIN gaps USING (id) WHERE step = 64),
directed AS (
  SELECT least(k.id, neighbour) AS a, greatest(k.id, neighbour) AS b,
         CASE WHEN distance <= rho THEN 1.0::DOUBLE ELSE exp(-(distance - rho) / sigma) END AS w
  FROM knn k JOIN scaled USING (id) WHERE k.rank > 1)
SELECT a, b, round(sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END, 5) + 0.0 AS weight
FROM directed GROUP BY a, b""",
    "embed_text": """
WITH coded AS (
  SELECT doc_id, md5(w)[1:2] AS code, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+')) AS w FROM documents)
  WHERE w <> '' GROUP BY ALL)
SELECT doc_id, ('0x' || code)::INTEGER AS code,
       round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) + 0.0 AS weight
FROM coded""",
    "kmeans_separated": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang) AS named FROM documents",
    "cluster_inspect": f"""
WITH {_MEMBERS}
SELECT label, any_value(size) AS size, round(avg(distance), 6) + 0.0 AS mean_distance, round(max(distance), 6) + 0.0 AS max_distance
FROM members GROUP BY label""",
    "cluster_central": f"""
WITH {_MEMBERS}, {_TITLED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), id)::INTEGER AS rank FROM members)
SELECT label, rank, r.id, title, round(distance, 6) + 0.0 AS distance FROM ranked r LEFT JOIN titled USING (id) WHERE rank <= 3""",
    "cluster_source": f"""
WITH {_TITLED},
counts AS (SELECT label, source, count(*) AS n FROM embeddings JOIN titled ON id = vec_id GROUP BY label, source)
SELECT label, source, n FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, source) AS k FROM counts) WHERE k = 1""",
}
