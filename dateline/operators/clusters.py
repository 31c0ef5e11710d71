"""Reduction to three dimensions, topics, and a look inside clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateline.functions.vectors import cosine, unit
from dateline.operators.embed import mean_pool
from dateline.operators.ranking import first_per_group
from dateline.session import broadcast_within, cut

SEED = 42


def _unit_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.withColumn("_unit", unit(F.col(vector))).where("_unit is not null").withColumn(
        "_unit", array_to_vector("_unit")
    )


def pca_3d(vectors: DataFrame, ident: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, x, y, z)``: the three main components of the unit vectors.

    A linear projection, not the neighbour layout of the reference. Each component's
    largest loading is made positive, so the result does not depend on the solver's
    choice of sign. Runs a job.
    """
    units = _unit_vectors(vectors, vector).select(F.col(ident).alias("id"), "_unit")
    model = PCA(k=3, inputCol="_unit", outputCol="_pc").fit(units)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] > 0 else -1.0 for column in loadings.T]
    scores = model.transform(units).withColumn("_pc", vector_to_array("_pc"))
    return scores.select(
        "id", *[(F.col("_pc")[i] * signs[i]).alias(name) for i, name in enumerate("xyz")]
    )


def kmeans_topics(
    vectors: DataFrame, topics: int, ident: str = "id", vector: str = "vector", seed: int = SEED
) -> DataFrame:
    """``(id, topic)``: k-means over unit vectors. Runs jobs."""
    units = _unit_vectors(vectors, vector).select(F.col(ident).alias("id"), "_unit")
    model = KMeans(k=topics, seed=seed, featuresCol="_unit", predictionCol="topic").fit(units)
    return model.transform(units).select("id", "topic")


def cluster_members(vectors: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Each row with its cluster's ``size`` and its cosine ``distance`` to the mean. Runs a job."""
    means = cut(mean_pool(vectors, cluster, vector).withColumnRenamed("n", "size"), "means")
    means = broadcast_within(means, F.size("mean") * 8 + 32)
    return vectors.join(means, cluster).withColumn(
        "distance", 1 - cosine(F.col(vector), F.col("mean"))
    ).drop("mean")


def cluster_summary(members: DataFrame, cluster: str) -> DataFrame:
    """Size, mean and greatest distance of each cluster."""
    return members.groupBy(cluster).agg(
        F.count("*").alias("size"),
        F.avg("distance").alias("mean_distance"),
        F.max("distance").alias("max_distance"),
    )


def central_rows(members: DataFrame, cluster: str, ident: str, n: int = 5) -> DataFrame:
    """The ``n`` rows nearest to their cluster's mean, ranked."""
    order = [F.round("distance", 9), F.col(ident)]
    return first_per_group(members, [cluster], order, n, rank="rank")
