"""Neighbour lists to the weighted graph of UMAP (McInnes, Healy, Melville 2018)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published method.
STEPS = 64
TOLERANCE = 1e-5
LEAST_SCALE = 1e-3


def local_scale(neighbour_rows: DataFrame, k: int = 5) -> DataFrame:
    """``(id, near, rho, sigma)``: distance to the nearest other point and the width at
    which the k weights sum to log2 k, found by bisection inside the row."""
    lists = neighbour_rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("near")
    )
    distances = F.transform("near", lambda e: e["distance"])
    others = F.slice("ds", 2, F.greatest(F.size("ds") - 1, F.lit(0)))
    rho = F.coalesce(F.array_min(F.filter("ds", lambda d: d > 0)), F.lit(0.0))
    base = lists.withColumn("ds", distances).withColumn("rho", rho).withColumn("others", others)

    def total(width):
        return F.aggregate(
            "others",
            F.lit(0.0),
            lambda acc, d: acc
            + F.when(d > F.col("rho"), F.exp(-(d - F.col("rho")) / width)).otherwise(1.0),
        )

    target = math.log2(k)
    infinity = F.lit(math.inf)
    start = F.struct(
        F.lit(0.0).alias("lo"), infinity.alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done")
    )

    def halve(state, _):
        # The sum is bound once; the step uses it several times.
        def step(t):
            good = F.abs(t - target) < TOLERANCE
            high = t > target
            lo = F.when(high, state["lo"]).otherwise(state["mid"])
            hi = F.when(high, state["mid"]).otherwise(state["hi"])
            mid = F.when(hi == infinity, state["mid"] * 2).otherwise((lo + hi) / 2)
            return F.when(state["done"] | good, F.struct(
                state["lo"].alias("lo"), state["hi"].alias("hi"), state["mid"].alias("mid"),
                F.lit(True).alias("done"),
            )).otherwise(F.struct(
                lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), F.lit(False).alias("done")
            ))

        return F.get(F.transform(F.array(total(state["mid"])), step), 0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["mid"]
    mean = F.aggregate("ds", F.lit(0.0), lambda acc, d: acc + d) / F.size("ds")
    floor = LEAST_SCALE * mean
    return base.withColumn("sigma", F.greatest(found, floor)).select("id", "near", "rho", "sigma")


def fuzzy_graph(neighbour_rows: DataFrame, k: int = 5) -> DataFrame:
    """``(a, b, weight)`` with a < b: the two directed weights joined as p + q - pq.

    A pair's two directions meet in one aggregation; there is no self-join.
    """
    scaled = local_scale(neighbour_rows, k).select("id", "rho", "sigma", F.inline("near"))
    gap = F.col("distance") - F.col("rho")
    weight = F.when((gap <= 0) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-gap / F.col("sigma")))
    directed = scaled.where(F.col("id") != F.col("neighbour")).select(
        F.least("id", "neighbour").alias("a"),
        F.greatest("id", "neighbour").alias("b"),
        weight.alias("w"),
    )
    both = F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0)
    return directed.groupBy("a", "b").agg((F.sum("w") - both).alias("weight"))
