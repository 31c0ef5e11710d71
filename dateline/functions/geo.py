"""Sphere arithmetic and point-in-ring tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius and the height of a hotspot above it.
SPHERE_RADIUS = 300.0
ANCHOR_HEIGHT = 2.5


def latlon_to_point(lat: Column, lon: Column, radius: float = SPHERE_RADIUS) -> Column:
    """Degrees to a point on the sphere; y grows to the south."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.struct(
        (radius * F.cos(phi) * F.cos(lam)).alias("x"),
        (-radius * F.sin(phi)).alias("y"),
        (radius * F.cos(phi) * F.sin(lam)).alias("z"),
    )


def point_to_latlon(point: Column, radius: float = SPHERE_RADIUS) -> Column:
    return F.struct(
        (-F.degrees(F.asin(point["y"] / radius))).alias("lat"),
        F.degrees(F.atan2(point["z"], point["x"])).alias("lon"),
    )


def hotspot_anchor(lat: Column, lon: Column) -> Column:
    """Where a hotspot sits: a little above the sphere."""
    return latlon_to_point(lat, lon, SPHERE_RADIUS + ANCHOR_HEIGHT)


def clamp(value: Column, low: float, high: float) -> Column:
    """Value held between two bounds; NaN stays NaN."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(F.isnan(value), value).otherwise(bounded)


def round2(value: Column) -> Column:
    """Two decimals, halves towards positive infinity (-2.5 hundredths give -2)."""
    return F.floor(value * 100.0 + 0.5) / 100.0


def length(vector: Column) -> Column:
    return F.sqrt(sum(vector[axis] * vector[axis] for axis in "xyz"))


def difference(a: Column, b: Column) -> Column:
    return F.struct(*[(a[axis] - b[axis]).alias(axis) for axis in "xyz"])


def crossings(edges: Column, lat: Column, lon: Column) -> Column:
    """How many edges ``(xi, yi, xj, yj)`` span the latitude and meet it east of the
    point; ``i`` is a ring vertex and ``j`` the one before it."""

    def hit(e: Column) -> Column:
        spans = (e["yi"] > lat) != (e["yj"] > lat)
        meets = (e["xj"] - e["xi"]) * (lat - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"]
        return F.when(spans, lon < meets).otherwise(False)

    return F.size(F.filter(edges, hit))


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of ``[lon, lat]`` vertices, each with its previous vertex."""
    n = F.size(ring)
    return F.transform(
        ring,
        lambda v, i: F.struct(
            v[0].alias("xi"),
            v[1].alias("yi"),
            F.get(ring, (i + n - 1) % n)[0].alias("xj"),
            F.get(ring, (i + n - 1) % n)[1].alias("yj"),
        ),
    )


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """True inside a ring, closed or not; holes are not part of a ring."""
    return crossings(ring_edges(ring), lat, lon) % 2 == 1
