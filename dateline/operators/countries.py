"""Which country a point is in: first feature, in order, whose outer ring holds it.

Borders are cut into grid cells once. A cell row lists the features around it, so a
point joins one row and needs no aggregation afterwards. Of a feature it holds

* ``edges``: those that share longitudes with the cell and must be tested, and
* ``flips``: what the edges wholly east of the cell amount to. Each counts for the
  latitudes it spans, so together they are a parity that changes at some latitudes;
  where one edge of a border ends and the next goes on, it does not.

The grid thus grows with the borders and their cells, not with their product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.functions.geo import crossings, difference, latlon_to_point, length, ring_edges
from dateline.session import broadcast_within, cut

_SLACK = 1e-9


def outer_rings(features: DataFrame) -> DataFrame:
    """``(file, feature_idx, name, part, ring)``: the first ring of every polygon, no holes."""
    file = F.col("file") if "file" in features.columns else F.lit("")
    parts = features.select(
        file.alias("file"), "feature_idx", "name", F.posexplode("polys").alias("part", "poly")
    )
    return (
        parts.where(F.size("poly") > 0)
        .select("file", "feature_idx", "name", "part", F.col("poly")[0].alias("ring"))
        .where(F.size("ring") > 0)
    )


def border_edges(features: DataFrame, radius: float) -> DataFrame:
    """Consecutive vertices of every outer ring, wrapping around, with their length on
    a sphere of the given radius."""
    n = F.size("ring")
    following = F.get(F.col("ring"), (F.col("edge") + 1) % n)
    vertices = outer_rings(features).select("*", F.posexplode("ring").alias("edge", "a"))
    edges = vertices.select(
        "file",
        "feature_idx",
        "part",
        "edge",
        F.col("a")[0].alias("lon_a"),
        F.col("a")[1].alias("lat_a"),
        following[0].alias("lon_b"),
        following[1].alias("lat_b"),
    )
    a = latlon_to_point(F.col("lat_a"), F.col("lon_a"), radius)
    b = latlon_to_point(F.col("lat_b"), F.col("lon_b"), radius)
    return edges.withColumn("length", length(difference(b, a)))


def _cell(value: Column, degrees: float) -> Column:
    """Grid index of a coordinate; null unless it is finite."""
    return F.when(F.abs(value / degrees) < _LAST_CELL, F.floor(value / degrees))


_LAST_CELL = 4.0e15  # cell numbers stay exact in a double up to here
_PART = ("file", "feature_idx", "part", "name")


def _checked(value: str) -> Column:
    """A border's coordinate, or an error: a ring with a hole in it has no inside."""
    usable = F.coalesce(F.abs(value) < 1e15, F.lit(False))
    return F.when(usable, F.col(value)).otherwise(
        F.raise_error(F.lit("border vertex that is no finite coordinate")).cast("double")
    )


def _odd(latitudes: Column) -> Column:
    """Latitudes that occur an odd number of times; equal ones cancel in pairs."""
    return F.aggregate(
        F.sort_array(latitudes),
        F.expr("cast(array() as array<double>)"),
        lambda kept, y: F.when(
            F.get(kept, F.size(kept) - 1) == y, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.concat(kept, F.array(y))),
    )


def _flip_rows(banded: DataFrame, degrees: float) -> DataFrame:
    """``(cx, cy, part, flips)`` from edges per band; ``first`` is an edge's westernmost
    column. A flip below the band counts from its lower end, one above it never."""
    south, north = F.col("cy") * degrees - _SLACK, (F.col("cy") + 1) * degrees + _SLACK

    def held(y: str) -> Column:
        return F.least(F.greatest(F.col(y), south), north)

    ends = banded.select(
        *_PART, "cy", F.col("first").alias("column"), F.explode(F.array(held("yi"), held("yj"))).alias("y")
    )
    odd = (
        ends.where(F.col("y") < north)
        .groupBy(*_PART, "cy", "column", "y")
        .agg(F.count("*").alias("n"))
        .where("n % 2 = 1")
    )
    bands = odd.groupBy(*_PART, "cy").agg(
        F.collect_list(F.struct("column", "y")).alias("ends"),
        F.min("column").alias("west"),
        F.max("column").alias("east"),
    )
    # West of all columns the border has closed: every flip cancels.
    cells = bands.where("east > west").withColumn(
        "cx", F.explode(F.sequence(F.col("west"), F.col("east") - 1))
    )
    farther = F.filter("ends", lambda e: e["column"] > F.col("cx"))
    return cells.select("cx", "cy", *_PART, _odd(F.transform(farther, lambda e: e["y"])).alias("flips"))


@dataclass(frozen=True)
class Grid:
    """``cells(cx, cy, near)`` and the size they were made with."""

    cells: DataFrame
    degrees: float


def country_grid(features: DataFrame, degrees: float = 1.0) -> Grid:
    """Every cell that can hold a point of some feature, by file and then by position.

    Use smaller cells for many small features. Runs a job: the grid is written to the
    shared folder.
    """
    raw = outer_rings(features).select(*_PART, F.inline(ring_edges(F.col("ring"))))
    edges = raw.select(*_PART, *[_checked(c).alias(c) for c in ("xi", "yi", "xj", "yj")])
    low, high = F.least("yi", "yj") - _SLACK, F.greatest("yi", "yj") + _SLACK
    bands = edges.select("*", F.explode(F.sequence(_cell(low, degrees), _cell(high, degrees))).alias("cy"))
    # Of a sloping edge a band has just the columns it crosses there.
    south, north = F.greatest(low, F.col("cy") * degrees), F.least(high, (F.col("cy") + 1) * degrees)
    ends = [F.col("xi") + (y - F.col("yi")) / (F.col("yj") - F.col("yi")) * (F.col("xj") - F.col("xi")) for y in (south, north)]
    west, east = F.least("xi", "xj"), F.greatest("xi", "xj")
    clipped = bands.select(
        "*",
        F.when(F.col("yi") == F.col("yj"), west).otherwise(F.greatest(west, F.least(*ends))).alias("west"),
        F.when(F.col("yi") == F.col("yj"), east).otherwise(F.least(east, F.greatest(*ends))).alias("east"),
    )
    slack = _SLACK * (1 + F.greatest(F.abs("xi"), F.abs("xj")))
    banded = clipped.select(
        *_PART, "xi", "yi", "xj", "yj", "cy",
        _cell(F.col("west") - slack, degrees).alias("first"),
        _cell(F.col("east") + slack, degrees).alias("last"),
    )
    near = (
        banded.withColumn("cx", F.explode(F.sequence("first", "last")))
        .groupBy("cx", "cy", *_PART)
        .agg(F.collect_list(F.struct("xi", "yi", "xj", "yj")).alias("edges"))
    )
    both = near.unionByName(_flip_rows(banded, degrees), allowMissingColumns=True)
    parts = both.groupBy("cx", "cy", *_PART).agg(
        F.flatten(F.collect_list("edges")).alias("edges"),
        F.flatten(F.collect_list("flips")).alias("flips"),
    )
    around = F.struct("file", "feature_idx", "part", "name", "edges", "flips")
    cells = cut(
        parts.where("size(edges) > 0 or size(flips) > 0")
        .groupBy("cx", "cy")
        .agg(F.sort_array(F.collect_list(around)).alias("near")),
        "grid",
    )
    return Grid(cells, degrees)


def with_country(
    points: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add ``country``, null where no feature holds the point."""
    parts = F.aggregate(
        "near", F.lit(0), lambda total, f: total + F.size(f["edges"]) * 32 + F.size(f["flips"]) * 8 + 96
    )
    keyed = points.withColumn("cx", _cell(F.col(lon), grid.degrees)).withColumn(
        "cy", _cell(F.col(lat), grid.degrees)
    )
    joined = keyed.join(broadcast_within(grid.cells, parts), ["cx", "cy"], "left")

    def holds(f: Column) -> Column:
        flipped = F.size(F.filter(f["flips"], lambda y: y <= F.col(lat)))
        return (crossings(f["edges"], F.col(lat), F.col(lon)) + flipped) % 2 == 1

    holding = F.filter(F.col("near"), holds)
    return joined.withColumn("country", F.get(holding, 0)["name"]).drop("cx", "cy", "near")


def country_counts(placed: DataFrame) -> DataFrame:
    """Number of rows per country found."""
    return placed.where("country is not null").groupBy("country").agg(F.count("*").alias("n"))
