import math
import random

import pytest
from pyspark.sql import functions as F

from dateline.functions import geo
from dateline.operators.countries import border_edges, country_counts, country_grid, outer_rings, with_country
from dateline.operators.hotspots import cards, clear_all, hotspots, majority, with_visibility, without
from dateline.sources.geojson import read_features

NAN = math.nan
FEATURES = "feature_idx int, name string, polys array<array<array<array<double>>>>"


def in_ring(ring, lat, lon):
    inside = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


def random_ring(rng):
    lon, lat, size = rng.uniform(-170, 170), rng.uniform(-80, 80), rng.uniform(0.3, 25)
    n = rng.randint(3, 12)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [[lon + math.cos(a) * size * rng.uniform(0.3, 1), lat + math.sin(a) * size * rng.uniform(0.2, 0.9)] for a in angles]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(3)
    features = [(i, f"f{i}", [[random_ring(rng)] for _ in range(rng.randint(1, 3))]) for i in range(40)]
    features += [(40, "empty", []), (41, "no ring", [[]]), (42, "box", [[[[-10.0, -10.0], [10.0, -10.0], [10.0, 10.0], [-10.0, 10.0]]]])]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(4000)]
    points += [(10000 + i, float(rng.randint(-20, 20)), float(rng.randint(-20, 20))) for i in range(500)]
    points += [(20000, None, 1.0), (20001, 1.0, None)]
    points += [(20002 + i, x, y) for i, (x, y) in enumerate([(NAN, 1.0), (1.0, NAN), (math.inf, 1.0), (1.0, -math.inf)])]
    return features, points


def find(features, lat, lon):
    if lat is None or lon is None or not math.isfinite(lat + lon):
        return None
    for _, name, polys in features:
        if any(poly and poly[0] and in_ring(poly[0], lat, lon) for poly in polys):
            return name
    return None


@pytest.mark.parametrize("degrees", [1.0, 7.5])
def test_country_lookup_against_a_plain_ray_cast(spark, world, degrees):
    features, points = world
    grid = country_grid(spark.createDataFrame(features, FEATURES), degrees)
    placed = with_country(spark.createDataFrame(points, "id long, lat double, lon double"), grid)
    got = {r["id"]: r["country"] for r in placed.collect()}
    assert got == {i: find(features, lat, lon) for i, lat, lon in points}
    assert len({name for name in got.values()}) > 20


def test_lookup_does_not_shuffle_the_points(spark, world):
    features, points = world
    grid = country_grid(spark.createDataFrame(features, FEATURES))
    placed = with_country(spark.createDataFrame(points, "id long, lat double, lon double"), grid)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    counts = {r["country"]: r["n"] for r in country_counts(placed).collect()}
    assert sum(counts.values()) == sum(find(features, *p[1:]) is not None for p in points)


BOX = "file string, " + FEATURES


def square(low, high):
    return [[[[low, low], [high, low], [high, high], [low, high]]]]


def test_far_borders_and_many_files(spark):
    far = spark.createDataFrame([("a", 0, "far", square(0.0, 400_000.0))], BOX)
    at = spark.createDataFrame([(1, 250_000.0, 399_999.0), (2, -1.0, 5.0), (3, 5.0, 400_001.0)], "id long, lat double, lon double")
    got = {r["id"]: r["country"] for r in with_country(at, country_grid(far, 10_000.0)).collect()}
    assert got == {1: "far", 2: None, 3: None}
    # Unnamed features of two files have the same position; they stay two features.
    two = [("a", 0, "Unknown", square(0.0, 10.0)), ("b", 0, "Unknown", square(5.0, 15.0)), ("b", 1, "Later", square(0.0, 20.0))]
    inside = spark.createDataFrame([(k, float(v), float(v)) for k, v in enumerate((3, 7, 12, 18, 30))], "id long, lat double, lon double")
    got = with_country(inside, country_grid(spark.createDataFrame(two, BOX), 0.5)).orderBy("id").collect()
    assert [r["country"] for r in got] == ["Unknown", "Unknown", "Unknown", "Later", None]


def test_broken_borders_are_an_error(spark, tmp_path):
    broken = spark.createDataFrame([("a", 0, "x", [[[[0.0, 0.0], [1.0, NAN], [1.0, 1.0]]]])], BOX)
    with pytest.raises(Exception, match="no finite coordinate"):
        country_grid(broken)
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Fea')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_features(spark, str(tmp_path)).collect()


def test_null_keys_are_kept(spark):
    rows = [(None, None, "WAR", None, f"t{k}", "s", "u", k) for k in range(7)] + [(1.0, 2.0, None, "Here", "x", "s", "u", 1)]
    articles = spark.createDataFrame(rows, "lat double, lon double, category string, location string, title string, source string, url string, timestamp long")
    groups = hotspots(articles, [F.col("timestamp").desc()])
    assert sorted(r["n_articles"] for r in groups.collect()) == [1, 7]
    assert [r["location"] for r in without(articles, groups.where("n_articles = 7")).collect()] == ["Here"]
    assert clear_all(articles).columns == articles.columns and clear_all(articles).count() == 0


def test_ring_start_does_not_matter(spark):
    ring = [[0.0, 0.0], [4.0, 1.0], [3.0, 5.0], [1.0, 2.0]]
    points = [(x / 3, y / 3) for x in range(-2, 16) for y in range(-2, 16)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    turned = [ring[i:] + ring[:i] for i in range(4)]
    columns = [geo.in_ring(F.array(*[F.array(*map(F.lit, v)) for v in r]), F.col("lat"), F.col("lon")) for r in turned]
    for row, (lat, lon) in zip(frame.select(*columns).collect(), points, strict=True):
        assert set(row) == {in_ring(ring, lat, lon)}


def test_border_edges_wrap_and_drop_holes(spark):
    features = [(0, "a", [[[[0.0, 0.0], [90.0, 0.0], [0.0, 90.0]], [[1.0, 1.0]]], [[]]])]
    edges = border_edges(spark.createDataFrame(features, FEATURES), 2.0).orderBy("edge").collect()
    assert [(e["lon_a"], e["lat_a"], e["lon_b"], e["lat_b"]) for e in edges] == [
        (0, 0, 90, 0), (90, 0, 0, 90), (0, 90, 0, 0)
    ]
    assert all(e["length"] == pytest.approx(2 * math.sqrt(2)) for e in edges)
    assert outer_rings(spark.createDataFrame(features, FEATURES)).count() == 1


def test_sphere_round_trip_and_scalars(spark):
    points = [(lat, lon) for lat in (-89.5, -45.0, 0.0, 30.25, 89.5) for lon in (-179.5, -90.0, 0.0, 12.5, 179.5)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    back = geo.point_to_latlon(geo.latlon_to_point(F.col("lat"), F.col("lon")))
    for row in frame.select("lat", "lon", back.alias("b")).collect():
        assert (row["b"]["lat"], row["b"]["lon"]) == (pytest.approx(row["lat"]), pytest.approx(row["lon"]))
    south = frame.select(geo.latlon_to_point(F.lit(-90.0), F.lit(0.0), 1.0).alias("p")).first()["p"]
    assert south["y"] == pytest.approx(1.0)
    outside = F.struct(F.lit(0.0).alias("x"), F.lit(301.0).alias("y"), F.lit(0.0).alias("z"))
    assert math.isnan(frame.select(geo.point_to_latlon(outside)["lat"]).first()[0])
    values = spark.createDataFrame([(-2.5,), (3.0,), (99.0,), (float("nan"),)], "v double")
    got = [r[0] for r in values.select(geo.clamp(F.col("v"), -1, 5)).collect()]
    assert got[:3] == [-1.0, 3.0, 5.0] and math.isnan(got[3])
    got = [r[0] for r in spark.createDataFrame([(-0.025,), (0.025,), (1.005,), (2.345,)], "v double").select(geo.round2(F.col("v"))).collect()]
    assert got == [-0.02, 0.03, 1.0, 2.35]


GEOJSON = """{"type": "FeatureCollection", "features": [
 {"type":"Feature","properties":{"name_en":"P"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[0.1,0.1]]]}},
 {"type":"Feature","properties":{"name_en":null},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6]]],[[[7,7],[8,7],[8,8.5]]]]}},
 {"type":"Feature","properties":{"name_en":"none"},"geometry":null},
 {"type":"Feature","properties":{"name_en":"point"},"geometry":{"type":"Point","coordinates":[1,2]}},
 {"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[20,20],[21,20],[21,21]]]}},
 {"type":"Feature","properties":{"name_en":"bare"},"geometry":{"type":"Polygon"}}]}"""


def test_geojson(spark, tmp_path):
    (tmp_path / "world.json").write_text(GEOJSON)
    rows = read_features(spark, str(tmp_path)).orderBy("feature_idx").collect()
    assert [(r["feature_idx"], r["name"], len(r["polys"])) for r in rows] == [(0, "P", 1), (1, "Unknown", 2), (4, "Unknown", 1)]
    assert rows[1]["polys"][1][0][2] == [8.0, 8.5]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_features(spark, str(tmp_path / "missing"))


@pytest.fixture(scope="module")
def stories(spark):
    rows = [
        (12.25, -31.5, "TECHNOLOGY", "Upper Mill", f"t{i}", "s", f"u{i}", i) for i in range(12)
    ] + [(-3.75, 88.0, "HEALTH", "Low Ferry", "n", "s", "u", 1)]
    return spark.createDataFrame(
        rows, "lat double, lon double, category string, location string, title string, source string, url string, timestamp long"
    )


def test_hotspots(stories):
    order = [F.col("timestamp").desc()]
    groups = {r["location"]: r for r in hotspots(stories, order).collect()}
    assert groups["Upper Mill"]["n_articles"] == 12
    assert [c["title"] for c in groups["Upper Mill"]["top"]] == ["t11", "t10", "t9", "t8", "t7"]
    panel = cards(stories, order).where("location = 'Upper Mill'").orderBy("card").collect()
    assert [(c["card"], c["title"]) for c in panel] == [(1, "t11"), (2, "t10"), (3, "t9"), (4, "t8"), (5, "t7")]
    assert {c["header"] for c in panel} == {"Breaking near Upper Mill"}


def test_filter_and_removal(spark, stories):
    assert with_visibility(stories, []).where("visible").count() == 13
    assert with_visibility(stories, {"HEALTH"}).where("visible").count() == 1
    assert with_visibility(stories, {"HEALTH"}).count() == 13
    gone = spark.createDataFrame([(12.25, -31.5, "TECHNOLOGY", "Upper Mill")], "lat double, lon double, category string, location string")
    assert [r["location"] for r in without(stories, gone).collect()] == ["Low Ferry"]


def test_majority(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "d"), (2, "c"), (3, None)], "g int, l string")
    assert {(r["g"], r["l"], r["n"]) for r in majority(rows, "g", "l").collect()} == {(1, "b", 2), (2, "c", 1)}
