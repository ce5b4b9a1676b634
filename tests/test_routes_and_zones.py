"""Ways through zones against plain geometry; folder listings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scarpline.operators import spatial
from scarpline.sources import catalog


def arc(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(a)))


def way(points):
    """Legs of a trip in ordinal order, the last one without length."""
    ordered = [p[1:] for p in sorted(points) if None not in p[1:]]
    return list(zip(ordered, ordered[1:] + ordered[-1:]))


def nearest(leg, lat, lon, steps=1500):
    """Distance by trying many places of the leg."""
    (a, b), (c, d) = leg
    return min(arc(lat, lon, a + (c - a) * i / steps, b + (d - b) * i / steps) for i in range(steps + 1))


def random_trips(draw, n, spread=0.5):
    trips = {t: [(o, draw.uniform(10, 10 + spread), draw.uniform(76, 76 + spread)) for o in range(draw.randint(1, 5))] for t in range(n)}
    return trips, [(t, o, lat, lon) for t, ps in trips.items() for o, lat, lon in ps]


WAY = "trip_id long, ordinal int, latitude double, longitude double"


@pytest.mark.parametrize("cell,block", [(0.05, 10_000), (0.013, 2)])
def test_ways_through_circles(spark, monkeypatch, cell, block):
    monkeypatch.setattr(spatial.legs, "__defaults__", (block,))
    draw = random.Random(3)
    trips, rows = random_trips(draw, 40)
    zones = [(f"z{i}", draw.uniform(10, 10.5), draw.uniform(76, 76.5), draw.uniform(50, 3000)) for i in range(25)]
    found = {tuple(r) for r in spatial.route_crossings(spark.createDataFrame(rows, WAY), spark.createDataFrame(zones, "zone_id string, latitude double, longitude double, radius_meters double"), cell).collect()}
    by_waypoint = set()
    for t, points in trips.items():
        for name, lat, lon, radius in zones:
            least = min(nearest(leg, lat, lon) for leg in way(points))
            if abs(least - radius) > 8:  # metres; the trial places are up to 50 m apart
                assert ((t, name) in found) == (least < radius)
            if any(arc(lat, lon, p[1], p[2]) <= radius for p in points):
                by_waypoint.add((t, name))
    assert by_waypoint < found  # some legs pass through without a waypoint inside


def in_ring(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def star(draw, x, y, size, n):
    points = [(x + size * draw.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + size * draw.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [list(p) for p in points + points[:1]]


@pytest.mark.parametrize("cell", [0.05, 0.011])
def test_ways_through_polygons_with_holes(spark, cell):
    draw = random.Random(8)
    trips, rows = random_trips(draw, 30)
    shapes = []
    for i in range(20):
        x, y, size = draw.uniform(76, 76.5), draw.uniform(10, 10.5), draw.uniform(0.01, 0.2)
        shapes.append((f"z{i}", [star(draw, x, y, size, 9)] + ([star(draw, x, y, size * 0.35, 5)] if i % 2 else [])))
    found = {tuple(r) for r in spatial.route_polygon_crossings(spark.createDataFrame(rows, WAY), spark.createDataFrame(shapes, "zone_id string, rings array<array<array<double>>>"), cell).collect()}
    steps = 800
    for t, points in trips.items():
        for name, rings in shapes:
            hit = False
            for (a, b), (c, d) in way(points):
                hit = hit or any(sum(in_ring(b + (d - b) * i / steps, a + (c - a) * i / steps, r) for r in rings) % 2 for i in range(steps + 1))
            if hit:
                assert (t, name) in found
            elif (t, name) in found:  # only a graze between two trial places
                assert min(
                    abs((r[k + 1][0] - r[k][0]) * (p[1] - r[k][1]) - (r[k + 1][1] - r[k][1]) * (p[2] - r[k][0])) for r in rings for k in range(len(r) - 1) for p in points
                ) < 1e-2


def test_awkward_ways(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]
    shapes = spark.createDataFrame([("z", [square, hole]), ("none", None), ("empty", [])], "zone_id string, rings array<array<array<double>>>")
    trips = {
        "through": [(1, -1.0, 2.0), (2, 5.0, 2.0)], "in hole": [(1, 2.0, 2.0), (2, 2.5, 2.5)], "out": [(1, 5.0, 5.0), (2, 6.0, 1.0)],
        "single": [(1, 0.5, 0.5)], "along edge": [(1, 0.0, 1.0), (2, 0.0, 2.0)], "gap": [(1, -1.0, 2.0), (2, None, 9.0), (3, 5.0, 2.0)],
        "same place": [(1, 5.0, 5.0), (1, 5.0, 5.0)], "no ordinal": [(None, -1.0, 2.0), (5, 5.0, 2.0)], "nothing": [(1, None, None)],
    }
    rows = [(t, *p) for t, ps in trips.items() for p in ps]
    df = spark.createDataFrame(rows, WAY.replace("trip_id long", "trip_id string"))
    assert {r["trip_id"] for r in spatial.route_polygon_crossings(df, shapes).collect()} == {"through", "single", "along edge", "gap", "no ordinal"}
    assert spatial.route_polygon_crossings(df.limit(0), shapes).collect() == []
    circle = spark.createDataFrame([("c", 2.0, 2.0, 1000.0), ("no place", None, 2.0, 5.0), ("no radius", 2.0, 2.0, None)], "zone_id string, latitude double, longitude double, radius_meters double")
    assert {tuple(r) for r in spatial.route_crossings(df, circle).collect()} == {(t, "c") for t in ("through", "in hole", "gap", "no ordinal")}


def test_one_long_trip_is_spread(spark):
    """Legs of a trip with very many waypoints come from blocks and join up at their borders."""
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("trip_id"), F.col("id").alias("ordinal"), (F.col("id") % 90).cast("double").alias("latitude"), (F.col("id") % 70).cast("double").alias("longitude"))
    out = spatial.legs(df, block=64).orderBy("ordinal").collect()
    assert [(r["lat1"], r["lon1"], r["lat2"], r["lon2"]) for r in out] == [(i % 90, i % 70, min(i + 1, n - 1) % 90, min(i + 1, n - 1) % 70) for i in range(n)]


def test_listing_reads_names_only(spark, tmp_path):
    (tmp_path / "a.b" / "c d").mkdir(parents=True)
    (tmp_path / "a.b" / "c d" / "x.y.CSV").write_text("1,2")
    (tmp_path / "plain").write_text("x")
    listed = catalog.list_files(spark, str(tmp_path))
    assert {(r["path"], r["size_bytes"]) for r in listed.collect()} == {("a.b/c d/x.y.CSV", 3), ("plain", 1)}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert {(r["dataset_id"], r["kind"]) for r in catalog.file_inventory(spark, f"file://{tmp_path}/", "P_").collect()} == {("P_a_b_c d_x_y_CSV", "csv"), ("P_plain", "other")}
