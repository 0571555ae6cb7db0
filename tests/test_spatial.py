"""Area assignment against a plain ray cast on random polygons."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators.spatial import AreaIndex, assign_area, count_points_by_area, stops_with_total
from fieldtally.session import scratch_dir

AREA = "area_id int, area string, offset_hours int, ring array<struct<lon:double,lat:double>>"


def star(cx, cy, r, n, rng):
    """A star-shaped, usually concave polygon."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(a), cy + r * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def areas_of(spark, rings, names=None):
    data = [(i, (names or {}).get(i, f"area {i:02d}"), i % 3, r) for i, r in enumerate(rings)]
    return spark.createDataFrame(data, AREA)


def points_of(spark, points):
    return spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "i int, lat double, lon double")


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_random_polygons(spark, limit):
    rng = random.Random(5)
    rings = [star(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0.5, 8), rng.randint(3, 25), rng) for _ in range(25)]
    points = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(3000)] + [v for r in rings for v in r]
    index = AreaIndex.build(areas_of(spark, rings), broadcast_bytes=limit)
    assert index.broadcast is (limit > 0)
    got = {r.i: r.area_id for r in assign_area(points_of(spark, points), index).collect()}
    want = {}
    for i, (x, y) in enumerate(points):
        hit = next((a for a, ring in enumerate(rings) if inside(ring, x, y)), None)
        if hit is not None:
            want[i] = hit
    assert got == want


def test_boundary_is_outside(spark, rows):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    points = [(0.0, 0.0), (2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 3.0), (2.0, 2.0), (3.999999, 2.0), (4.000001, 2.0)]
    got = rows(assign_area(points_of(spark, points), areas_of(spark, [square])), "i")
    assert got == [(5,), (6,)]


def test_first_name_wins_and_overlaps_count_twice(spark, rows):
    a = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    b = [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]
    c = [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]
    areas = areas_of(spark, [a, b, c], {0: "Zeta", 1: "Alpha", 2: "Empty"})
    points = points_of(spark, [(3.0, 3.0), (1.0, 1.0), (5.0, 5.0), (9.0, 9.0)])
    assert rows(assign_area(points, areas), "i", "area") == [(0, "Alpha"), (1, "Zeta"), (2, "Alpha")]
    counts = rows(stops_with_total(count_points_by_area(points, areas)))
    assert counts == [("Alpha", 2), ("Empty", 0), ("Zeta", 2), ("grand_total", 4)]


def test_no_areas_keep_everything(spark):
    points = points_of(spark, [(1.0, 1.0)])
    row = assign_area(points, spark.createDataFrame([], AREA)).first()
    assert (row.area_id, row.area, row.offset_hours) == (None, None, 0)


def test_hot_point_is_not_shuffled(spark):
    """With a broadcast index the events pass through without an exchange."""
    index = AreaIndex.build(areas_of(spark, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]]))
    events = spark.range(1000).select((F.col("id") % 2).cast("double").alias("lat"), F.lit(2.0).alias("lon"))
    plan = assign_area(events, index)._jdf.queryExecution().executedPlan().toString()
    events_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in events_side and "Exchange hashpartitioning" not in events_side


def test_detailed_coast(spark):
    """A ring of 20,000 vertices: a point walks through a small part of the edges, with the same result."""
    turn = F.lit(2 * math.pi / 20_000)
    radius = lambda i: 3 + F.sin(turn * i * 7) + 0.002 * F.sin(turn * i * 1999)
    vertex = lambda i: F.struct((radius(i) * F.cos(turn * i)).alias("lon"), (radius(i) * F.sin(turn * i)).alias("lat"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(19_999)), vertex)
    path = scratch_dir(spark, "coast")
    spark.range(1).select(F.lit(1).alias("area_id"), F.lit("coast").alias("area"), F.lit(0).alias("offset_hours"), ring.alias("ring")).write.parquet(path)
    areas = spark.read.parquet(path)
    index = AreaIndex.build(areas)
    widest = index.cells.select(F.explode("_areas").alias("a")).select(F.explode("a.bands").alias("b")).agg(F.max(F.size("b"))).first()[0]
    assert widest < 500
    rng = random.Random(7)
    xy = np.array([(rng.uniform(-4.2, 4.2), rng.uniform(-4.2, 4.2)) for _ in range(400)])
    got = {r.i for r in assign_area(points_of(spark, [(float(x), float(y)) for x, y in xy]), index).collect()}
    corners = np.array([tuple(p) for p in areas.select(F.inline("ring")).collect()])
    (x1, y1), (x2, y2) = corners.T, np.roll(corners, -1, axis=0).T
    want = set()
    for i, (x, y) in enumerate(xy):
        over = (y1 > y) != (y2 > y)
        if (x < (x2[over] - x1[over]) * (y - y1[over]) / (y2[over] - y1[over]) + x1[over]).sum() % 2:
            want.add(i)
    assert got == want and 0 < len(want) < 400


def test_very_detailed_coast(spark):
    """A ring of 100,000 vertices: built in bounded time, few edges a band, and the same answers as every edge tried."""
    import time

    import numpy as np

    n = 100_000
    turn = F.lit(2 * math.pi / n)
    point = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.cos(i * turn) * (10 + F.sin(i * turn * 40))).alias("lon"), (F.sin(i * turn) * (10 + F.cos(i * turn * 25))).alias("lat")))
    areas = spark.range(1).select(F.lit(1).alias("area_id"), F.lit("A").alias("area"), F.lit(0).alias("offset_hours"), point.alias("ring"))
    ring = np.array([(p["lon"], p["lat"]) for p in areas.first()["ring"]])
    begin = time.perf_counter()
    index = AreaIndex.build(areas)
    most = index.cells.select(F.explode("_areas").alias("a")).select(F.max(F.array_max(F.transform("a.bands", lambda b: F.size(b))))).first()[0]
    assert time.perf_counter() - begin < 40 and most <= 400  # seconds on a shared machine; some five on eight cores

    rng = np.random.default_rng(4)
    points = np.concatenate([rng.uniform(-12, 12, size=(1_500, 2)), ring[:: n // 200]])  # vertices are on the border, so outside
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r["id"] for r in assign_area(frame, index).collect()}
    x1, y1 = ring.T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)

    def inside(x, y):
        up = (y1 > y) != (y2 > y)
        cross = x1[up] + (y - y1[up]) / (y2[up] - y1[up]) * (x2[up] - x1[up])
        return (cross > x).sum() % 2 == 1

    want = {i for i, (x, y) in enumerate(points[:1_500]) if inside(x, y)}
    assert {i for i in got if i < 1_500} == want and not [i for i in got if i >= 1_500]
