"""Distances and regions against brute force."""

import json
import math
import random

from pyspark.sql import functions as F

from waylake.operators import relational as rel
from waylake.operators import spatial as sp


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(min(1, h)), math.sqrt(max(0, 1 - h)))


def somewhere(rng):
    return (rng.choice([rng.uniform(-180, 180), rng.uniform(179.9, 180), rng.uniform(-180, -179.9), 10 + rng.random() / 4]), rng.choice([rng.uniform(-90, 90), rng.uniform(89.9, 90), rng.uniform(-90, -89.9), 50 + rng.random() / 4]))


def test_within_distance_everywhere(spark):
    rng = random.Random(3)
    p = [(f"p{i}", *somewhere(rng)) for i in range(500)] + [("pole", 0.0, 90.0), ("line", 180.0, 10.0)]
    c = [(f"c{i}", *somewhere(rng)) for i in range(300)] + [("pole2", 99.0, 90.0), ("line2", -180.0, 10.0)]
    schema = "id string, lon double, lat double"
    for reach in (2.0, 11.0):
        got = {(r[0], r[1]) for r in sp.within_distance(spark.createDataFrame(p, schema), spark.createDataFrame(c, schema), reach).collect()}
        assert got == {(x[0], y[0]) for x in p for y in c if km(x[1:], y[1:]) <= reach}


def test_coordinates_as_written(spark):
    texts = ["12.5", " 12.5 ", "12", "-0.0", "91", "x", "", None, "1e1", "12.", "+1", "１２"]
    df = spark.createDataFrame([(str(i), "1", t, "clash") for i, t in enumerate(texts)], "k string, longitude string, latitude string, lon string").drop("lon")
    assert {r["id"] for r in sp.located(df, "k").collect()} == {"0", "1", "2", "3"}


def ring_holds(ring, x, y):
    inside = False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
        if min(xa, xb) <= x < max(xa, xb) and ya + (yb - ya) * (x - xa) / (xb - xa) <= y:
            inside = not inside
    return inside


def star(rng, x, y, r, n):
    return [[x + r * (0.4 + rng.random()) * math.cos(2 * math.pi * i / n), y + r * (0.4 + rng.random()) * math.sin(2 * math.pi * i / n)] for i in range(n)]


def test_containing_regions(spark):
    rng = random.Random(5)
    outer = star(rng, 100, 30, 3, 24)
    hole = [[99.6, 29.6], [100.4, 29.6], [100.4, 30.4], [99.6, 30.4]]
    bow = [[90, 20], [94, 24], [94, 20], [90, 24]]
    parts = [star(rng, 110, 35, 2, 9), star(rng, 115, 33, 2, 30)]
    shapes = {"a": [[outer, hole]], "b": [[bow]], "c": [[p] for p in parts]}
    closed = lambda r: r + r[:1]
    rows = [
        ("a", json.dumps({"type": "Polygon", "coordinates": [closed(outer), closed(hole)]})), ("b", json.dumps({"type": "Polygon", "coordinates": [closed(bow)]})),
        ("c", json.dumps({"type": "MultiPolygon", "coordinates": [[closed(p)] for p in parts]})), ("bad", "{"), ("null", None), ("line", '{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}'),
    ]
    points = [(str(i), rng.uniform(88, 118), rng.uniform(18, 38)) for i in range(1500)] + [("x", 100.0, 31.0), ("y", 92.0, 22.0)]
    got = {(r[0], r[1]) for r in sp.containing_regions(spark.createDataFrame(points, "id string, lon double, lat double"), spark.createDataFrame(rows, "code string, boundary string")).collect()}
    want = {(i, code) for i, x, y in points for code, polygons in shapes.items() for rings in polygons if sum(ring_holds(r, x, y) for r in rings) % 2}
    assert got == want and len(want) > 50


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id string, lon double, lat double")
    one = spark.createDataFrame([("a", 1.0, 1.0)], "id string, lon double, lat double")
    assert sp.within_distance(none, one, 2.0).count() == sp.within_distance(one, none, 2.0).count() == 0
    assert sp.containing_regions(one, spark.createDataFrame([], "code string, boundary string")).count() == 0


def test_nearest_k_is_exact(spark):
    rng = random.Random(8)
    p = [(f"p{i}", *somewhere(rng)) for i in range(120)]
    t = [(f"t{i}", *somewhere(rng)) for i in range(40)] + [("p1", *p[1][1:])]
    schema = "id string, lon double, lat double"
    got = {}
    for r in rel.nearest_k(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), 3).collect():
        got.setdefault(r["point_id"], []).append((r["rank"], r["target_id"]))
    for x in p:
        best = sorted((km(x[1:], y[1:]), y[0]) for y in t if y[0] != x[0])[:3]
        mine = [i for _, i in sorted(got[x[0]])]
        assert len(mine) == 3 and all(abs(km(x[1:], next(y[1:] for y in t if y[0] == i)) - d) < 1e-6 for i, (d, _) in zip(mine, best))


def test_crowded_cells_are_dealt(spark):
    points = spark.createDataFrame([(str(i), 100.0 + i % 7 / 1e5, 30.0) for i in range(300)], "id string, lon double, lat double")
    centres = spark.createDataFrame([("c", 100.0, 30.0), ("d", 100.001, 30.0)], "id string, lon double, lat double")
    assert sp.within_distance(points, centres, 2.0, per_task=10).count() == sp.within_distance(points, centres, 2.0).count() == 600
    square = '{"type": "Polygon", "coordinates": [[[99, 29], [101, 29], [101, 31], [99, 31], [99, 29]]]}'
    regions = spark.createDataFrame([("r", square)], "code string, boundary string")
    assert sp.containing_regions(points, regions, per_task=10).count() == 300
    salted, repeated = sp.dealt(points.withColumn("k", F.lit(1)), centres.withColumn("k", F.lit(1)), ["k"], F.col("id"), 10)
    assert salted.select("salt").distinct().count() == 30 and repeated.count() == 60
