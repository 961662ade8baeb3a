"""Rings that hold points, and segments near them, against plain Python."""

import random

from cartoforge.operators import containment, spatial


def holds(v, x, y):
    n = 0
    for (px, py), (qx, qy) in zip([v[-1], *v], v):
        n += (py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py)
    return n % 2 == 1


def test_rings_at_points(spark):
    """Rows of many points, several parts and bands, rings that cross themselves, points on vertices and edges; no pair is a row."""
    rnd = random.Random(5)
    rings = [(k, rnd.choice("ab"), [(float(rnd.randrange(64)), float(rnd.randrange(64))) for _ in range(rnd.choice([3, 4, 5, 7]))]) for k in range(60)]
    points = [(k, rnd.choice("ab"), rnd.choice([rnd.uniform(0, 64), float(rnd.randrange(64))]), float(rnd.randrange(0, 64, 8))) for k in range(150)] + [(900, "a", 1.5, 1000.0), (901, "c", 5.0, 5.0)]
    r = spark.createDataFrame([(k, kind, [{"x": x, "y": y} for x, y in v]) for k, kind, v in rings], "ring long, kind string, v array<struct<x: double, y: double>>")
    p = spark.createDataFrame(points, "id long, kind string, x double, y double")
    want = {}
    for i, kind, x, y in points:
        if held := [k for k, other, v in rings if other == kind and holds(v, x, y)]:
            want[i] = (len(held), min(held))
    for band, most in ((16.0, 5), (100.0, 65536)):
        assert {s["id"]: (s["rings"], s["first"]) for s in containment.rings_at_points(p, r, band, most).collect()} == want


def test_points_where_segments_begin_meet_no_others(spark, monkeypatch):
    segs = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (5.0, 1.0, 9.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 1.0), (3, 4.0, 5.0), (4, 50.0, 50.0)], "id long, x double, y double")
    got = {r["id"]: round(r["distance"], 6) for r in spatial.nearest_segment(points, segs, 2.0, 4.0).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.707107}

    def none(*_):
        raise AssertionError("segments are put in buckets")

    monkeypatch.setattr(spatial, "buckets", none)
    assert {r["id"]: r["distance"] for r in spatial.nearest_segment(points.where("id < 3"), segs, 2.0, 4.0).collect()} == {1: 0.0, 2: 0.0}
