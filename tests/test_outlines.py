"""Vertices against outlines and insides, on cases made by hand."""

import random

from pyspark.sql import functions as F

from cartoforge.operators.outlines import outline_check, outline_summary, passed_buckets

RINGS = "kind int, ring long, v array<struct<x double, y double>>"


def ring(k, n, *v):
    return (k, n, [(float(x), float(y)) for x, y in v])


def check(spark, vertices, rings):
    v = spark.createDataFrame([(k, i, float(x), float(y), e) for i, (k, x, y, e) in enumerate(vertices)], "kind int, id long, x double, y double, e boolean")
    return outline_check(v, spark.createDataFrame(rings, RINGS), ["kind"], F.col("e"), 0.5, 4.0)


def test_interior_needs_an_outline_and_edges_an_inside(spark):
    square = [ring(1, 7, (0, 0), (20, 0), (20, 20), (0, 20)), ring(2, 7, (40, 40), (60, 40), (50, 55))]
    vertices = [
        (1, 10, 0.4, False),  # by the outline
        (1, 10, 10, False),  # deep inside, on none
        (1, 10, 10, True),  # the same on its cell's edge
        (1, 30, 10, True),  # outside all
        (2, 10, 10, True),  # inside a ring of another kind
        (1, 20.5, 20.5, False),  # the tolerance itself, at a corner
        (1, 20.6, 20, False),
        (None, 10, 0, True),
        (1, 10, 0, True),  # on the outline and on the edge
    ]
    out = check(spark, vertices, square)
    assert {r["id"]: (r["ok"], r["inside"]) for r in out.collect()} == {0: (True, False), 1: (False, False), 2: (True, True), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False), 7: (False, False), 8: (True, False)}
    assert outline_summary(out, ["kind"]).where("kind = 1 and on_edge").first().asDict() == {"kind": 1, "on_edge": True, "checked": 3, "failing": 1, "by_inside": 1, "worst": 0.0}
    assert check(spark, vertices, []).where("ok").count() == 0


def test_a_hole_and_a_long_edge(spark):
    """Two copies of a ring don't cancel out, and an edge over hundreds of buckets is met anywhere."""
    long = ring(1, 1, (0, 0), (1000, 500), (0, 900))
    twice = [long, (1, 2, long[2])]
    got = {r["id"]: r["ok"] for r in check(spark, [(1, 600, 300.3, False), (1, 600, 302, False), (1, 100, 400, True), (1, 990, 10, True)], twice).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_edges_pass_the_buckets_of_their_points(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        rows.append((i, *(rng.uniform(-30, 30) for _ in range(4))))
    rows += [(90, 3.0, -9.0, 3.0, 17.0), (91, -8.0, 4.0, 12.0, 4.0), (92, 4.0, 4.0, 4.0, 4.0)]
    passed = {(r["i"], r["bx"], r["by"]) for r in passed_buckets(spark.createDataFrame(rows, "i long, x1 double, y1 double, x2 double, y2 double"), 0.5, 4.0).collect()}
    for i, x1, y1, x2, y2 in rows:
        for k in range(101):
            for dx in (-0.5, 0.5):
                for dy in (-0.5, 0.5):
                    t = k / 100
                    assert (i, int((x1 + t * (x2 - x1) + dx) // 4), int((y1 + t * (y2 - y1) + dy) // 4)) in passed
