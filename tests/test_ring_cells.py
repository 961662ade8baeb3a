"""Cells of rings, worked out in one task a ring: none of them is shuffled."""

from cartoforge.operators import tiles


def test_ring_cells_and_homes(spark):
    """A square of 3 x 3 cells and a bit, closed: edge cells around, the middle one inside; the home cell is left out."""
    at = lambda k: k / 8
    v = [(115.5 + at(x), -32.5 + at(y)) for x, y in ((1.5, 1.5), (3.5, 1.5), (3.5, 3.5), (1.5, 3.5))]
    segs = [(7, a[1], a[0], b[1], b[0]) for a, b in zip(v, [*v[1:], v[0]])]
    rings = spark.createDataFrame(segs, "way_id long, lat double, lon double, lat2 double, lon2 double")
    homes = spark.createDataFrame([(7, 1, 1), (8, 2, 2)], "way_id long, ix long, iy long")
    want = {(7, x, y, (x, y) == (2, 2)) for x in (1, 2, 3) for y in (1, 2, 3)}
    assert set(map(tuple, tiles.ring_cells(rings, 8).collect())) == want
    assert set(map(tuple, tiles.ring_cells(rings, 8, homes=homes).collect())) == want - {(7, 1, 1, False)}
    assert [tuple(r) for r in tiles.interior_cells(rings, 8).collect()] == [(7, 2, 2)]


def test_interior_cells_are_not_shuffled(spark):
    rings = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0)], "way_id long, lat double, lon double, lat2 double, lon2 double")
    plan = tiles.interior_cells(rings, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the segments' only
