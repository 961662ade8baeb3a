"""Nearest points where they lie much closer than the reach that the search starts with, against plain Python."""

import random

from cartoforge.operators import matching
from cartoforge.sources.lineage import cut_lineage


def test_nearest_in_a_crowd_and_far_from_it(spark):
    rnd = random.Random(3)
    cloud = [(k, rnd.uniform(0, 1), rnd.uniform(0, 1)) for k in range(2000)] + [(5000, 40.0, 40.0), (4999, 40.0, 40.0)]
    samples = [(k, 0, rnd.uniform(0, 1), rnd.uniform(0, 1)) for k in range(200)] + [(900, 1, 39.0, 40.0), (901, 2, 20.0, 20.0)]
    w = spark.createDataFrame(cloud, "way_id long, x double, y double")
    s = cut_lineage(spark.createDataFrame(samples, "line_id long, i int, x double, y double"))
    assert matching._reach(w.withColumnsRenamed({"x": "wx", "y": "wy"}), 1.0) < 0.2
    want = {(k, i): min(((x - u) * (x - u) + (y - v) * (y - v), way) for way, u, v in cloud) for k, i, x, y in samples}
    assert {(r["line_id"], r["i"]): (r["d"], r["near"]) for r in matching.nearest(s, "line_id", w, 1.0).collect()} == want
    near = {k: v for k, v in want.items() if v[0] <= 2.25}
    assert {(r["line_id"], r["i"]): (r["d"], r["near"]) for r in matching.nearest(s, "line_id", w, 1.0, limit=1.5).collect()} == near
    assert not matching.nearest(s.limit(0), "line_id", w, 1.0).count() and not matching.nearest(s, "line_id", w.limit(0), 1.0).count()
