"""Links over ways, on one cell made by hand."""

import pytest

from cartoforge.operators.overlay import clip_counts, criteria, occupied, overlay

LINKS = "link_id long, cx int, cy int, pos int, x double, y double"
WAYS = "way_id long, pos int, x double, y double"


def test_a_cell_that_passes_and_one_that_does_not(spark):
    links = [
        (1, 0, 0, 0, 0.0, 2.0), (1, 0, 0, 1, 4.0, 2.0),  # edge to edge, on way 1
        (2, 0, 0, 0, 0.0, 3.0), (2, 0, 0, 1, 4.0, 3.1),
        (3, 1, 0, 0, 4.01, 2.0), (3, 1, 0, 1, 5.0, 2.0),  # near the edge, not on it
        (4, 1, 0, 0, 6.0, 3.9), (4, 1, 0, 1, 7.0, 3.9),  # on no way
        (5, 9, 9, 0, 37.0, 37.0),  # one point, no way in the cell
    ]
    ways = [(1, 0, -1.0, 2.05), (1, 1, 5.0, 2.05), (2, 0, 0.0, 3.05), (2, 1, 4.0, 3.05)]
    got = {(r["cx"], r["cy"]): r for r in criteria(overlay(spark.createDataFrame(links, LINKS), spark.createDataFrame(ways, WAYS), 4.0, 0.2, 0.1)).collect()}
    a, b, c = got[0, 0], got[1, 0], got[9, 9]
    assert (a["links"], a["matched_fraction"], a["ends"], a["exact"], a["clip_share"], a["reach"], a["inside"]) == (2, 1.0, 4, 4, 1.0, 1.0, 1.0)
    assert a["distance_p50"] == pytest.approx(0.0375, abs=0.002) and a["occupied_links"] >= 2 * 16 / 256 and a["passed"]
    assert (b["matched_fraction"], b["ends"], b["exact"], b["within_tolerance"], b["clipped_at_edge"], b["passed"]) == (0.5, 1, 0, False, False, False)
    assert (c["ends"], c["clip_share"], c["occupied_ways"], c["occupied_ratio"], c["no_clustering"], c["occupied_links"]) == (0, None, 0.0, None, False, 1 / 256)


def test_no_ways(spark):
    links = spark.createDataFrame([(1, 0, 0, 0, 0.0, 2.0), (1, 0, 0, 1, 4.0, 2.0)], LINKS)
    r = criteria(overlay(links, spark.createDataFrame([], WAYS), 4.0, 0.2, 0.1)).first()
    assert (r["links"], r["matched_fraction"], r["distance_p50"], r["passed"]) == (1, 0.0, None, False)


def test_parts(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 0, 4.0, 4.0), (0, 0, 3.99, 3.99), (0, 0, 4.1, 1.0), (2, 0, 8.0, 0.0)], "cx int, cy int, x double, y double")
    assert sorted(map(tuple, occupied(p, 4.0, 4).collect())) == [(0, 0, 2 / 16), (2, 0, 1 / 16)]
    one = spark.createDataFrame([(1, 0, 0, 0, 0.0, 1.0)], LINKS)
    assert tuple(clip_counts(one, 4.0, 0.01).first()) == (0, 0, 2, 2)
