"""Merged intersections, on streets made by hand."""

import pytest

from cartoforge.operators import clusters

LINK = "way_id long, seg long, forward boolean, u long, v long, length double, road_class int"


def links(spark, streets):
    """streets: (way, seg, u, v, metres, one way)."""
    rows = [(w, s, True, u, v, float(m), 5) for w, s, u, v, m, _ in streets]
    return spark.createDataFrame(rows + [(w, s, False, v, u, float(m), 5) for w, s, u, v, m, one in streets if not one], LINK)


def groups(spark, link, rings=(), boundary=()):
    rings = spark.createDataFrame(list(rings), "way_id long, node_id long")
    return clusters.intersection_groups(link, rings, spark.createDataFrame([(b,) for b in boundary], "node_id long"))


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_short_links_and_roundabouts_join(spark):
    link = links(spark, [(1, 1, 10, 11, 20, False), (1, 2, 11, 12, 20.01, False), (2, 1, 12, 13, 5, True), (3, 1, 13, 14, 5, False), (4, 1, 20, 21, 90, False), (4, 2, 21, 22, 90, False), (5, 1, 30, 31, 3, False)])
    rings = [(4, 20), (4, 21), (4, 22), (4, 20), (4, 99), (6, 30), (6, 98)]
    assert plain(groups(spark, link, rings, [14, 31]), "node_id", "label") == [(10, 10), (11, 10), (12, 12), (13, 12), (20, 20), (21, 20), (22, 20)]
    assert plain(groups(spark, link.limit(0)), "node_id") == []


def test_members_beyond_the_cap_stay_alone(spark):
    link = links(spark, [(k, 1, 1, k, 10, False) for k in range(2, 9)] + [(50, 1, 7, 100, 300, False), (51, 1, 8, 101, 300, False)])
    g = groups(spark, link)
    assert len(plain(g, "node_id")) == 8
    kept = clusters.members(g, link)
    assert plain(kept, "k", "node_id", "rep") == [(1, 1, 1), (2, 7, 1), (3, 8, 1), (4, 2, 1), (5, 3, 1), (6, 4, 1)]
    m = clusters.merged_links(link, kept)
    assert plain(m.where("forward"), "way_id", "cu", "cv", "internal") == [(2, 1, 1, True), (3, 1, 1, True), (4, 1, 1, True), (5, 1, 5, False), (6, 1, 6, False), (7, 1, 1, True), (8, 1, 1, True), (50, 1, 100, False), (51, 1, 101, False)]
    assert plain(m.where("internal"), "composition", "way_id") == [(i, w) for i, w in enumerate((2, 3, 4, 7, 8), 1) for _ in "xy"]


def test_composition_lists_fifteen_segments(spark):
    link = links(spark, [(w, 1, 1, 2, 10, True) for w in range(1, 20)] + [(90, 1, 2, 1, 10, True)])
    m = clusters.merged_links(link, clusters.members(groups(spark, link), link))
    assert {r.way_id: r.composition for r in m.collect()} == {**{w: w if w <= 15 else None for w in range(1, 20)}, 90: None}


def test_offsets_are_clamped(spark):
    kept = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "rep long, node_id long, k int")
    at = spark.createDataFrame([(1, 60.0, 10.0), (2, 60.0 + 12.2 / 111320, 10.0 - 30.4 / 55660), (3, 59.0, 11.0)], "node_id long, lat double, lon double")
    assert plain(clusters.member_offsets(kept, at), "node_id", "rep", "k", "dx", "dy") == [(2, 1, 2, -30, 12), (3, 1, 3, 127, -127)]


@pytest.mark.parametrize("via, a, b, status", [(1, 10, 20, "kept"), (1, 10, 12, "exit_merged"), (1, 12, 10, "entry_merged"), (1, 10, 77, "unresolved"), (1, 77, 10, "no_entry"), (1, 10, 30, "unresolved"), (1, 10, None, "unresolved")])
def test_regulations(spark, via, a, b, status):
    link = links(spark, [(12, 1, 1, 2, 10, False), (10, 1, 1, 5, 100, False), (20, 1, 1, 6, 100, False), (30, 1, 7, 1, 100, True)])
    m = clusters.merged_links(link, clusters.members(groups(spark, link), link))
    turns = spark.createDataFrame([(1, via, a, b)], "rel_id long, via long, from_way long, to_way long")
    assert plain(clusters.regulations_left(turns, m), "rel_id", "status") == [(1, status)]
