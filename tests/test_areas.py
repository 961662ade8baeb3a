"""Relations' rings, pairs of polygons and lines along ways, on cases made by hand."""

import random

import numpy as np
import pytest

from cartoforge.operators import address, matching, multipolygon

MEMBERS = "rel_id long, seq long, role string, type string, way_id long"
POINTS = "way_id long, pos int, node_id long, x double, y double"


def relation(spark, members, ways, at):
    """members: (rel, seq, role, type, way); ways: way -> nodes; at: node -> (x, y)."""
    points = [(w, i, n, *map(float, at(n))) for w, nodes in ways.items() for i, n in enumerate(nodes)]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(points, POINTS)


def circle(n):
    return lambda k: (10 + 8 * np.cos(2 * np.pi * k / n), 10 + 8 * np.sin(2 * np.pi * k / n))


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8, 9, 37])
def test_rings_of_many_members_come_out_in_order(spark, k):
    n, rng = 3 * k, random.Random(k)
    ways, members = {}, []
    for j in range(k):
        nodes = [(3 * j + i) % n for i in range(4)]
        ways[100 + j] = nodes[::-1] if rng.random() < 0.5 else nodes
    for seq, w in enumerate(rng.sample(sorted(ways), k)):
        members.append((1, seq * 3 + 2, rng.choice(["", "outer"]), "w", w))
    status, rings = multipolygon.rings(*relation(spark, members, ways, circle(n)))
    assert [(r.rel_id, r.fault, r.members) for r in status.collect()] == [(1, None, k)]
    (ring,) = rings.collect()
    assert ring.ring == 2 and len(ring.nodes) == n + 1 and ring.nodes[0] == ring.nodes[-1] and sorted(ring.nodes[:-1]) == list(range(n))
    first = ways[next(m[4] for m in members if m[1] == 2)]
    assert ring.nodes[:4] == first  # the first member is walked forward
    assert {abs(a - b) for a, b in zip(ring.nodes, ring.nodes[1:])} <= {1, n - 1}


def test_faults(spark):
    square = {1: [1, 2, 3], 2: [3, 4, 1], 3: [5, 6, 7, 5], 4: [1, 9, 3], 5: [8, 8]}
    made = {
        1: [("outer", "w", 1), ("", "w", 2), ("inner", "w", 3), ("label", "n", 7), ("admin_centre", "w", 99)],
        2: [("outer", "w", 1)],
        3: [("outer", "w", 1), ("outer", "w", 2), ("outer", "w", 4)],
        4: [("outer", "w", 1), ("outer", "w", 77)],
        5: [("outer", "w", 1), ("outer", "w", 2), ("outer", "r", 3)],
        6: [("inner", "w", 3)],
        7: [("outer", "w", 5)],
        8: [("outer", "w", 3), ("outer", "w", 1), ("outer", "w", 2)],
        9: [("outer", "w", 1), ("inner", "w", 2)],
    }
    members = [(rel, i, *m) for rel, ms in made.items() for i, m in enumerate(ms)]
    status, rings = multipolygon.rings(*relation(spark, members, square, lambda n: (n % 3, n // 3)))
    assert {r.rel_id: r.fault for r in status.collect()} == {1: None, 2: "open", 3: "branch", 4: "missing", 5: "nested", 6: "no_outer", 7: "degenerate", 8: None, 9: "open"}
    assert sorted((r.rel_id, r.role, r.ring) for r in rings.collect()) == [(1, "inner", 2), (1, "outer", 0), (8, "outer", 0), (8, "outer", 1)]
    small = multipolygon.rings(*relation(spark, members, square, lambda n: (n % 3, n // 3)), most_vertices=8)[0]
    assert {r.rel_id: r.fault for r in small.collect()}[1] == "too_large"


def rings_of(spark, rows):
    data = [(rel, role, i, list(range(10 * i, 10 * i + len(v))) + [10 * i], [*v, v[0]]) for i, (rel, role, v) in enumerate(rows)]
    return spark.createDataFrame(data, "rel_id long, role string, ring long, nodes array<long>, v array<struct<x:double,y:double>>")


def box(a, b, c, d):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]


def test_validity_names_each_kind_of_fault(spark):
    made = rings_of(spark, [
        (1, "outer", box(0, 0, 9, 9)), (1, "inner", box(1, 1, 3, 3)), (1, "inner", box(5, 5, 7, 7)),
        (2, "outer", [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]),
        (3, "outer", box(0, 0, 9, 9)), (3, "outer", box(2, 2, 4, 4)),
        (4, "outer", box(0, 0, 9, 9)), (4, "inner", box(20, 1, 23, 3)),
        (5, "outer", box(0, 0, 9, 9)), (5, "inner", box(1, 1, 8, 8)), (5, "inner", box(2, 2, 3, 3)),
        (6, "outer", box(0, 0, 9, 9)), (6, "outer", box(9, 3, 12, 6)),
    ])
    got = {r.rel_id: (r.repeated, r.crossings > 0, r.nested_outers, r.loose_holes, r.nested_holes, r.valid) for r in multipolygon.validity(made, 1.5).collect()}
    assert got[1] == (0, False, 0, 0, 0, True) and got[2] == (0, True, 0, 0, 0, False) and got[3] == (0, False, 1, 0, 0, False)
    assert got[4] == (0, False, 0, 1, 0, False) and got[5] == (0, False, 0, 0, 1, False) and got[6] == (0, True, 0, 0, 0, False)
    wide = {r.rel_id: r.crossings for r in multipolygon.validity(made, 100.0).collect()}
    assert wide == {r.rel_id: r.crossings for r in multipolygon.validity(made, 0.7).collect()}


def test_a_clipped_compound_ring_keeps_its_hole(spark):
    from pyspark.sql import functions as F

    from cartoforge.functions import rings as R

    made = rings_of(spark, [(1, "outer", box(0, 0, 16, 16)), (1, "inner", box(4, 4, 12, 12)[::-1])])
    cut = multipolygon.clipped_to_cells(multipolygon.stitched(made), 8, 0, 1)
    got = {(r.cx, r.cy): r.a for r in cut.select("cx", "cy", F.abs(R.area(F.col("v"))).alias("a")).collect()}
    assert got == {(x, y): 48.0 for x in (0, 1) for y in (0, 1)}


def test_lines_follow_their_way(spark):
    rng = np.random.default_rng(4)
    ways = {w: np.cumsum(rng.normal(0, 2, (5, 2)), 0) + rng.uniform(0, 60, 2) for w in range(30)}
    lines = {k: ways[3 * k][:3] + rng.normal(0, 0.05, (3, 2)) for k in range(8)} | {99: np.array([[500.0, 500.0], [500.5, 500.0]])}
    rows = lambda d: [(k, i, float(x), float(y)) for k, p in d.items() for i, (x, y) in enumerate(p)]
    got = {r.k: (r.way_id, r.votes, r.distance) for r in matching.matched_ways(spark.createDataFrame(rows(lines), "k long, pos int, x double, y double"), spark.createDataFrame(rows(ways), "way_id long, pos int, x double, y double"), "k", 0.25).collect()}

    def dense(p):
        out = [p[:1]]
        for a, b in zip(p, p[1:]):
            n = max(1, int(np.ceil(np.hypot(*(b - a)) / 0.25)))
            out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
        return np.vstack(out)

    def off(p, way):
        best = np.full(len(p), np.inf)
        for a, b in zip(way, way[1:]):
            t = np.clip(((p - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
            best = np.minimum(best, np.hypot(*(p - a - t[:, None] * (b - a)).T))
        return float(np.median(best))

    cloud = [(w, dense(p)) for w, p in ways.items()]
    for k, p in lines.items():
        d = dense(p)
        few = d if len(d) <= 40 else d[[i * (len(d) - 1) // 39 for i in range(40)]]
        votes = {}
        for q in few:
            w = min((float(((c - q) ** 2).sum(1).min()), w) for w, c in cloud)[1]
            votes[w] = votes.get(w, 0) + 1
        top = sorted(votes, key=lambda w: (-votes[w], w))[:3]
        best, w = min((off(d, ways[w]), w) for w in top)
        assert got[k][:2] == (w, votes[w]) and abs(got[k][2] - best) < 1e-9
    assert [got[k][0] for k in range(8)] == [3 * k for k in range(8)]


def test_pairs_of_polygons(spark):
    a = box(10, 10, 50, 50)
    shapes = {1: a, 2: [*a[2:], *a[:2]], 3: a[::-1], 4: box(20, 20, 30, 30), 5: box(45, 12, 90, 49), 6: box(50, 10, 90, 50), 7: box(300, 300, 320, 320), 8: box(9.5, 20, 30, 30)}
    rows = [("c", k, v) for k, v in shapes.items()] + [("other", 9, a)]
    got = matching.polygon_pairs(spark.createDataFrame(rows, "cell string, id int, v array<struct<x:double,y:double>>"), ["cell"], 16.0).collect()
    kinds = {(r.a, r.b): r.relation for r in got}
    assert {p: kinds.get(p) for p in ((1, 2), (1, 3), (2, 3), (1, 4), (4, 8), (1, 8), (1, 5), (1, 6), (5, 6), (1, 7))} == {
        (1, 2): "equal", (1, 3): "equal", (2, 3): "equal", (1, 4): "contains", (4, 8): "inside", (1, 8): "contains", (1, 5): "overlaps", (1, 6): None, (5, 6): None, (1, 7): None
    }
    assert all(r.cell == "c" for r in got)
    share = next(r.area for r in got if (r.a, r.b) == (1, 5))
    assert abs(share - 5 * 37) < 30


def test_state_codes(spark):
    states = spark.createDataFrame([(201, "Asia"), (202, "Europe")], "suffix int, state string")
    rows = spark.createDataFrame([(1, "asia"), (2, "202"), (3, None)], "k int, code string")
    assert sorted((r.k, r.suffix, r.state) for r in address.state_suffix(rows, "code", states, 202).collect()) == [(1, 201, "Asia"), (2, 202, "Europe"), (3, 202, "Europe")]
    with pytest.raises(Exception, match="unknown state code: MARS"):
        address.state_suffix(spark.createDataFrame([(1, "mars")], "k int, code string"), "code", states, 201).collect()


def test_ways_without_a_link_of_the_other_product(spark):
    line = lambda w, *at: [(w, i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    shape = "way_id long, pos int, x double, y double"
    ways = line(1, (0, 0), (4, 0)) + line(2, (0, 3), (4, 3)) + line(3, (0, 1), (8, 1)) + line(4, (50, 50), (51, 50)) + line(5, (0, 0.9), (0, 2.5))
    links = spark.createDataFrame(line(9, (0, 0), (4, 0)), shape)
    got = {r.way_id: r for r in matching.unmatched_ways(spark.createDataFrame(ways, shape), links, 1.0, 0.5).collect()}
    # way 5: samples at 0.9, 1.3, 1.7, 2.1, 2.5 from the link; way 3 leaves it halfway, its middle sample is 1 away
    assert {w: r.unmatched for w, r in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert got[3].samples == 17 and got[4].samples == 3
    even = spark.createDataFrame(line(6, (2, 0.2), (2, 1.9)) + line(7, (2, 0.2), (2, 1.7)), shape)
    assert {r.way_id: r.unmatched for r in matching.unmatched_ways(even, links, 1.0, 2.0).collect()} == {6: True, 7: False}
    none = matching.unmatched_ways(even, links.limit(0), 1.0, 2.0)
    assert [tuple(r) for r in matching.disagreement(none).collect()] == [(2, 2, 1.0)]
    assert [tuple(r) for r in matching.disagreement(none.limit(0)).collect()] == [(0, 0, None)]


def test_a_strip_on_an_edge_is_a_flat_clip_of_the_cell_below(spark):
    """The column 8..16 holds only what lies above y = 8, and three vertices on it."""
    ring = [(0.0, 0.0), (8.0, 8.0), (10.0, 8.0), (16.0, 8.0), (16.0, 12.0), (0.0, 12.0)]
    shapes = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "rel_id long, v array<struct<x double, y double>>")
    got = {(r.cx, r.cy): r.v for r in multipolygon.clipped_to_cells(shapes, 8, 0, 2).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert {p["y"] for p in got[(1, 0)]} == {8.0} and {p["x"] for p in got[(1, 0)]} == {8.0, 10.0, 16.0}


def test_points_of_a_lattice_lie_inside_as_in_spark(spark):
    """Rings of three to six vertices and of two, in one batch, against the column expression."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from cartoforge.functions import rings as R

    rng = np.random.default_rng(8)
    rings = [[{"x": float(x), "y": float(y)} for x, y in rng.integers(0, 9, (k, 2))] for k in (3, 6, 2, 4, 5, 3)]
    points = [(x + 0.5, y + 0.25) for x in range(9) for y in range(9)] + [(3.0, 3.0), (4.0, 4.0)]
    px, py = (np.tile([p[i] for p in points], (len(rings), 1)) for i in (0, 1))
    got = matching._holds(pa.array(rings), px, py)
    df = spark.createDataFrame(list(enumerate(rings)), "k int, v array<struct<x double, y double>>").crossJoin(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, x double, y double"))
    want = {(r.k, r.i): r.h for r in df.select("k", "i", R.holds(F.col("v"), F.col("x"), F.col("y")).alias("h")).collect()}
    assert all(bool(got[k, i]) == h for (k, i), h in want.items()) and len(want) == got.size and got.any() and not got[2].any()
