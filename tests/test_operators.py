"""Small cases of the map operators, made by hand."""

import pytest
from pyspark.sql import functions as F

from cartoforge.functions import grid, rules
from cartoforge.operators import address, graph, reconcile, spatial, tiles


def test_cells_are_half_open_and_wrap(spark):
    df = spark.createDataFrame([(1, -32.5, 115.5), (2, -31.5, 115.7), (3, -32.5, 116.5), (4, -32.0, 475.75), (5, None, 115.6)], "id int, lat double, lon double")
    got = {r.id: tuple(r.c) if r.c else None for r in df.select("id", grid.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).collect()}
    assert got == {1: (0, 0), 2: None, 3: None, 4: (16, 32), 5: None}


def test_quantise_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(-32.5 + 0.5 / 4096, 115.5 + 1.5 / 4096)], "lat double, lon double")
    x, y = grid.quantise(F.col("lat"), F.col("lon"), F.lit(0), F.lit(0), F.lit(1))
    assert tuple(df.select(x, y).first()) == (2, 0)


@pytest.mark.parametrize("text,want", [("12-16", (12, 16)), ("16-12", (12, 16)), ("7A", (7, 7)), ("3 / 9", (3, 9)), ("12-16B", (12, 12)), ("12A-16", (12, 12)), ("5–8", (5, 8)), ("2-4-6", (2, 2)), ("LOT", (0, 0)), ("", (0, 0)), (None, (0, 0))])
def test_house_numbers(spark, text, want):
    lo, hi = address.house_numbers(F.coalesce(F.col("t"), F.lit("")))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(lo, hi).first()) == want


def test_rules_refuse_unknown_names():
    with pytest.raises(ValueError):
        rules.predicate([["nope", "==", 1]], ["a"])
    with pytest.raises(ValueError):
        rules.predicate([["a", "~", 1]], ["a"])


def test_split_leaves_out_what_is_outside_and_keeps_order(spark):
    points = spark.createDataFrame([(1, 0, -32.25, 115.25), (1, 1, -32.25, 115.75), (1, 2, -32.25, 116.75)], "way_id long, pos int, lat double, lon double")
    grids = spark.createDataFrame([(0, 2)], "level int, n long")
    got = sorted(map(tuple, tiles.split_by_cell(tiles.segments(points), grids).select("ordinal", "ix", "iy").collect()))
    assert got == [(0, 0, 0), (1, 1, 0)]


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_hang_on_partitioning(spark, sf_dir, parts):
    from cartoforge.sources.adapters import view

    ids = lambda df: sorted(map(tuple, address.index(df)["streets"].collect()))
    points = view(spark, sf_dir, "address_points")
    assert ids(points.repartition(parts)) == ids(points)


def test_components_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 2.0)], "u long, v long, w double")
    assert sorted(map(tuple, graph.components(e).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    got = sorted(map(tuple, graph.shortest_paths(e, spark.createDataFrame([(1,)], "src long")).collect()))
    assert got == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0)]


def test_points_in_rings(spark):
    square = [(0, 0.0, 0.0, 10.0, 0.0), (0, 10.0, 0.0, 10.0, 10.0), (0, 10.0, 10.0, 0.0, 10.0), (0, 0.0, 10.0, 0.0, 0.0)]
    e = spark.createDataFrame(square, "ring int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, -1.0, 5.0)], "id int, x double, y double")
    assert [r.id for r in spatial.points_in_rings(p, e, 4.0).collect()] == [1]


def test_exactly_once_names_every_problem(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["x", "y", None], ["y", "y", "z"]))
    got = {tuple(r) for r in reconcile.exactly_once(a, b, ["k"]).collect()}
    assert got == {("x", "missing"), ("y", "duplicate"), ("z", "foreign"), (None, "missing")}


def test_no_spatial_join_compares_all_pairs(spark):
    p = spark.createDataFrame([(1, "a", 1.0, 2.0)], "id int, kind string, x double, y double")
    plan = spatial.nearest_point(p, p, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_parts_of_ways_are_not_sorted_again(spark, monkeypatch):
    """Whatever is worked out at a time, chains are the same; only segments pass a window, and ids sort ways and not chains."""
    from cartoforge.operators import tiles

    monkeypatch.setattr(tiles, "_PARTS", 3)
    points = spark.createDataFrame([(w, i, -32.45 + 0.07 * ((w * 7 + i * 5) % 11), 115.4 + 0.13 * ((w * 3 + i * 4) % 9)) for w in range(9) for i in range(5)], "way_id long, pos int, lat double, lon double")
    grids = spark.createDataFrame([(0, 8), (2, 4)], "level int, n long")
    small = tiles.split_by_cell(tiles.segments(points), grids)
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    rows = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(tiles, "_PARTS", 1 << 18)
    assert rows == sorted(map(tuple, tiles.split_by_cell(tiles.segments(points), grids).collect())) and len({r[1] for r in rows}) == 9
    assert sorted(map(tuple, tiles.link_ids(small).collect())) == [(*r[:3], i + 1) for i, r in enumerate(rows)]


def test_islands_are_cut_in_their_task(spark):
    from cartoforge.operators import tiles

    rows = [(1, 0, 5), (1, 1, 5), (1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 4, 5), (2, 9, None), (2, 11, None), (2, 12, 7)]
    got = tiles.islands(spark.createDataFrame(rows, "way_id long, pos int, cell long"), 3)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 1, 2), (1, 2, 2, 2, 1), (1, 3, 3, 3, 1), (2, 1, 4, 4, 1), (2, 2, 9, 9, 1), (2, 3, 11, 11, 1), (2, 4, 12, 12, 1)]
    assert tiles.islands(spark.createDataFrame([], "way_id long, pos int, cell long"), 3).count() == 0


def test_w04_holds_no_window_of_all_points(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["w04_islands"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(fresh" not in plan and "RepartitionByExpression [way_id" in plan


def test_j26_deals_each_clip_once(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["j26_producers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and "RepartitionByExpression [cx" in plan


def test_paths_leave_long_edges_out(spark, monkeypatch):
    from cartoforge.operators import graph

    kept, keep = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(df.count()) or keep(df))
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (1, 3, 20.0), (3, 4, 10.0)], "u long, v long, w double")
    got = graph.shortest_paths(edges, spark.createDataFrame([(1,)], "src long"), most_cost=10.0)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.0), (1, 2, 5.0), (1, 3, 9.0)] and kept[0] == 3
