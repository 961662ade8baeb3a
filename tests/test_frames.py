"""Frames beside each other, on a small plan made by hand: a frame of four slots, one-slot frames around it, gaps."""

from cartoforge.operators.frames import corner_frames, frame_neighbours, frames_of, mirrored_nodes
from pyspark.sql import functions as F

PLAN = [(0, 4, 4, 4), (0, 8, 4, 1), (0, 8, 6, 1), (0, 3, 3, 1), (0, 4, 3, 1), (0, 0, 8, 4), (2, 4, 4, 1)]


def plan(spark):
    return spark.createDataFrame(PLAN, "level int, fx long, fy long, n long")


def found(df, fx, fy):
    return sorted((r["place"], r["status"], r["tx"], r["ty"], r["tn"], r["crossing"]) for r in df.where(f"level = 0 and fx = {fx} and fy = {fy}").collect())


def test_edges(spark):
    t = frame_neighbours(plan(spark), 8, 2)
    assert found(t, 4, 4) == [("E", "resolved", 8, 4, 1, "cross_block"), ("E", "resolved", 8, 6, 1, "cross_block"), ("N", "empty_slot", None, None, None, None), ("S", "resolved", 4, 3, 1, "same_block"), ("W", "empty_slot", None, None, None, None)]
    assert found(t, 8, 6) == [("E", "empty_slot", None, None, None, None), ("N", "empty_slot", None, None, None, None), ("S", "empty_slot", None, None, None, None), ("W", "resolved", 4, 4, 4, "cross_block")]
    assert ("W", "outside_coverage", None, None, None, None) in found(t, 0, 8)
    assert t.where("level = 2").select("status").distinct().collect() == [("empty_slot",)]


def test_corners(spark):
    t = corner_frames(plan(spark), 8, 2)
    got = found(t, 4, 4)
    assert [g for g in got if g[0] == "SW"] == [("SW", "resolved", 3, 3, 1, "same_block"), ("SW", "resolved", 4, 3, 1, "same_block")]
    assert [g for g in got if g[0] == "SE"] == [("SE", "resolved", 8, 4, 1, "cross_block")]
    assert [g for g in got if g[0] == "NW"] == [("NW", "resolved", 0, 8, 4, "cross_block")]
    assert [g for g in got if g[0] == "NE"] == [("NE", "empty_slot", None, None, None, None)]


def test_frames_and_mirrors(spark):
    slots = spark.createDataFrame([(0, 5, 6), (0, 7, 7), (0, -1, 0)], "level int, gx long, gy long")
    assert sorted(map(tuple, frames_of(slots, F.lit(4)).collect())) == [(0, -4, 0, 4), (0, 4, 4, 4)]
    nodes = [(0, 4, 4, 4, 64, 40), (0, 8, 4, 1, 64, 40), (0, 4, 4, 4, 64, 50), (0, 4, 4, 4, 32, 32), (0, 3, 3, 1, 32, 32), (0, 4, 4, 4, 40, 64), (0, 4, 4, 4, 40, 40), (0, 4, 4, 4, 64, 50)]
    m = mirrored_nodes(spark.createDataFrame(nodes, "level int, fx long, fy long, n long, x long, y long"), plan(spark), 8, 8, 2)
    assert sorted((r["fx"], r["x"], r["y"], r["place"], r["status"], r["mirrored"]) for r in m.collect()) == [
        (3, 32, 32, "NE", "resolved", True), (4, 32, 32, "SW", "resolved", True), (4, 40, 64, "N", "empty_slot", None), (4, 64, 40, "E", "resolved", True), (4, 64, 50, "E", "resolved", False), (8, 64, 40, "NW", "resolved", True),
    ]
