"""Frames of one or several slots of a lattice: who lies beside whom, and whether nodes on a common edge are held by both.

frames: level, fx, fy (lower corner, in slots), n (slots a side). A frame is multiplied by its own edge at most, and meets others
by equal slots; no pair of frames is compared that shares none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = ["level", "fx", "fy", "n"]
SIDES = {"E": (1, 0), "N": (0, 1), "S": (0, -1), "W": (-1, 0)}
CORNERS = {"NE": (1, 1), "NW": (0, 1), "SE": (1, 0), "SW": (0, 0)}


def frames_of(slots: DataFrame, size: Column) -> DataFrame:
    """Distinct frames of slots (level, gx, gy): `size` slots a side, aligned to multiples of it."""
    s = slots.withColumn("n", size.cast("long"))
    return s.select("level", (F.col("gx") - F.pmod("gx", "n")).alias("fx"), (F.col("gy") - F.pmod("gy", "n")).alias("fy"), "n").distinct()


def frame_slots(frames: DataFrame) -> DataFrame:
    """frames once for each slot (gx, gy) that they span."""
    run = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + F.col("n") - 1))
    return frames.select(*FRAME, run("fx").alias("gx")).select(*FRAME, "gx", run("fy").alias("gy"))


def crossing(ax: Column, ay: Column, bx: Column, by: Column, block: int, blockset: int) -> Column:
    """same_block, cross_block (of one set) or cross_blockset of two slots; block: slots a side, blockset: blocks a side."""
    same = lambda k: (F.floor(ax / k) == F.floor(bx / k)) & (F.floor(ay / k) == F.floor(by / k))
    return F.when(same(block), "same_block").when(same(block * blockset), "cross_block").otherwise("cross_blockset")


def _resolved(asked: DataFrame, frames: DataFrame, block: int, blockset: int) -> DataFrame:
    """asked: frames with place and a slot (gx, gy) a row."""
    slots = frame_slots(frames)
    at = slots.select("level", "gx", "gy", F.struct(F.col("fx").alias("tx"), F.col("fy").alias("ty"), F.col("n").alias("tn")).alias("t"))
    held = slots.select("level", F.floor(F.col("gx") / block).alias("bx"), F.floor(F.col("gy") / block).alias("by")).distinct().withColumn("block", F.lit(True))
    met = asked.join(at, ["level", "gx", "gy"], "left").withColumn("bx", F.floor(F.col("gx") / block)).withColumn("by", F.floor(F.col("gy") / block)).join(held, ["level", "bx", "by"], "left")
    other = F.col("t").isNotNull() & ((F.col("t.tx") != F.col("fx")) | (F.col("t.ty") != F.col("fy")))
    per = met.groupBy(*FRAME, "place").agg(F.collect_set(F.when(other, F.col("t"))).alias("ts"), F.coalesce(F.bool_or(F.col("t").isNull() & F.col("block")), F.lit(False)).alias("empty"))
    status = F.when(F.size("ts") > 0, "resolved").when(F.col("empty"), "empty_slot").otherwise("outside_coverage")
    out = per.select(*FRAME, "place", status.alias("status"), F.explode_outer("ts").alias("t")).select(*FRAME, "place", "status", "t.*")
    way = crossing(F.col("fx"), F.col("fy"), F.col("tx"), F.col("ty"), block, blockset)
    return out.withColumn("crossing", F.when(F.col("tx").isNotNull(), way))


def frame_neighbours(frames: DataFrame, block: int, blockset: int) -> DataFrame:
    """FRAME, place (E N S W), status, tx, ty, tn, crossing: each frame across each edge once, also if it faces several slots.

    The slots looked at are those immediately across. Without any frame there, one row says whether a slot of a block that has
    frames is empty there (empty_slot), or no such block is (outside_coverage).
    """
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, (dx, dy) in SIDES.items())))
    a = frames.select(*FRAME, side.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    across = lambda d, f: F.when(d == 1, F.col(f) + F.col("n")).when(d == -1, F.col(f) - 1).otherwise(F.col(f) + F.col("i"))
    return _resolved(a.select(*FRAME, "s.place", across(F.col("s.dx"), "fx").alias("gx"), across(F.col("s.dy"), "fy").alias("gy")), frames, block, blockset)


def corner_frames(frames: DataFrame, block: int, blockset: int) -> DataFrame:
    """As frame_neighbours(), for the corners NE NW SE SW: each other frame that holds one of the four slots around the corner."""
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for c, (dx, dy) in CORNERS.items())))
    around = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0) for y in (-1, 0))))
    a = frames.select(*FRAME, corner.alias("c")).select("*", around.alias("o"))
    g = lambda f, d, o: F.col(f) + F.col(d) * F.col("n") + F.col(o)
    return _resolved(a.select(*FRAME, "c.place", g("fx", "c.dx", "o.x").alias("gx"), g("fy", "c.dy", "o.y").alias("gy")), frames, block, blockset)


def mirrored_nodes(nodes: DataFrame, frames: DataFrame, units: int, block: int, blockset: int) -> DataFrame:
    """FRAME, x, y, place, status, mirrored of nodes (FRAME, x, y: global lattice, `units` a slot) that lie on their frame's edge.

    A node on one edge must have an equal point in a frame across it, a node in a corner in any frame around it. Where no frame is
    there, status says why and mirrored is null: those are no faults. Repeated nodes count once.
    """
    x, y = F.col("x") - F.col("fx") * units, F.col("y") - F.col("fy") * units
    far = F.col("n") * units
    ew, ns = F.when(x == far, "E").when(x == 0, "W").otherwise(""), F.when(y == far, "N").when(y == 0, "S").otherwise("")
    on = nodes.select(*FRAME, "x", "y").distinct().withColumn("place", F.concat(ns, ew)).where("place <> ''")
    target = frame_neighbours(frames, block, blockset).unionByName(corner_frames(frames, block, blockset)).select(*FRAME, "place", "status", "tx", "ty")
    have = nodes.select("level", F.col("fx").alias("tx"), F.col("fy").alias("ty"), "x", "y").distinct().withColumn("_m", F.lit(True))
    met = on.join(target, [*FRAME, "place"]).join(have, ["level", "tx", "ty", "x", "y"], "left")
    hit = F.bool_or(F.coalesce("_m", F.lit(False)))
    return met.groupBy(*FRAME, "x", "y", "place", "status").agg(hit.alias("hit")).select(*FRAME, "x", "y", "place", "status", F.when(F.col("status") == "resolved", F.col("hit")).alias("mirrored"))
