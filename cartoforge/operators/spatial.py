"""Joins by place. Every one is an equi-join on buckets with the exact test behind it; none compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import segment_distance
from ..sources.lineage import cut_lineage


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections take as it is, instead of working value out again in each of them."""
    return df.withColumn(name, F.explode(F.array(value)))


def buckets(df: DataFrame, low: Column, high: Column, size: float | Column, name: str) -> DataFrame:
    """A row for every bucket of `size` that [low, high] meets."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))


def nearest_point(points: DataFrame, targets: DataFrame, within: float) -> DataFrame:
    """id and Chebyshev distance of the nearest target of the same kind, where one is at most `within` away.

    points: id, kind, x, y. targets: kind, x, y. A target is put in the buckets that its neighbourhood meets.
    """
    t = targets.select("kind", F.col("x").alias("tx"), F.col("y").alias("ty"))
    t = buckets(buckets(t, F.col("tx") - within, F.col("tx") + within, 2 * within, "bx"), F.col("ty") - within, F.col("ty") + within, 2 * within, "by")
    p = points.withColumn("bx", F.floor(F.col("x") / (2 * within)).cast("long")).withColumn("by", F.floor(F.col("y") / (2 * within)).cast("long"))
    d = F.greatest(F.abs(F.col("x") - F.col("tx")), F.abs(F.col("y") - F.col("ty")))
    return p.join(t, ["kind", "bx", "by"]).where(d <= within).groupBy("id").agg(F.min(d).alias("distance"))


def nearest_segment(points: DataFrame, segs: DataFrame, within: float, bucket: float) -> DataFrame:
    """id and Euclidean distance of the nearest segment, where one is at most `within` away.

    points: id, x, y. segs: x1, y1, x2, y2; each goes to the buckets that it passes: for every column of x, the rows of its part
    there. A long segment so makes rows by its length, not by the area of its box. A point where a segment begins is at distance 0,
    whatever else is near: only the others meet segments in buckets.
    """
    here = cut_lineage(points.join(segs.select(F.col("x1").alias("x"), F.col("y1").alias("y")), ["x", "y"], "left_semi").select("id", F.lit(0.0).alias("distance")))
    points = cut_lineage(points.join(here, "id", "left_anti"))
    if not points.limit(1).count():
        return here.distinct()
    s = buckets(segs, F.least("x1", "x2") - within, F.greatest("x1", "x2") + within, bucket, "bx")
    y_at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / (F.col("x2") - F.col("x1"))))
    tilted = F.col("x1") != F.col("x2")
    s = s.withColumn("ya", F.when(tilted, y_at(F.col("bx") * bucket - within)).otherwise(F.col("y1"))).withColumn("yb", F.when(tilted, y_at((F.col("bx") + 1) * bucket + within)).otherwise(F.col("y2")))
    s = buckets(s, F.least("ya", "yb") - within, F.greatest("ya", "yb") + within, bucket, "by")
    p = points.withColumn("bx", F.floor(F.col("x") / bucket).cast("long")).withColumn("by", F.floor(F.col("y") / bucket).cast("long"))
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return p.join(s, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= within).select("id", F.col("d").alias("distance")).unionByName(here).groupBy("id").agg(F.min("distance").alias("distance"))


def points_in_rings(points: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """(id, ring) of points inside rings, even-odd. points: id, x, y. edges: ring, x1, y1, x2, y2; bucketed by bands of y."""
    e = buckets(edges, F.least("y1", "y2"), F.greatest("y1", "y2"), band, "band")
    p = points.withColumn("band", F.floor(F.col("y") / band).cast("long"))
    across = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return p.join(e, "band").where(across & (F.col("x") < at)).groupBy("id", "ring").agg(F.count("*").alias("k")).where("k % 2 = 1").select("id", "ring")


def within_tolerance(points: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Rows of points (x, y) with a target no more than `tolerance` away on either axis."""
    t = targets.select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    t = buckets(buckets(t, F.col("tx") - tolerance, F.col("tx") + tolerance, tolerance, "bx"), F.col("ty") - tolerance, F.col("ty") + tolerance, tolerance, "by")
    p = points.withColumn("bx", F.floor(F.col("x") / tolerance).cast("long")).withColumn("by", F.floor(F.col("y") / tolerance).cast("long"))
    close = (p["bx"] == t["bx"]) & (p["by"] == t["by"]) & (F.abs(F.col("x") - F.col("tx")) <= tolerance) & (F.abs(F.col("y") - F.col("ty")) <= tolerance)
    return p.join(t, close, "left_semi").drop("bx", "by")


def rectangles_meet(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """(a_id, b_id) of boxes that share a positive area. a and b: id, x_lo, x_hi, y_lo, y_hi. A pair is kept once, in the
    bucket of its common lower corner."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "x_lo", "x_hi", "y_lo", "y_hi")))
        return buckets(buckets(df, F.col(f"{p}_x_lo"), F.col(f"{p}_x_hi"), bucket, "bx"), F.col(f"{p}_y_lo"), F.col(f"{p}_y_hi"), bucket, "by")

    both = dealt(a, "a").join(dealt(b, "b"), ["bx", "by"])
    x, y = F.greatest("a_x_lo", "b_x_lo"), F.greatest("a_y_lo", "b_y_lo")
    meet = (x < F.least("a_x_hi", "b_x_hi")) & (y < F.least("a_y_hi", "b_y_hi"))
    return both.where(meet & (F.floor(x / bucket) == F.col("bx")) & (F.floor(y / bucket) == F.col("by"))).select("a_id", "b_id")


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells across an edge: level, ix, iy, side, and whether the other cell is there."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, dx, dy in (("E", 1, 0), ("N", 0, 1), ("S", 0, -1), ("W", -1, 0))))
    want = cells.select("level", "ix", "iy", F.explode(sides).alias("s")).select("level", "ix", "iy", "s.side", (F.col("ix") + F.col("s.dx")).alias("jx"), (F.col("iy") + F.col("s.dy")).alias("jy"))
    have = cells.select("level", F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.lit(True).alias("there"))
    return want.join(have, ["level", "jx", "jy"], "left").select("level", "ix", "iy", "side", F.coalesce("there", F.lit(False)).alias("there"))


def cells_of_boxes(boxes: DataFrame, cells: DataFrame, tile: int = 16) -> DataFrame:
    """way_id, cx, cy, tall: the cells (cx, cy) that a shape's box x0..x1, y0..y1 (in cells) meets. boxes also has its home hx, hy.

    Most boxes stay within one cell of their home: those look at nine cells. Tall ones meet cells by tiles of tile x tile.
    """
    tall = (F.col("x0") < F.col("hx") - 1) | (F.col("x1") > F.col("hx") + 1) | (F.col("y0") < F.col("hy") - 1) | (F.col("y1") > F.col("hy") + 1)
    boxes = boxes.withColumn("tall", tall)
    near = boxes.where("not tall").withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1"))).join(cells, ["cx", "cy"])
    far = buckets(buckets(boxes.where("tall"), F.col("x0"), F.col("x1"), tile, "tx"), F.col("y0"), F.col("y1"), tile, "ty")
    tiled = cells.withColumn("tx", F.floor(F.col("cx") / tile)).withColumn("ty", F.floor(F.col("cy") / tile))
    far = far.join(tiled, ["tx", "ty"]).where("cx between x0 and x1 and cy between y0 and y1")
    return near.select("way_id", "cx", "cy", "tall").unionByName(far.select("way_id", "cx", "cy", "tall"))


def corner_cells(cells: DataFrame) -> DataFrame:
    """level, ix, iy, jx, jy: cells with each cell that is there across a corner."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 1) for dy in (-1, 1)))
    want = cells.select("level", "ix", "iy", F.explode(steps).alias("s")).select("level", "ix", "iy", (F.col("ix") + F.col("s.dx")).alias("jx"), (F.col("iy") + F.col("s.dy")).alias("jy"))
    return want.join(cells.select("level", F.col("ix").alias("jx"), F.col("iy").alias("jy")), ["level", "jx", "jy"]).select("level", "ix", "iy", "jx", "jy")


def beside_marked(cells: DataFrame, mark: str) -> DataFrame:
    """cells (level, ix, iy, ...) with beside: whether one of the eight cells around is marked."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    around = cells.where(mark).select("level", "ix", "iy", F.explode(steps).alias("s")).select("level", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy")).distinct()
    return cells.join(around.withColumn("_b", F.lit(True)), ["level", "ix", "iy"], "left").withColumn("beside", F.coalesce("_b", F.lit(False))).drop("_b")
