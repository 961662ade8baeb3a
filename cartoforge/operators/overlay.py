"""How well the links of a product's cells lie on the source's ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import densified, matched_ways

CELL = ["cx", "cy"]


def _place(c: str, k: str, size: float) -> Column:
    """A coordinate from its cell's lower edge on."""
    return F.col(c) - F.col(k) * float(size)


def clip_counts(links: DataFrame, size: float, near: float) -> DataFrame:
    """cx, cy, ends, exact: ends of links (link_id, cx, cy, pos, x, y) within near * size of an edge of their cell, and those that
    lie exactly on it. A link of one point has two equal ends."""
    at = F.struct(_place("x", "cx", size).alias("u"), _place("y", "cy", size).alias("v"))
    e = links.groupBy("link_id", *CELL).agg(F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b")).select(*CELL, F.explode(F.array("a", "b")).alias("e"))
    gap = F.least("e.u", "e.v", size - F.col("e.u"), size - F.col("e.v"))
    return e.groupBy(*CELL).agg(F.count_if(gap <= near * size).alias("ends"), F.count_if(gap == 0).alias("exact"))


def occupied(points: DataFrame, size: float, grid: int) -> DataFrame:
    """cx, cy, share of a grid x grid lattice over the cell that points (cx, cy, x, y) lie in; those outside the cell don't count."""
    u, v = _place("x", "cx", size) / size, _place("y", "cy", size) / size
    slot = lambda c: F.least(F.floor(c * grid), F.lit(grid - 1))
    p = points.where(u.between(0, 1) & v.between(0, 1)).select(*CELL, slot(u).alias("i"), slot(v).alias("j")).distinct()
    return p.groupBy(*CELL).agg((F.count("*") / float(grid * grid)).alias("share"))


def overlay(links: DataFrame, ways: DataFrame, size: float, limit: float, spacing: float, grid: int = 16, near: float = 0.005) -> DataFrame:
    """A row for each cell (cx, cy) of links (link_id, cx, cy, pos, x, y) laid over ways (way_id, pos, x, y).

    links; matched_fraction: links whose median distance from the way they follow is at most `limit`; distance_p50, distance_p90;
    ends, exact, clip_share of clip_counts(); reach: the largest coordinate in parts of the cell; inside: share of vertices in the
    cell; occupied_links, occupied_ways, occupied_ratio: shares of the lattice that points a 64th of a cell apart lie in. A way
    counts in the cells that it passes, wherever it starts. What nothing is known of is null: distances without ways, clip_share
    without ends near an edge, the ratio without ways in the cell.
    """
    cells = links.select("link_id", *CELL).distinct()
    near_way = matched_ways(links, ways, "link_id", spacing).select("link_id", "distance")
    d = cells.join(near_way, "link_id", "left").groupBy(*CELL).agg(
        F.count("*").alias("links"), F.avg(F.when(F.col("distance") <= limit, 1.0).otherwise(0.0)).alias("matched_fraction"),
        F.percentile("distance", F.lit(0.5)).alias("distance_p50"), F.percentile("distance", F.lit(0.9)).alias("distance_p90"))
    u, v = _place("x", "cx", size) / size, _place("y", "cy", size) / size
    within = u.between(-1e-9, 1 + 1e-9) & v.between(-1e-9, 1 + 1e-9)
    place = links.groupBy(*CELL).agg(F.max(F.greatest(u, v)).alias("reach"), F.avg(within.cast("double")).alias("inside"))
    ours = occupied(densified(links, "link_id", size / 64).join(cells, "link_id"), size, grid).withColumnRenamed("share", "occupied_links")
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    theirs = occupied(densified(ways, "way_id", size / 64).withColumn("cx", at("x")).withColumn("cy", at("y")), size, grid).withColumnRenamed("share", "occupied_ways")
    out = d.join(clip_counts(links, size, near), CELL).join(place, CELL).join(ours, CELL, "left").join(theirs, CELL, "left")
    out = out.withColumn("clip_share", F.when(F.col("ends") > 0, F.col("exact") / F.col("ends")))
    none = F.lit(0.0)
    out = out.withColumn("occupied_links", F.coalesce("occupied_links", none)).withColumn("occupied_ways", F.coalesce("occupied_ways", none))
    return out.withColumn("occupied_ratio", F.when(F.col("occupied_ways") > 0, F.col("occupied_links") / F.col("occupied_ways")))


def criteria(cells: DataFrame, matched: float = 0.8, clip: float = 0.9, least_reach: float = 0.9, ratio: float = 0.5) -> DataFrame:
    """overlay() with its four criteria and `passed`, all of them: within_tolerance, clipped_at_edge, coord_max and no_clustering.
    One whose figure is null is not met."""
    known = {
        "within_tolerance": F.col("matched_fraction") >= matched,
        "clipped_at_edge": F.coalesce(F.col("clip_share") >= clip, F.lit(False)),
        "coord_max": F.col("reach").between(least_reach, 1 + 1e-9),
        "no_clustering": F.coalesce(F.col("occupied_ratio") >= ratio, F.lit(False)),
    }
    out = cells.select("*", *(c.alias(k) for k, c in known.items()))
    return out.withColumn("passed", F.col("within_tolerance") & F.col("clipped_at_edge") & F.col("coord_max") & F.col("no_clustering"))
