"""Scans, gates and projections of map features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import numbered


def bounds(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box of the points of each key: keys, x_lo, x_hi (lon), y_lo, y_hi (lat)."""
    return points.groupBy(*keys).agg(F.min("lon").alias("x_lo"), F.max("lon").alias("x_hi"), F.min("lat").alias("y_lo"), F.max("lat").alias("y_hi"))


def meets_box(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, west: float, east: float, south: float, north: float, guard: float = 1e-9) -> Column:
    """Whether a box meets another at any whole turn of longitude; the guard keeps boxes that touch."""
    turns = F.ceil((west - x_hi - guard) / 360.0) <= F.floor((east - x_lo + guard) / 360.0)
    return turns & (y_hi >= south) & (y_lo <= north)


def restriction_members(members: DataFrame) -> DataFrame:
    """Turn restrictions from member rows (rel_id, role, ref): rel_id, from, via, to; those without one of the three go."""
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("ref"))).alias(role)
    return members.groupBy("rel_id").agg(at("from"), at("via"), at("to")).dropna()


def three_hops(nodes: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """The given nodes, the ways that use one, and the relations that hold one of either: type, id.

    nodes: node_id. refs: way_id, node_id. members: rel_id, type, ref.
    """
    ways = refs.join(nodes, "node_id", "left_semi").select("way_id").distinct()
    found = nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id")).union(ways.select(F.lit("way"), "way_id"))
    rels = members.join(found.withColumnRenamed("id", "ref"), ["type", "ref"], "left_semi").select("rel_id").distinct()
    return found.union(rels.select(F.lit("relation"), "rel_id"))


def name_gate(level: Column, value: Column, allowed: dict[int, list[str]]) -> Column:
    """Whether a name is shown: at a level without a list always, else if its class is listed."""
    return reduce(lambda out, k: F.when(level == k, value.isin(allowed[k])).otherwise(out), allowed, F.lit(True))


def decide(kind: Column, level: Column, table: Sequence[tuple[str, int, int]]) -> Column:
    """Value of the first (kind, highest level, value) that holds; null drops the row."""
    out = F.lit(None).cast("int")
    for name, highest, value in reversed(table):
        out = F.when((kind == name) & (level <= highest), F.lit(value)).otherwise(out)
    return out


def road_links(points: DataFrame, ways: DataFrame, classes: dict[str, int], units: int, lat0: float = -32.5, lon0: float = 115.5) -> DataFrame:
    """way_id, road_class, points (pos, x, y on the lattice, clamped) of ways whose class has a code; others are dropped."""
    code = reduce(lambda out, k: F.when(F.col("highway") == k, classes[k]).otherwise(out), classes, F.lit(None).cast("int"))
    roads = ways.select("way_id", code.alias("road_class")).where("road_class is not null")
    at = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(units).cast("long"), F.rint(v * float(units)).cast("long")))
    p = points.select("way_id", F.struct("pos", at(F.col("lon") - lon0).alias("x"), at(F.col("lat") - lat0).alias("y")).alias("p"))
    return p.join(roads, "way_id").groupBy("way_id", "road_class").agg(F.sort_array(F.collect_list("p")).alias("points"))


def rings(points: DataFrame, least: int = 3) -> DataFrame:
    """way_id, ring: the ordered points of ways of `least` or more, the first one repeated at the end."""
    r = points.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p")).where(F.size("p") >= least)
    return r.select("way_id", F.concat("p", F.slice("p", 1, 1)).alias("ring"))


def packed(fields: Sequence[tuple[str, int]]) -> Column:
    """One BIGINT of several small numbers in mixed radix; a value outside its radix is an error."""
    out = F.lit(0).cast("long")
    for name, radix in fields:
        inside = (F.col(name) >= 0) & (F.col(name) < radix)
        out = out * radix + F.when(inside, F.col(name).cast("long")).otherwise(F.raise_error(F.lit(f"{name} is outside 0..{radix - 1}")).cast("long"))
    return out


def densified(segs: DataFrame, step: float) -> DataFrame:
    """Points no more than `step` degrees apart along segments, from each start on: way_id, pos, step, lat, lon."""
    k = F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(F.abs(F.col("lat2") - F.col("lat")), F.abs(F.col("lon2") - F.col("lon"))) / step).cast("long"))
    s = segs.withColumn("k", k).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    t = F.col("step") / F.col("k").cast("double")
    return s.select("way_id", "pos", "step", (F.col("lat") + (F.col("lat2") - F.col("lat")) * t).alias("lat"), (F.col("lon") + (F.col("lon2") - F.col("lon")) * t).alias("lon"))


def presence_mask(columns: Sequence[str]) -> Column:
    """Bit i is set where the i-th column has a value."""
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(columns)))


def spot_check(wanted: DataFrame, present: DataFrame, spot: str) -> DataFrame:
    """Whether all names wanted at a spot (spot, c, name) are present whole in its cell (c, name): spot, passed, n_missing."""
    have = present.distinct().withColumn("there", F.lit(True))
    missing = F.count_if(F.col("there").isNull())
    return wanted.join(have, ["c", "name"], "left").groupBy(spot).agg((missing == 0).alias("passed"), missing.alias("n_missing"))


def exclusive(rows: DataFrame, suppliers: DataFrame, owner: str, item: str) -> DataFrame:
    """Rows (owner, item) whose item no other owner supplies; least and greatest owner of an item stand for all of them."""
    span = suppliers.groupBy(item).agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"))
    other = (F.col("lo") != F.col(owner)) | (F.col("hi") != F.col(owner))
    return rows.join(span, item, "left").where(~F.coalesce(other, F.lit(False))).select(owner, item)


def ranked(rows: DataFrame, keys: Sequence[str], order: list) -> DataFrame:
    """rows with `k`, their place in the order within keys; a key with very many rows is numbered by ranges."""
    return numbered(rows, keys, order, "k")


def rank_levels(ranks: DataFrame, rank: str, shares: Sequence[tuple[float, int]], rest: int) -> DataFrame:
    """ranks with `level`: that of the first cumulative share that the rank (1..n) lies in, else rest."""
    total = ranks.agg(F.max(rank).alias("total"))
    out = F.lit(rest)
    for share, level in reversed(shares):
        out = F.when(F.col(rank) <= F.rint(F.col("total") * share), level).otherwise(out)
    return ranks.crossJoin(F.broadcast(total)).withColumn("level", out).drop("total")


def name_halo(names: DataFrame, budget: int) -> DataFrame:
    """cx, cy, node_id, name: for each cell with names, names of the eight cells around whose text it lacks, the nearest of each
    text, by distance from the cell's centre and text, while their lengths together stay within budget.

    names: node_id, name, x, y (in cells), cx, cy. An equi-join on cells; a cell's candidates are those of nine cells.
    """
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    cells = names.select("cx", "cy").distinct()
    near = names.select("node_id", "name", "x", "y", F.explode(steps).alias("s"), "cx", "cy").select("node_id", "name", "x", "y", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    near = near.join(cells, ["cx", "cy"]).withColumn("low", F.lower("name"))
    near = near.join(names.select("cx", "cy", F.lower("name").alias("low")).distinct(), ["cx", "cy", "low"], "left_anti")
    near = near.withColumn("dist", F.round(F.greatest(F.abs(F.col("x") - F.col("cx") - 0.5), F.abs(F.col("y") - F.col("cy") - 0.5)), 6))
    one = near.groupBy("cx", "cy", "low").agg(F.min(F.struct("dist", "node_id", "name")).alias("m")).select("cx", "cy", "low", "m.*")
    total = F.sum(F.length("name")).over(Window.partitionBy("cx", "cy").orderBy("dist", "low").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("total", total).where(F.col("total") <= budget).select("cx", "cy", "node_id", "name")


def cell_class(cells: DataFrame, urban: DataFrame, per_tile: int) -> DataFrame:
    """cells (ix, iy) with class by the tile of per_tile x per_tile cells that they lie in, whatever they hold: divided (three
    cities or more), urban, full (towns only), sparse (not in the dimension). urban: tx, ty, cities."""
    t = cells.withColumn("tx", F.floor(F.col("ix") / per_tile).cast("long")).withColumn("ty", F.floor(F.col("iy") / per_tile).cast("long")).join(urban, ["tx", "ty"], "left")
    name = F.when(F.col("cities") >= 3, "divided").when(F.col("cities") >= 1, "urban").when(F.col("cities") == 0, "full").otherwise("sparse")
    return t.select("ix", "iy", name.alias("class"))
