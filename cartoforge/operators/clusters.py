"""Intersections that are several graph nodes, merged into one: groups, capped members, links, offsets, turn regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Fixed values of the format: metres of a short link, members of a cluster, links listed inside one, reach of an offset in metres,
#: metres of a degree of latitude.
SHORT, MEMBERS, COMPOSITION, REACH, DEGREE = 20.0, 6, 15, 127, 111320.0


def intersection_groups(link: DataFrame, roundabouts: DataFrame, boundary: DataFrame, short: float = SHORT) -> DataFrame:
    """node_id and label (its group's smallest node) of the nodes that belong together: all graph nodes of a roundabout (way_id,
    node_id), whatever their distance, and the ends of links of at most `short` metres neither of which is a boundary node
    (node_id). A roundabout's nodes hang on its smallest one, so a ring of n nodes makes n - 1 edges."""
    ends = link.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    ring = roundabouts.select("way_id", "node_id").distinct().join(ends, "node_id", "left_semi")
    hub = ring.groupBy("way_id").agg(F.min("node_id").alias("u"))
    edges = ring.join(hub, "way_id").select("u", F.col("node_id").alias("v"))
    near = link.where(F.col("length") <= short).select("u", "v")
    for end in ("u", "v"):
        near = near.join(boundary.select(F.col("node_id").alias(end)).distinct(), end, "left_anti")
    return graph.components(edges.unionByName(near.select("u", "v")))


def members(groups: DataFrame, link: DataFrame, most: int = MEMBERS) -> DataFrame:
    """rep, node_id, k of the nodes that a group keeps: the `most` with the most links out, the smaller id first; rep is the first.
    The others stay nodes of their own."""
    kept = graph.representatives(groups, link, most)
    rep = kept.where("k = 1").select("label", F.col("node_id").alias("rep"))
    return kept.join(rep, "label").select("rep", "node_id", "k")


def merged_links(link: DataFrame, kept: DataFrame, most: int = COMPOSITION) -> DataFrame:
    """link with cu and cv (ends after the merge), internal (both ends in one cluster) and composition: the place, from 1, of an
    internal segment in its cluster's list, by the first member that it leaves, way and segment; null beyond `most` and outside.
    Both directions of a segment are one entry."""
    m = graph.collapse(link, kept.select("node_id", F.col("rep").alias("label"))).withColumn("internal", F.col("cu") == F.col("cv"))
    first = m.where("internal").join(kept.select(F.col("node_id").alias("u"), "k"), "u").groupBy("cu", "way_id", "seg").agg(F.min("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("cu").orderBy("k", "way_id", "seg"))
    listed = first.select("way_id", "seg", place.alias("composition")).where(F.col("composition") <= most)
    return m.join(listed, ["way_id", "seg"], "left")


def member_offsets(kept: DataFrame, at: DataFrame, reach: int = REACH) -> DataFrame:
    """rep, node_id, k, dx, dy of every member but the first: whole metres east and north of it, clamped to `reach`. at: node_id,
    lat, lon, once a node."""
    a = at.select("node_id", "lat", "lon")
    b = at.select(F.col("node_id").alias("rep"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    p = kept.where("k > 1").join(a, "node_id").join(b, "rep")

    def metres(c: Column) -> Column:
        return F.greatest(F.lit(-reach), F.least(F.lit(reach), F.rint(c).cast("int")))

    dx = metres((F.col("lon") - F.col("lon0")) * DEGREE * F.cos(F.radians("lat0")))
    return p.select("rep", "node_id", "k", dx.alias("dx"), metres((F.col("lat") - F.col("lat0")) * DEGREE).alias("dy"))


def regulations_left(turns: DataFrame, merged: DataFrame) -> DataFrame:
    """rel_id and status of each turn regulation (rel_id, via, from_way, to_way) after the merge. It hangs on the link of from_way
    that leaves via: no_entry where there is none, entry_merged where all are inside a cluster. Its exit is the link of to_way
    that leaves via: exit_merged where all are inside a cluster; where there is none (unresolved) or one is left (kept), it stays."""
    out = merged.groupBy("u", "way_id").agg(F.max(~F.col("internal")).alias("left"))
    entry = out.select(F.col("u").alias("via"), F.col("way_id").alias("from_way"), F.col("left").alias("entry"))
    exit_ = out.select(F.col("u").alias("via"), F.col("way_id").alias("to_way"), F.col("left").alias("exit"))
    status = F.when(F.col("entry").isNull(), "no_entry").when(~F.col("entry"), "entry_merged").when(F.col("exit").isNull(), "unresolved")
    status = status.when(~F.col("exit"), "exit_merged").otherwise("kept")
    return turns.join(entry, ["via", "from_way"], "left").join(exit_, ["via", "to_way"], "left").select("rel_id", status.alias("status"))
