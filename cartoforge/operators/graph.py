"""Ways to a routable graph: segments, costs, restrictions, groups, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import bearing, haversine
from ..sources.lineage import cut_lineage, drop_tables


def node_degrees(points: DataFrame) -> DataFrame:
    """How often nodes are referred to; ends of ways count twice: node_id, degree."""
    whole = Window.partitionBy("way_id")
    p = points.select("node_id", "pos", F.min("pos").over(whole).alias("a"), F.max("pos").over(whole).alias("z"))
    return p.groupBy("node_id").agg(F.sum(F.when((F.col("pos") == F.col("a")) | (F.col("pos") == F.col("z")), 2).otherwise(1)).alias("degree"))


def split_at_nodes(points: DataFrame) -> DataFrame:
    """Segments of ways between graph nodes (ends, or nodes referred to twice): way_id, seg, u, v, length, n_points, angle. Points
    go to their node once, where those that refer to it are counted, and back to their way; degrees are not joined."""
    w = Window.partitionBy("way_id").orderBy("pos")
    p = points.select("way_id", "pos", "node_id", "lat", "lon", (F.col("node_id").isNotNull() & (F.count("*").over(Window.partitionBy("node_id")) >= 2)).alias("met"))
    end = F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull()
    p = p.select("way_id", "pos", "node_id", "lat", "lon", (F.col("met") | (F.col("node_id").isNotNull() & end)).alias("hub"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), F.lead("node_id").over(w).alias("next"))
    p = p.withColumn("seg", F.sum(F.col("hub").cast("int")).over(w)).where("next is not null")
    metres = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    first = {c: F.min_by(c, "pos").alias(c) for c in ("node_id", "lat", "lon", "lat2", "lon2")}
    s = p.groupBy("way_id", "seg").agg(*first.values(), F.max_by("next", "pos").alias("v"), F.sum(metres).alias("length"), (F.count("*") + 1).alias("n_points"))
    return s.select("way_id", F.col("seg").cast("long").alias("seg"), F.col("node_id").alias("u"), "v", "length", "n_points", bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("angle"))


def links(segs: DataFrame, ways: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Directed links (way_id, seg, forward, u, v, length, road_class): both directions but for one-way roads; no loops."""
    road = F.lit(None).cast("int")
    for name, k in classes.items():
        road = F.when(F.col("highway") == name, F.lit(k)).otherwise(road)
    s = segs.join(ways.where("highway is not null").select("way_id", "oneway", road.alias("road_class")), "way_id").where("u <> v and length > 0")
    s = s.withColumn("forward", F.explode(F.when(F.col("oneway") == "yes", F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    return s.select("way_id", "seg", "forward", F.when(F.col("forward"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("forward"), F.col("v")).otherwise(F.col("u")).alias("v"), "length", "road_class")


def node_ranks(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """Lowest road class at each node, 15 where no link is: node_id, rank."""
    ends = link.select(F.explode(F.array("u", "v")).alias("node_id"), "road_class").groupBy("node_id").agg(F.min("road_class").alias("low"))
    return nodes.join(ends, "node_id", "left").select("node_id", F.coalesce("low", F.lit(15)).alias("rank"))


def lightest(link: DataFrame) -> DataFrame:
    """One edge (u, v, w) for each ordered pair: the lightest; no loops, no negative weights."""
    return link.where("u <> v and length >= 0").groupBy("u", "v").agg(F.min("length").alias("w"))


def resolve_restrictions(relations: DataFrame, refs: DataFrame) -> DataFrame:
    """Restrictions with the first link of each side at the via node: rel_id, from_pos, to_pos, code; null where unresolved.

    A `no_` restriction has code 127, others 0.
    """
    at = refs.groupBy("way_id", "node_id").agg(F.min("pos").alias("pos"))
    a = at.select(F.col("way_id").alias("from_way"), F.col("node_id").alias("via"), F.col("pos").alias("from_pos"))
    b = at.select(F.col("way_id").alias("to_way"), F.col("node_id").alias("via"), F.col("pos").alias("to_pos"))
    return relations.join(a, ["from_way", "via"], "left").join(b, ["to_way", "via"], "left").select("rel_id", "from_pos", "to_pos", F.when(F.col("restriction").startswith("no_"), 127).otherwise(0).alias("code"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node_id and the smallest node_id that it is joined with, by least labels and pointer jumping; each round is written.
    Beyond most_rounds an error is raised. Labels are joined by sorting: none goes through the driver."""
    both = edges.select("u", "v").where("u <> v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).where("u <> v")).distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.groupBy(F.col("u").alias("node_id")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node_id").alias("v"), "label").hint("merge"), "v").groupBy(F.col("u").alias("node_id")).agg(F.min("label").alias("near"))
        low = label.join(near.hint("merge"), "node_id").select("node_id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        nxt = cut_lineage(low.join(label.select(F.col("node_id").alias("low"), F.col("label").alias("up")).hint("merge"), "low", "left").select("node_id", "was", F.least("low", "up").alias("label")))
        drop_tables(label)
        label = nxt.select("node_id", "label")
        if not nxt.where("label <> was").limit(1).count():
            drop_tables(both)
            return label
    raise RuntimeError(f"labels still move after {most_rounds} rounds")


def shortest_paths(edges: DataFrame, sources: DataFrame, most_hops: int | None = None, most_cost: float | None = None) -> DataFrame:
    """Distances (src, node, dist) from all sources at once: each round relaxes the edges of what improved, until nothing does
    (or most_hops). edges: u, v, w (no negative weights). sources: src, or src, node, dist to go on from. Edges longer than
    most_cost lie on no path and are left out first."""
    edges = cut_lineage((edges if most_cost is None else edges.where(F.col("w") <= most_cost)).select("u", "v", "w"))
    start = sources.select("src", "node", "dist") if "dist" in sources.columns else sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"))
    best = cut_lineage(start.groupBy("src", "node").agg(F.min("dist").alias("dist")))
    front, hops = best, 0
    while most_hops is None or hops < most_hops:
        step = front.join(edges, front["node"] == edges["u"]).select("src", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("new")).groupBy("src", "node").agg(F.min("new").alias("new"))
        step = step if most_cost is None else step.where(F.col("new") <= most_cost)
        both = cut_lineage(best.join(step, ["src", "node"], "full_outer").select("src", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better")))
        drop_tables(best)
        best, front, hops = both.select("src", "node", "dist"), both.where("better").select("src", "node", "dist"), hops + 1
        if not front.limit(1).count():
            break
    drop_tables(edges)
    return best


def collapse(link: DataFrame, clusters: DataFrame) -> DataFrame:
    """link with cu and cv, its ends after each node of a cluster (node_id, label) is replaced by the cluster."""
    a = clusters.select(F.col("node_id").alias("u"), F.col("label").alias("lu"))
    b = clusters.select(F.col("node_id").alias("v"), F.col("label").alias("lv"))
    return link.join(a, "u", "left").join(b, "v", "left").withColumn("cu", F.coalesce("lu", "u")).withColumn("cv", F.coalesce("lv", "v")).drop("lu", "lv")


def representatives(clusters: DataFrame, link: DataFrame, most: int) -> DataFrame:
    """The nodes of each cluster with the most links out, as many as `most`, the smaller id first: label, node_id, k."""
    degree = link.groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))
    w = Window.partitionBy("label").orderBy(F.coalesce("degree", F.lit(0)).desc(), "node_id")
    return clusters.join(degree, "node_id", "left").select("label", "node_id", F.row_number().over(w).alias("k")).where(F.col("k") <= most)


def ring_status(parts: DataFrame) -> DataFrame:
    """rel_id, status, members of relations whose member ways (rel_id, part, a, b: end nodes) should make closed rings: branch if
    three or more ends meet, open if one stands alone, else closed. A member that is a ring of its own meets itself."""
    ends = parts.select("rel_id", F.explode(F.array("a", "b")).alias("node")).groupBy("rel_id", "node").agg(F.count("*").alias("k"))
    worst = ends.groupBy("rel_id").agg(F.max("k").alias("most"), F.min("k").alias("least"))
    n = parts.groupBy("rel_id").agg(F.count("*").cast("int").alias("members"))
    return worst.join(n, "rel_id").select("rel_id", F.when(F.col("most") > 2, "branch").when(F.col("least") < 2, "open").otherwise("closed").alias("status"), "members")
