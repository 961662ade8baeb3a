"""Queries on intersections of several graph nodes: streets of towns whose corners lie 15 m apart in threes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import clusters, contraction, graph
from .queries import _GRAPH, CLASSES, query
from .sources.adapters import view
from .sources.lineage import cut_lineage

# The same by walking from every node; all pairs of a roundabout's nodes are edges.
_TOWN = f"""{_GRAPH.replace("geo_points", "town_points").replace("osm_ways", "town_ways")},
en AS (SELECT u AS node_id FROM lk UNION SELECT v FROM lk),
eg AS (SELECT a.node_id AS u, b.node_id AS v FROM town_points a JOIN town_points b USING (way_id) JOIN town_ways w USING (way_id) WHERE w.junction = 'roundabout' AND a.node_id <> b.node_id AND a.node_id IN (FROM en) AND b.node_id IN (FROM en)
 UNION SELECT u, v FROM lk WHERE length <= 20 AND u NOT IN (SELECT node_id FROM town_points WHERE edge) AND v NOT IN (SELECT node_id FROM town_points WHERE edge)),
e AS (SELECT u, v FROM eg UNION SELECT v, u FROM eg),
reach AS (SELECT u AS node_id, u AS label FROM e UNION SELECT e.v, r.label FROM reach r JOIN e ON e.u = r.node_id WHERE r.label < e.v),
comp AS (SELECT node_id, min(label) AS label FROM reach GROUP BY node_id),
dg AS (SELECT u AS node_id, count(*) AS degree FROM lk GROUP BY u),
keep AS (SELECT first_value(node_id) OVER (PARTITION BY label ORDER BY k) AS rep, node_id, k FROM (SELECT label, node_id, row_number() OVER (PARTITION BY label ORDER BY coalesce(degree, 0) DESC, node_id) AS k FROM comp LEFT JOIN dg USING (node_id)) t WHERE k <= 6),
mg AS (SELECT lk.*, a.k, coalesce(a.rep, u) AS cu, coalesce(b.rep, v) AS cv FROM lk LEFT JOIN keep a ON a.node_id = u LEFT JOIN keep b ON b.node_id = v),
cp AS (SELECT way_id, seg, row_number() OVER (PARTITION BY cu ORDER BY min(k), way_id, seg) AS composition FROM mg WHERE cu = cv GROUP BY cu, way_id, seg)"""


def _town(spark, d) -> tuple[DataFrame, DataFrame]:
    """Links and groups of the towns."""
    points, ways = view(spark, d, "town_points"), view(spark, d, "town_ways")
    link = cut_lineage(graph.links(graph.split_at_nodes(points), ways, CLASSES))
    rings = points.join(ways.where("junction = 'roundabout'").select("way_id"), "way_id", "left_semi")
    return link, clusters.intersection_groups(link, rings, points.where("edge"))


def _merged(spark, d) -> DataFrame:
    link, groups = _town(spark, d)
    return clusters.merged_links(link, clusters.members(groups, link))


@query("r05_intersection_groups", f"WITH RECURSIVE {_TOWN} SELECT node_id, label FROM comp")
def r05_groups(spark, d):
    return _town(spark, d)[1]


@query("r06_merged_links", f"WITH RECURSIVE {_TOWN} SELECT way_id, seg, forward, cu, cv, cu = cv AS internal, CASE WHEN composition <= 15 THEN composition END AS composition FROM mg LEFT JOIN cp USING (way_id, seg)")
def r06_links(spark, d):
    return _merged(spark, d).select("way_id", "seg", "forward", "cu", "cv", "internal", F.col("composition").cast("long").alias("composition"))


@query("r06_member_offsets", f"""WITH RECURSIVE {_TOWN}, spot AS (SELECT DISTINCT node_id, lat, lon FROM town_points)
SELECT rep, k.node_id, k, CAST(greatest(-127, least(127, round_even((a.lon - b.lon) * 111320e0 * cos(radians(b.lat)), 0))) AS INT) AS dx, CAST(greatest(-127, least(127, round_even((a.lat - b.lat) * 111320e0, 0))) AS INT) AS dy
FROM keep k JOIN spot a ON a.node_id = k.node_id JOIN spot b ON b.node_id = k.rep WHERE k > 1""")
def r06_offsets(spark, d):
    link, groups = _town(spark, d)
    at = view(spark, d, "town_points").select("node_id", "lat", "lon").distinct()
    return clusters.member_offsets(clusters.members(groups, link), at).withColumn("k", F.col("k").cast("long"))


@query("r06_regulations", f"""WITH RECURSIVE {_TOWN}, o AS (SELECT u, way_id, bool_or(cu <> cv) AS x FROM mg GROUP BY u, way_id)
SELECT rel_id, CASE WHEN a.x IS NULL THEN 'no_entry' WHEN NOT a.x THEN 'entry_merged' WHEN b.x IS NULL THEN 'unresolved' WHEN NOT b.x THEN 'exit_merged' ELSE 'kept' END AS status
FROM town_turns t LEFT JOIN o a ON a.u = via AND a.way_id = from_way LEFT JOIN o b ON b.u = via AND b.way_id = to_way""")
def r06_regulations(spark, d):
    return clusters.regulations_left(view(spark, d, "town_turns"), _merged(spark, d))


@query("r11_hierarchy_distances", f"""WITH RECURSIVE {_GRAPH.replace("geo_points", "town_points").replace("osm_ways", "town_ways")}, e0 AS (SELECT u, v, min(CAST(round_even(length, 0) AS BIGINT)) AS w FROM lk WHERE u <> v GROUP BY u, v),
p AS (SELECT DISTINCT u AS src, u AS node, CAST(0 AS BIGINT) AS dist FROM e0 WHERE u % 40 = 0 UNION SELECT src, e.v, dist + e.w FROM p JOIN e0 e ON e.u = p.node WHERE dist + e.w <= 600)
SELECT src, node, min(dist) AS dist FROM p GROUP BY src, node""")
def r11_hierarchy(spark, d):
    link = graph.links(graph.split_at_nodes(view(spark, d, "town_points")), view(spark, d, "town_ways"), CLASSES)
    edges = cut_lineage(link.where("u <> v").groupBy("u", "v").agg(F.min(F.rint("length").cast("long")).alias("w")))
    _, search = contraction.hierarchy(edges)
    found = contraction.hierarchy_distances(search, edges.where("u % 40 = 0").select(F.col("u").alias("src")).distinct(), 600.0)
    return found.withColumn("dist", F.col("dist").cast("long"))
