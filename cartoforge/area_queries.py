"""Queries on areas that relations make of their member ways, on pairs of polygons, and on the ways that lines follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rings as R
from .operators import matching, multipolygon
from .queries import query
from .ring_queries import _AREA
from .sources.adapters import view
from .sources.lineage import cut_lineage, drop_tables

# The same by walking: every member whose ends differ is walked forward from its first node until it comes back; the walk that
# starts at a ring's smallest member counts.
_SHAPING = """mem AS (SELECT rel_id, seq, CASE WHEN role = '' THEN 'outer' ELSE role END AS role, type, way_id FROM area_members WHERE type <> 'n' AND role IN ('', 'outer', 'inner')),
wn AS (SELECT way_id, count(*) AS n, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS z FROM area_points GROUP BY way_id HAVING count(*) >= 2),
prt AS (SELECT mem.*, wn.a, wn.z FROM mem LEFT JOIN wn USING (way_id)),
nd AS (SELECT rel_id, role, node, count(*) AS k FROM (SELECT rel_id, role, a AS node FROM prt WHERE a <> z UNION ALL SELECT rel_id, role, z FROM prt WHERE a <> z) t GROUP BY ALL),
st AS (SELECT rel_id, CASE WHEN count_if(type = 'r') > 0 THEN 'nested' WHEN count_if(type <> 'r' AND a IS NULL) > 0 THEN 'missing' WHEN (SELECT count(*) FROM nd WHERE nd.rel_id = prt.rel_id AND k > 2) > 0 THEN 'branch' WHEN (SELECT count(*) FROM nd WHERE nd.rel_id = prt.rel_id AND k < 2) > 0 THEN 'open' END AS fault, count(*) AS members FROM prt GROUP BY rel_id),
good AS (SELECT prt.* FROM prt JOIN st USING (rel_id) WHERE fault IS NULL),
walk AS (SELECT rel_id, role, seq AS start, seq, way_id, true AS forward, 0 AS rank, a AS home, z AS at FROM good UNION ALL
 SELECT w.rel_id, w.role, w.start, g.seq, g.way_id, g.a = w.at, w.rank + 1, w.home, CASE WHEN g.a = w.at THEN g.z ELSE g.a END FROM walk w JOIN good g ON g.rel_id = w.rel_id AND g.role = w.role AND g.seq <> w.seq AND g.a <> g.z AND (g.a = w.at OR g.z = w.at) WHERE w.at <> w.home),
ord AS (SELECT rel_id, role, start AS ring, rank, seq, way_id, forward FROM walk w WHERE start = (SELECT min(seq) FROM walk o WHERE o.rel_id = w.rel_id AND o.role = w.role AND o.start = w.start)),
rv AS (SELECT o.rel_id, o.role, o.ring, o.rank, CASE WHEN forward THEN p.pos ELSE -p.pos END AS o, p.node_id, p.x, p.y, row_number() OVER (PARTITION BY o.rel_id, o.role, o.ring, o.rank ORDER BY CASE WHEN forward THEN p.pos ELSE -p.pos END) AS k FROM ord o JOIN area_points p USING (way_id)),
made AS (SELECT rel_id, role, ring, list(node_id ORDER BY rank, o) AS nodes, list({'x': x, 'y': y} ORDER BY rank, o) AS v FROM rv WHERE rank = 0 OR k > 1 GROUP BY ALL),
jd AS (SELECT rel_id, coalesce(fault, CASE WHEN (SELECT count(*) FROM made m WHERE m.rel_id = st.rel_id AND len(list_distinct(nodes)) < 3) > 0 THEN 'degenerate' WHEN (SELECT count(*) FROM made m WHERE m.rel_id = st.rel_id AND role = 'outer') = 0 THEN 'no_outer' END) AS fault, members FROM st),
ok AS (SELECT made.* FROM made JOIN jd USING (rel_id) WHERE fault IS NULL)"""
_OPEN_AREA = _AREA.replace("len(v)", "(len(v) - 1)")


def _areas(spark, d) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """area_members, area_points and the tables written for them. The points of background ways, of which all areas are made, the
    parts of these and the points of members are written once: their views name each other up to six times. Other ways go before
    their nodes are met."""
    areas = view(spark, d, "osm_ways").where("highway is null").select("way_id")
    known = {"geo_points": cut_lineage(view(spark, d, "geo_points", {"way_lines": view(spark, d, "way_lines").join(areas, "way_id", "left_semi")}))}
    known["area_parts"] = cut_lineage(view(spark, d, "area_parts", known))
    points = cut_lineage(view(spark, d, "area_points", known))
    return view(spark, d, "area_members", known), points, [*known.values(), points]


def _made(spark, d) -> tuple[DataFrame, DataFrame]:
    members, points, written = _areas(spark, d)
    out = multipolygon.rings(members, points)
    drop_tables(*written)
    return out


@query("g07_joined_rings", f"WITH RECURSIVE {_SHAPING} SELECT rel_id, coalesce(fault, 'closed') AS status, members, (SELECT count(*) FROM ok WHERE ok.rel_id = jd.rel_id) AS rings FROM jd")
def g07(spark, d):
    status, made = _made(spark, d)
    n = made.groupBy("rel_id").agg(F.count("*").alias("rings"))
    return status.join(n, "rel_id", "left").select("rel_id", F.coalesce("fault", F.lit("closed")).alias("status"), "members", F.coalesce("rings", F.lit(0)).alias("rings"))


@query("g07_ring_order", f"WITH RECURSIVE {_SHAPING} SELECT rel_id, role, ring, CAST(rank AS INT) AS rank, seq, way_id, forward FROM ord")
def g07_order(spark, d):
    members, points, written = _areas(spark, d)
    order = multipolygon.ring_order(members, points)[1]
    drop_tables(*written)
    return order


@query("g07_rings", f"WITH RECURSIVE {_SHAPING} SELECT rel_id, role, ring, len(v) AS n, round({_OPEN_AREA}, 6) AS area, array_to_string(list_transform(nodes, lambda k: CAST(k AS VARCHAR)), ',') AS nodes FROM ok")
def g07_rings(spark, d):
    open_ring = F.slice("v", F.lit(1), F.size("v") - 1)
    return _made(spark, d)[1].select("rel_id", "role", "ring", F.size("v").cast("long").alias("n"), F.round(R.area(open_ring), 6).alias("area"), F.array_join("nodes", ",").alias("nodes"))


_STITCHED = f"""{_SHAPING}, rk AS (SELECT rel_id, v, row_number() OVER (PARTITION BY rel_id ORDER BY role = 'inner', ring) AS k FROM ok),
sw AS (SELECT rel_id, flatten(list(CASE WHEN k = 1 THEN v ELSE list_concat(v, [f]) END ORDER BY k)) AS v FROM (SELECT rk.*, first_value(v[1]) OVER (PARTITION BY rel_id ORDER BY k) AS f FROM rk) t GROUP BY rel_id)"""


@query("g08_stitched_rings", f"WITH RECURSIVE {_STITCHED} SELECT rel_id, len(v) AS n, round({_AREA}, 6) AS area FROM sw")
def g08(spark, d):
    return multipolygon.stitched(_made(spark, d)[1]).select("rel_id", F.size("v").cast("long").alias("n"), F.round(R.area(F.col("v")), 6).alias("area"))


_B, _SIZE = "v[CASE WHEN i = 1 THEN len(v) ELSE i - 1 END]", 8


def _half(source: str, name: str, axis: str, op: str, bound: str) -> str:
    o = "y" if axis == "x" else "x"
    at = f"{_B}.{o} + ({bound} - {_B}.{axis}) / (v[i].{axis} - {_B}.{axis}) * (v[i].{o} - {_B}.{o})"
    cross = f"{{'x': {bound}, 'y': {at}}}" if axis == "x" else f"{{'x': {at}, 'y': {bound}}}"
    step = f"CASE WHEN v[i].{axis} {op} {bound} THEN CASE WHEN {_B}.{axis} {op} {bound} THEN [v[i]] ELSE [{cross}, v[i]] END WHEN {_B}.{axis} {op} {bound} THEN [{cross}] ELSE [] END"
    return f"{name} AS (SELECT rel_id, cx, cy, flatten(list_transform(range(1, len(v) + 1), lambda i: {step})) AS v FROM {source})"


@query("g09_emitted_relations", f"""WITH RECURSIVE {_STITCHED}, g AS (SELECT rel_id, cx, cy, v FROM sw, (SELECT unnest(range(0, 8)) AS cx), (SELECT unnest(range(0, 8)) AS cy)),
{_half('g', 'h1', 'x', '>=', '(cx * 8e0)')}, {_half('h1', 'h2', 'x', '<=', '(cx * 8e0 + 8e0)')}, {_half('h2', 'h3', 'y', '>=', '(cy * 8e0)')}, {_half('h3', 'h4', 'y', '<=', '(cy * 8e0 + 8e0)')}
SELECT rel_id, cx, cy, len(v) AS n, round(abs({_AREA}), 6) AS area FROM h4 WHERE len(v) >= 3""")
def g09_relations(spark, d):
    cut = multipolygon.clipped_to_cells(multipolygon.stitched(_made(spark, d)[1]), _SIZE, 0, 7)
    return cut.select("rel_id", "cx", "cy", F.size("v").cast("long").alias("n"), F.round(F.abs(R.area(F.col("v"))), 6).alias("area"))


@query("g12_relation_validity", f"""WITH RECURSIVE {_SHAPING}, e AS (SELECT rel_id, role, ring, i, len(v) - 1 AS n, v[i].x AS x1, v[i].y AS y1, v[i + 1].x AS x2, v[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(v))) AS i FROM ok) t),
c AS (SELECT a.rel_id, count(*) AS k FROM e a JOIN e b ON a.rel_id = b.rel_id AND (a.ring < b.ring OR a.ring = b.ring AND a.i < b.i) AND NOT (a.ring = b.ring AND (b.i = a.i + 1 OR a.i = 1 AND b.i = a.n)) WHERE
 ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0 AND
 ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0 AND
 greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2) GROUP BY a.rel_id),
h AS (SELECT p.rel_id, p.role, p.ring, e.role AS by_role, e.ring AS by_ring FROM ok p JOIN e ON e.rel_id = p.rel_id AND e.ring <> p.ring
 WHERE (e.y1 > p.v[1].y) <> (e.y2 > p.v[1].y) AND p.v[1].x < e.x1 + (p.v[1].y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY ALL HAVING count(*) % 2 = 1),
k AS (SELECT o.rel_id, o.role, o.ring, count(*) FILTER (WHERE h.by_role = 'outer') AS outers, count(*) FILTER (WHERE h.by_role = 'inner') AS holes FROM ok o LEFT JOIN h ON h.rel_id = o.rel_id AND h.ring = o.ring GROUP BY ALL),
r AS (SELECT rel_id, CAST(sum(len(nodes) - 1 - len(list_distinct(nodes))) AS BIGINT) AS repeated FROM ok GROUP BY rel_id),
f AS (SELECT r.rel_id, repeated, coalesce((SELECT c.k FROM c WHERE c.rel_id = r.rel_id), 0) AS crossings, CAST(count_if(role = 'outer' AND outers > 0) AS BIGINT) AS nested_outers, CAST(count_if(role = 'inner' AND outers <> 1) AS BIGINT) AS loose_holes,
 CAST(count_if(role = 'inner' AND holes > 0) AS BIGINT) AS nested_holes FROM r JOIN k USING (rel_id) GROUP BY ALL)
SELECT *, repeated + crossings + nested_outers + loose_holes + nested_holes = 0 AS valid FROM f""")
def g12_relations(spark, d):
    return multipolygon.validity(_made(spark, d)[1], 4.0)


def _dense(source: str, key: str, step: str) -> str:
    return f"""SELECT {key}, count(*) OVER (PARTITION BY {key}) AS n, row_number() OVER (PARTITION BY {key} ORDER BY pos, t) - 1 AS i, CASE WHEN x0 IS NULL THEN x ELSE x0 + (x - x0) * (t / k) END AS x, CASE WHEN x0 IS NULL THEN y ELSE y0 + (y - y0) * (t / k) END AS y
FROM (SELECT *, unnest(range(1, CAST(k AS BIGINT) + 1)) AS t FROM (SELECT *, CASE WHEN x0 IS NULL THEN 1 ELSE greatest(1, ceil(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) / {step})) END AS k
 FROM (SELECT {key}, pos, x, y, lag(x) OVER (PARTITION BY {key} ORDER BY pos) AS x0, lag(y) OVER (PARTITION BY {key} ORDER BY pos) AS y0 FROM {source}) a) b) c"""


_ON_LINE = "greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0e0)))"
_MATCHED = f"""lp AS ({_dense('probe_lines', 'line_id', '0.1e0')}), wp AS ({_dense('local_ways', 'way_id', '0.1e0')}),
sm AS (SELECT * FROM lp WHERE n <= 40 OR i IN (SELECT CAST(floor(j * (lp.n - 1) / 39) AS BIGINT) FROM range(0, 40) r(j))),
nw AS (SELECT line_id, i, arg_min(w, (d, w)) AS way_id FROM (SELECT s.line_id, s.i, w.way_id AS w, (s.x - w.x) * (s.x - w.x) + (s.y - w.y) * (s.y - w.y) AS d FROM sm s, wp w) t GROUP BY ALL),
vt AS (SELECT line_id, way_id, count(*) AS votes FROM nw GROUP BY line_id, way_id QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, way_id) <= 3),
sg AS (SELECT * FROM (SELECT way_id, x AS x1, y AS y1, lead(x) OVER (PARTITION BY way_id ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY pos) AS y2 FROM local_ways) t WHERE x2 IS NOT NULL),
pd AS (SELECT line_id, way_id, votes, i, min(sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2))) AS d FROM (SELECT v.*, lp.i, lp.x, lp.y, sg.x1, sg.y1, sg.x2, sg.y2, coalesce({_ON_LINE}, 0e0) AS f FROM vt v JOIN lp USING (line_id) JOIN sg USING (way_id)) t GROUP BY ALL),
md AS (SELECT line_id, way_id, votes, quantile_cont(d, 0.5) AS distance FROM pd GROUP BY ALL)"""


@query("j15_nearest_way", f"WITH {_MATCHED} SELECT line_id, way_id, votes, round(distance, 6) AS distance FROM md QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY md.distance, way_id) = 1")
def j15(spark, d):
    got = matching.matched_ways(view(spark, d, "probe_lines"), view(spark, d, "local_ways"), "line_id", 0.1)
    return got.select("line_id", "way_id", "votes", F.round("distance", 6).alias("distance"))


_UNMATCHED = f"""lp AS ({_dense('probe_lines', 'line_id', '0.1e0')}), wp AS ({_dense('local_ways', 'way_id', '0.1e0')}),
sm AS (SELECT * FROM wp WHERE n <= 24 OR i IN (SELECT CAST(floor(j * (wp.n - 1) / 23) AS BIGINT) FROM range(0, 24) r(j))),
nr AS (SELECT way_id, i, (SELECT min(sqrt((lp.x - sm.x) * (lp.x - sm.x) + (lp.y - sm.y) * (lp.y - sm.y))) FROM lp) AS d FROM sm),
um AS (SELECT way_id, count(*) AS samples, quantile_cont(d, 0.5) > 0.5 AS unmatched FROM nr GROUP BY way_id)"""


def _unmatched(spark, d) -> DataFrame:
    links = view(spark, d, "probe_lines").withColumnRenamed("line_id", "way_id")
    return matching.unmatched_ways(view(spark, d, "local_ways"), links, 0.5, 0.1)


@query("q18_unmatched_ways", f"WITH {_UNMATCHED} SELECT way_id, samples, unmatched FROM um")
def q18_ways(spark, d):
    return _unmatched(spark, d)


@query("q18_source_disagreement", f"WITH {_UNMATCHED} SELECT count(*) AS ways, count_if(unmatched) AS unmatched, round(count_if(unmatched) / count(*), 4) AS share FROM um")
def q18(spark, d):
    return matching.disagreement(_unmatched(spark, d))


_HOLDS = "list_sum(list_transform(range(1, len({v}) + 1), lambda i: CASE WHEN ({b}.y > {y}) <> ({v}[i].y > {y}) AND {x} < {b}.x + ({y} - {b}.y) * ({v}[i].x - {b}.x) / ({v}[i].y - {b}.y) THEN 1 ELSE 0 END)) % 2 = 1"


def _holds_sql(v: str, x: str, y: str) -> str:
    return _HOLDS.format(v=v, x=x, y=y, b=f"{v}[CASE WHEN i = 1 THEN len({v}) ELSE i - 1 END]")


_SIDES = """sh AS (SELECT shape_id AS id, cell_x, cell_y, kind, list({'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE)} ORDER BY pos) AS v FROM local_shapes GROUP BY ALL),
pr AS (SELECT a.cell_x, a.cell_y, a.kind, a.id AS a, b.id AS b, a.v AS av, b.v AS bv FROM sh a JOIN sh b ON a.cell_x = b.cell_x AND a.cell_y = b.cell_y AND a.kind = b.kind AND a.id < b.id),
vx AS (SELECT a, b, 'a' AS side, unnest(av) AS p, bv AS v FROM pr UNION ALL SELECT a, b, 'b', unnest(bv), av FROM pr),
""" + f"""vi AS (SELECT a, b, side, row_number() OVER () AS k, p, v, {_holds_sql('v', 'p.x', 'p.y')} AS inside FROM vx),
vg AS (SELECT k, min(sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2))) AS gap FROM (SELECT *, coalesce({_ON_LINE}, 0e0) AS f FROM (SELECT k, p.x AS x, p.y AS y, v[i].x AS x1, v[i].y AS y1, v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END].x AS x2, v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END].y AS y2 FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM vi) t) u) w GROUP BY k),
vs AS (SELECT a, b, bool_and(inside OR gap <= 1) FILTER (WHERE side = 'a') AS a_in, bool_and(inside OR gap <= 1) FILTER (WHERE side = 'b') AS b_in, bool_or(inside AND gap > 1) FILTER (WHERE side = 'a') AS a_deep, bool_or(inside AND gap > 1) FILTER (WHERE side = 'b') AS b_deep FROM vi JOIN vg USING (k) GROUP BY ALL),
tn AS (SELECT id, min(w) AS mark FROM (SELECT id, list_concat(r[k:], r[1:k - 1]) AS w FROM (SELECT id, r, unnest(range(1, len(r) + 1)) AS k FROM (SELECT id, v AS r FROM sh UNION ALL SELECT id, list_reverse(v) FROM sh) t) u) x GROUP BY id),
ar AS (SELECT id, abs({_AREA}) AS area, list_min(list_transform(v, lambda p: p.x)) AS x_lo, list_max(list_transform(v, lambda p: p.x)) AS x_hi, list_min(list_transform(v, lambda p: p.y)) AS y_lo, list_max(list_transform(v, lambda p: p.y)) AS y_hi FROM sh),
rl AS (SELECT pr.*, CASE WHEN ta.mark = tb.mark THEN 'equal' WHEN b_in AND NOT a_deep THEN 'contains' WHEN a_in AND NOT b_deep THEN 'inside' END AS relation, a_deep OR b_deep AS deep, CASE WHEN ra.area <= rb.area THEN ra ELSE rb END AS s, least(ra.area, rb.area) AS low
 FROM pr JOIN vs USING (a, b) JOIN tn ta ON ta.id = pr.a JOIN tn tb ON tb.id = pr.b JOIN ar ra ON ra.id = pr.a JOIN ar rb ON rb.id = pr.b),
gr AS (SELECT a, b, count_if({_holds_sql('av', 'px', 'py')} AND {_holds_sql('bv', 'px', 'py')}) * (s.x_hi - s.x_lo) / 24 * ((s.y_hi - s.y_lo) / 24) AS area, low FROM (SELECT *, s.x_lo + (k % 24 + 0.5e0) * ((s.x_hi - s.x_lo) / 24) AS px, s.y_lo + (k // 24 + 0.5e0) * ((s.y_hi - s.y_lo) / 24) AS py
 FROM (SELECT *, unnest(range(0, 576)) AS k FROM rl WHERE relation IS NULL AND deep) t) u GROUP BY a, b, s, low)"""


@query("j30_polygon_pairs", f"""WITH {_SIDES} SELECT cell_x, cell_y, kind, a, b, coalesce(relation, 'overlaps') AS relation, CASE WHEN relation IS NULL THEN round(gr.area, 3) END AS area
FROM rl LEFT JOIN gr USING (a, b) WHERE relation IS NOT NULL OR gr.area >= greatest(1, 0.01e0 * gr.low)""")
def j30(spark, d):
    v = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    shapes = view(spark, d, "local_shapes").groupBy("cell_x", "cell_y", "kind", F.col("shape_id").alias("id")).agg(v.alias("v"))
    got = matching.polygon_pairs(shapes, ["cell_x", "cell_y", "kind"], 256.0)
    return got.select("cell_x", "cell_y", "kind", "a", "b", "relation", F.round("area", 3).alias("area"))
