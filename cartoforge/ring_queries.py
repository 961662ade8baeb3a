"""Queries on rings and lattices: clean-up, clipping, containment, keys and borrowed shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import grid as G
from .functions import rings as R
from .operators import containment, spatial, tiles
from .operators.multipolygon import clipped_to_cells
from .queries import _RINGS, _rings, query
from .sources.adapters import view

# Background ways as rings on a lattice of 8 x 8 cells of 4096 units.
_LATTICE = """rv AS (SELECT p.way_id, coalesce(w.nat, w.landuse) AS kind, p.pos, CAST(round_even((p.lon - 115.5e0) * 32768e0, 0) AS BIGINT) AS x, CAST(round_even((p.lat + 32.5e0) * 32768e0, 0) AS BIGINT) AS y
  FROM geo_points p JOIN osm_ways w ON p.way_id = w.way_id WHERE w.highway IS NULL),
lat_rings AS (SELECT way_id, kind, list({'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE)} ORDER BY pos) AS v FROM rv GROUP BY way_id, kind HAVING count(*) >= 3)"""
_BEFORE, _AFTER = "v[CASE WHEN i = 1 THEN len(v) ELSE i - 1 END]", "v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END]"
_AREA = f"CASE WHEN len(v) >= 3 THEN list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i].x * {_AFTER}.y - {_AFTER}.x * v[i].y)) / 2 ELSE 0e0 END"


def lattice_rings(spark, d) -> DataFrame:
    """way_id, kind, v (vertices in order) of every background way with three points or more."""
    ways = view(spark, d, "osm_ways").where("highway is null").select("way_id", F.coalesce("nat", "landuse").alias("kind"))
    p = view(spark, d, "geo_points").join(ways, "way_id")
    at = lambda c, o: F.rint((F.col(c) - o) * 32768.0)
    v = F.sort_array(F.collect_list(F.struct("pos", at("lon", 115.5).alias("x"), at("lat", -32.5).alias("y"))))
    return p.groupBy("way_id", "kind").agg(v.alias("v")).where("size(v) >= 3").select("way_id", "kind", F.transform("v", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("v"))


def _clipped(spark, d) -> DataFrame:
    return clipped_to_cells(lattice_rings(spark, d), 4096, 0, 7)


def _half_sql(source: str, name: str, axis: str, op: str, bound: str) -> str:
    o = "y" if axis == "x" else "x"
    p = _BEFORE
    at = f"{p}.{o} + ({bound} - {p}.{axis}) / (v[i].{axis} - {p}.{axis}) * (v[i].{o} - {p}.{o})"
    cross = f"{{'x': {bound}, 'y': {at}}}" if axis == "x" else f"{{'x': {at}, 'y': {bound}}}"
    step = f"CASE WHEN v[i].{axis} {op} {bound} THEN CASE WHEN {p}.{axis} {op} {bound} THEN [v[i]] ELSE [{cross}, v[i]] END WHEN {p}.{axis} {op} {bound} THEN [{cross}] ELSE [] END"
    return f"{name} AS (SELECT way_id, kind, cx, cy, flatten(list_transform(range(1, len(v) + 1), lambda i: {step})) AS v FROM {source})"


_CELL = "least(greatest(CAST(floor(list_{m}(list_transform(v, lambda p: p.{a})) / 4096e0) AS BIGINT), 0), 7)"
_CLIPPED = f"""{_LATTICE}, rc AS (SELECT way_id, kind, cx, unnest(range(y0, y1 + 1)) AS cy, v FROM (SELECT way_id, kind, unnest(range({_CELL.format(m='min', a='x')}, {_CELL.format(m='max', a='x')} + 1)) AS cx,
 {_CELL.format(m='min', a='y')} AS y0, {_CELL.format(m='max', a='y')} AS y1, v FROM lat_rings) t),
{_half_sql('rc', 'c1', 'x', '>=', '(cx * 4096e0)')}, {_half_sql('c1', 'c2', 'x', '<=', '(cx * 4096e0 + 4096e0)')}, {_half_sql('c2', 'c3', 'y', '>=', '(cy * 4096e0)')}, {_half_sql('c3', 'c4', 'y', '<=', '(cy * 4096e0 + 4096e0)')},
clipped AS (SELECT * FROM c4 WHERE len(v) >= 3)"""


@query("g04_clipped_rings", f"WITH {_CLIPPED} SELECT way_id, cx, cy, len(v) AS n, round({_AREA}, 3) AS area FROM clipped")
def g04(spark, d):
    return _clipped(spark, d).select("way_id", "cx", "cy", F.size("v").cast("long").alias("n"), F.round(R.area(F.col("v")), 3).alias("area"))


_ON = "len(list_filter(v, lambda p: p.{a} <> {b})) = 0"


@query("x30_edge_keys", f"""WITH {_CLIPPED} SELECT way_id, cx, cy, CASE WHEN {_ON.format(a='x', b='cx * 4096e0 + 4096e0')} THEN 'E' ELSE '' END || CASE WHEN {_ON.format(a='y', b='cy * 4096e0 + 4096e0')} THEN 'N' ELSE '' END
 || CASE WHEN {_ON.format(a='y', b='cy * 4096e0')} THEN 'S' ELSE '' END || CASE WHEN {_ON.format(a='x', b='cx * 4096e0')} THEN 'W' ELSE '' END AS edges FROM clipped""")
def x30(spark, d):
    x, y = F.col("cx") * 4096.0, F.col("cy") * 4096.0
    return _clipped(spark, d).select("way_id", "cx", "cy", R.edges_of(F.col("v"), x, x + 4096.0, y, y + 4096.0).alias("edges"))


@query("a38_flat_clips", f"""WITH {_CLIPPED} SELECT kind, ({_AREA}) = 0 AS flat, count(*) AS n, count(DISTINCT way_id) AS ways FROM clipped GROUP BY ALL""")
def a38(spark, d):
    c = _clipped(spark, d).select("kind", "way_id", (R.area(F.col("v")) == 0).alias("flat"))
    return c.groupBy("kind", "flat").agg(F.count("*").alias("n"), F.countDistinct("way_id").alias("ways"))


@query("g09_emitted_kinds", f"WITH {_CLIPPED} SELECT kind, cx, cy, count(*) AS shapes, round(sum(abs({_AREA})), 2) AS area FROM clipped GROUP BY kind, cx, cy")
def g09(spark, d):
    return _clipped(spark, d).groupBy("kind", "cx", "cy").agg(F.count("*").alias("shapes"), F.round(F.sum(F.abs(R.area(F.col("v"))).cast("decimal(38,12)")).cast("double"), 2).alias("area"))


_DEMAND = "(SELECT DISTINCT kind, cx, cy FROM clipped WHERE abs({a}) >= 1e5)"


@query("q13_demanded_cells", f"""WITH {_CLIPPED}, have AS (SELECT CAST(floor((lon - 115.5e0) * 8) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * 8) AS BIGINT) AS cy FROM osm_nodes WHERE place IS NOT NULL GROUP BY cx, cy HAVING count(*) % 2 = 0)
SELECT kind, cx, cy FROM {_DEMAND.format(a='(' + _AREA + ')')} w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.cx = w.cx AND h.cy = w.cy)""")
def q13(spark, d):
    want = _clipped(spark, d).where(F.abs(R.area(F.col("v"))) >= 1e5).select("kind", "cx", "cy").distinct()
    have = view(spark, d, "osm_nodes").where("place is not null").groupBy(F.floor((F.col("lon") - 115.5) * 8).alias("cx"), F.floor((F.col("lat") + 32.5) * 8).alias("cy")).count().where("count % 2 = 0").select("cx", "cy")
    return want.join(have, ["cx", "cy"], "left_anti").select("kind", "cx", "cy")


@query("q14_centres_covered", f"""WITH {_CLIPPED} SELECT way_id, cx, cy, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN ({_BEFORE}.y > cy * 4096e0 + 2048e0) <> (v[i].y > cy * 4096e0 + 2048e0)
 AND cx * 4096e0 + 2048e0 < {_BEFORE}.x + (cy * 4096e0 + 2048e0 - {_BEFORE}.y) * (v[i].x - {_BEFORE}.x) / (v[i].y - {_BEFORE}.y) THEN 1 ELSE 0 END)) % 2 = 1 AS covered FROM clipped""")
def q14(spark, d):
    return _clipped(spark, d).select("way_id", "cx", "cy", R.holds(F.col("v"), F.col("cx") * 4096.0 + 2048.0, F.col("cy") * 4096.0 + 2048.0).alias("covered"))


@query("q15_clips_inside", f"""WITH {_CLIPPED} SELECT cx, cy, count(*) AS n, CAST(count_if(list_min(list_transform(v, lambda p: p.x)) < cx * 4096e0 OR list_max(list_transform(v, lambda p: p.x)) > cx * 4096e0 + 4096e0
 OR list_min(list_transform(v, lambda p: p.y)) < cy * 4096e0 - 1e-6 OR list_max(list_transform(v, lambda p: p.y)) > cy * 4096e0 + 4096e0 + 1e-6) AS BIGINT) AS outside FROM clipped GROUP BY cx, cy""")
def q15(spark, d):
    b, x, y = R.box(F.col("v")), F.col("cx") * 4096.0, F.col("cy") * 4096.0
    out = (b["x_lo"] < x) | (b["x_hi"] > x + 4096.0) | (b["y_lo"] < y - 1e-6) | (b["y_hi"] > y + 4096.0 + 1e-6)
    return _clipped(spark, d).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.count_if(out).alias("outside"))


@query("x24_ring_boxes", f"""WITH {_LATTICE}, b AS (SELECT way_id, list_min(list_transform(v, lambda p: p.x)) AS x_lo, list_max(list_transform(v, lambda p: p.x)) AS x_hi, list_min(list_transform(v, lambda p: p.y)) AS y_lo, list_max(list_transform(v, lambda p: p.y)) AS y_hi FROM lat_rings)
SELECT *, x_lo <= 16384e0 AND x_hi >= 12288e0 AND y_lo <= 16384e0 AND y_hi >= 12288e0 AS meets FROM b""")
def x24(spark, d):
    b = lattice_rings(spark, d).select("way_id", *(c.alias(k) for k, c in R.box(F.col("v")).items()))
    return b.withColumn("meets", F.expr("x_lo <= 16384 and x_hi >= 12288 and y_lo <= 16384 and y_hi >= 12288"))


_TURNS = "list_transform(range(1, len({v}) + 1), lambda i: list_concat({v}[i:], {v}[:i - 1]))"


@query("x27_canonical_rings", f"""WITH {_LATTICE}, c AS (SELECT way_id, list_sort(list_concat({_TURNS.format(v='v')}, {_TURNS.format(v='w')}))[1] AS v FROM (SELECT way_id, v, list_reverse(v) AS w FROM lat_rings) t)
SELECT way_id, array_to_string(list_transform(v, lambda p: CAST(CAST(p.x AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(p.y AS BIGINT) AS VARCHAR)), ',') AS ring FROM c""")
def x27(spark, d):
    r, v = lattice_rings(spark, d), F.col("v")
    k = (F.col("way_id") % F.size("v")).cast("int")  # each ring turned, and every third reversed: the same form comes out
    turned = F.concat(F.slice(v, k + 1, F.size(v)), F.slice(v, F.lit(1), k))
    form = R.canonical(F.when(F.col("way_id") % 3 == 0, F.reverse(turned)).otherwise(turned))
    return r.select("way_id", F.array_join(F.transform(form, lambda p: F.concat_ws(":", p["x"].cast("long"), p["y"].cast("long"))), ",").alias("ring"))


_SAME = "{a}.x = {b}.x AND {a}.y = {b}.y"


def _drop_sql(source: str, name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT way_id, CASE WHEN len(v) > 1 THEN list_transform(list_filter(range(1, len(v) + 1), lambda i: NOT ({_SAME.format(a=a, b=b)})), lambda i: v[i]) ELSE v END AS v FROM {source})"


@query("x28_cleaned_rings", f"""WITH {_LATTICE}, k0 AS (SELECT way_id, list_transform(v, lambda p: {{'x': round_even(p.x / 4096e0, 0), 'y': round_even(p.y / 4096e0, 0)}}) AS v FROM lat_rings),
{_drop_sql('k0', 'k1', 'v[i]', _BEFORE)}, {_drop_sql('k1', 'k2', _BEFORE, _AFTER)}, {_drop_sql('k2', 'k3', 'v[i]', _BEFORE)}, {_drop_sql('k3', 'k4', _BEFORE, _AFTER)}, {_drop_sql('k4', 'k5', 'v[i]', _BEFORE)}
SELECT way_id, CASE WHEN {_AREA} <> 0 THEN len(v) ELSE 0 END AS n, CASE WHEN {_AREA} <> 0 THEN {_AREA} ELSE 0e0 END AS area FROM k5""")
def x28(spark, d):
    coarse = F.transform("v", lambda p: F.struct(F.rint(p["x"] / 4096).alias("x"), F.rint(p["y"] / 4096).alias("y")))
    r = lattice_rings(spark, d).select("way_id", R.cleaned(coarse).alias("v"))
    return r.select("way_id", F.size("v").cast("long").alias("n"), F.when(F.size("v") > 0, R.area(F.col("v"))).otherwise(0.0).alias("area"))


@query("x29_centre_in_ring", f"""WITH {_LATTICE}, t AS (SELECT way_id, v, list_sum(list_transform(v, lambda p: p.x)) / len(v) AS x, list_sum(list_transform(v, lambda p: p.y)) / len(v) AS y FROM lat_rings)
SELECT way_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN ({_BEFORE}.y > y) <> (v[i].y > y) AND x < {_BEFORE}.x + (y - {_BEFORE}.y) * (v[i].x - {_BEFORE}.x) / (v[i].y - {_BEFORE}.y) THEN 1 ELSE 0 END)) % 2 = 1 AS inside FROM t""")
def x29(spark, d):
    mean = lambda k: F.aggregate("v", F.lit(0.0), lambda a, p: a + p[k]) / F.size("v")
    t = lattice_rings(spark, d).withColumn("px", mean("x")).withColumn("py", mean("y"))
    return t.select("way_id", R.holds(F.col("v"), F.col("px"), F.col("py")).alias("inside"))


@query("j13_point_in_kind", f"""WITH {_LATTICE}, e AS (SELECT way_id, kind, {_BEFORE} AS p, v[i] AS q FROM (SELECT way_id, kind, v, unnest(range(1, len(v) + 1)) AS i FROM lat_rings) t),
n AS (SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'water' ELSE 'forest' END AS kind, (lon - 115.5e0) * 32768e0 AS x, (lat + 32.5e0) * 32768e0 AS y FROM osm_nodes)
SELECT node_id, count(*) AS rings, min(way_id) AS first_way FROM (SELECT node_id, way_id FROM n JOIN e ON n.kind = e.kind AND (p.y > y) <> (q.y > y) AND x < p.x + (y - p.y) * (q.x - p.x) / (q.y - p.y) GROUP BY node_id, way_id HAVING count(*) % 2 = 1) t GROUP BY node_id""")
def j13(spark, d):
    kind = F.when(F.col("node_id") % 2 == 0, "water").otherwise("forest")
    p = view(spark, d, "osm_nodes").select(F.col("node_id").alias("id"), kind.alias("kind"), ((F.col("lon") - 115.5) * 32768).alias("x"), ((F.col("lat") + 32.5) * 32768).alias("y"))
    inside = containment.rings_at_points(p, lattice_rings(spark, d).withColumnRenamed("way_id", "ring"), 4096.0)
    return inside.select(F.col("id").alias("node_id"), "rings", F.col("first").alias("first_way"))


@query("j14_box_cells", f"""WITH {_LATTICE}, b AS (SELECT way_id, CAST(floor(list_min(list_transform(v, lambda p: p.x)) / 4096e0) AS BIGINT) AS x0, CAST(floor(list_max(list_transform(v, lambda p: p.x)) / 4096e0) AS BIGINT) AS x1,
 CAST(floor(list_min(list_transform(v, lambda p: p.y)) / 4096e0) AS BIGINT) AS y0, CAST(floor(list_max(list_transform(v, lambda p: p.y)) / 4096e0) AS BIGINT) AS y1, CAST(floor(v[1].x / 4096e0) AS BIGINT) AS hx, CAST(floor(v[1].y / 4096e0) AS BIGINT) AS hy FROM lat_rings),
c AS (SELECT DISTINCT CAST(floor((lon - 115.5e0) * 8) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * 8) AS BIGINT) AS cy FROM osm_nodes)
SELECT way_id, cx, cy, x0 < hx - 1 OR x1 > hx + 1 OR y0 < hy - 1 OR y1 > hy + 1 AS tall FROM b JOIN c ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1""")
def j14(spark, d):
    b = R.box(F.col("v"))
    cell = lambda c: F.floor(c / 4096).cast("long")
    boxes = lattice_rings(spark, d).select("way_id", cell(b["x_lo"]).alias("x0"), cell(b["x_hi"]).alias("x1"), cell(b["y_lo"]).alias("y0"), cell(b["y_hi"]).alias("y1"), cell(F.col("v")[0]["x"]).alias("hx"), cell(F.col("v")[0]["y"]).alias("hy"))
    cells = view(spark, d, "osm_nodes").select(F.floor((F.col("lon") - 115.5) * 8).alias("cx"), F.floor((F.col("lat") + 32.5) * 8).alias("cy")).distinct()
    return spatial.cells_of_boxes(boxes, cells)


@query("g05_cover_rings", f"WITH {_RINGS} SELECT way_id, ix, iy, ix * 4096 - 1024 AS x_lo, ix * 4096 + 5120 AS x_hi, iy * 4096 - 1024 AS y_lo, iy * 4096 + 5120 AS y_hi FROM inner_cells")
def g05(spark, d):
    return tiles.cover_rings(tiles.interior_cells(_rings(spark, d), 64), 4096, 1024)


@query("j05_merged_shapes", f"""WITH {_RINGS}, h AS (SELECT way_id, CAST(floor((avg(lon) - 115.5e0) * 64) AS BIGINT) AS hx, CAST(floor((avg(lat) + 32.5e0) * 64) AS BIGINT) AS hy FROM rings GROUP BY way_id),
m AS (SELECT hx AS ix, hy AS iy, way_id, false AS borrowed, hx, hy FROM h UNION ALL SELECT e.ix, e.iy, e.way_id, true, hx, hy FROM (SELECT DISTINCT way_id, ix, iy FROM edge) e JOIN h ON e.way_id = h.way_id WHERE e.ix <> hx OR e.iy <> hy)
SELECT ix, iy, way_id, borrowed, row_number() OVER (PARTITION BY ix, iy ORDER BY borrowed, hy, hx, way_id) AS place FROM m""")
def j05(spark, d):
    r = _rings(spark, d)
    homes = r.groupBy("way_id").agg(F.floor((F.avg("lon") - 115.5) * 64).alias("hx"), F.floor((F.avg("lat") + 32.5) * 64).alias("hy"))
    return tiles.merge_borrowed(homes, tiles.edge_cells(r, 64).select("way_id", "ix", "iy").distinct())


_LAST = "max_by(lat, pos) AS lat2, max_by(lon, pos) AS lon2, min_by(lat, pos) AS lat1, min_by(lon, pos) AS lon1"


@query("x07_flat_bearing", f"""WITH e AS (SELECT way_id, {_LAST} FROM geo_points GROUP BY way_id), t AS (SELECT way_id, lat2 - lat1 AS dy, (lon2 - lon1) * cos((lat1 + lat2) / 2 * 0.017453292519943295e0) AS dx FROM e)
SELECT way_id, CASE WHEN dx = 0 AND dy = 0 THEN 0e0 ELSE round(CASE WHEN dx < 0 THEN 360e0 ELSE 0e0 END + atan2(dx, dy) / 0.017453292519943295e0, 4) END AS angle FROM t""")
def x07(spark, d):
    e = view(spark, d, "geo_points").groupBy("way_id").agg(F.min(F.struct("pos", "lat", "lon")).alias("a"), F.max(F.struct("pos", "lat", "lon")).alias("z"))
    return e.select("way_id", F.round(G.flat_bearing(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")), 4).alias("angle"))


@query("x14_frame_lattice", """SELECT node_id, gx, gy, CAST(floor(gx / 8192e0) AS BIGINT) AS fx, CAST(floor(gy / 8192e0) AS BIGINT) AS fy, gx - CAST(floor(gx / 8192e0) AS BIGINT) * 8192 AS lx, gy - CAST(floor(gy / 8192e0) AS BIGINT) * 8192 AS ly
FROM (SELECT node_id, CAST(round_even((lon - 115.5e0) * 32768e0, 0) AS BIGINT) AS gx, CAST(round_even((lat + 32.5e0) * 32768e0, 0) AS BIGINT) AS gy FROM osm_nodes) t""")
def x14(spark, d):
    p = view(spark, d, "osm_nodes").select("node_id", F.rint((F.col("lon") - 115.5) * 32768).cast("long").alias("gx"), F.rint((F.col("lat") + 32.5) * 32768).cast("long").alias("gy"))
    (fx, lx), (fy, ly) = G.frame_local(F.col("gx"), 8192), G.frame_local(F.col("gy"), 8192)
    return p.select("node_id", G.frame_global(fx, lx, 8192).alias("gx"), G.frame_global(fy, ly, 8192).alias("gy"), fx.alias("fx"), fy.alias("fy"), lx.alias("lx"), ly.alias("ly"))


@query("x18_typed_keys", """SELECT kind, x, y, count(*) AS n FROM (SELECT coalesce(place, '') AS kind, CAST(round_even((lon - 115.5e0) * 64e0, 0) AS BIGINT) AS x, CAST(round_even((lat + 32.5e0) * 64e0, 0) AS BIGINT) AS y FROM osm_nodes) t GROUP BY kind, x, y""")
def x18(spark, d):
    p = view(spark, d, "osm_nodes").select(F.struct(F.coalesce("place", F.lit("")).alias("kind"), F.rint((F.col("lon") - 115.5) * 64).cast("long").alias("x"), F.rint((F.col("lat") + 32.5) * 64).cast("long").alias("y")).alias("key"))
    return p.groupBy("key").agg(F.count("*").alias("n")).select("key.*", "n")


_T = "greatest(0e0, least(1e0, CASE WHEN dx * dx + dy * dy > 0 THEN ((x3 - x1) * dx + (y3 - y1) * dy) / (dx * dx + dy * dy) ELSE 0e0 END))"


@query("x19_segment_distances", f"""WITH s AS (SELECT way_id, pos, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, lead(lon, 2) OVER w AS x3, lead(lat, 2) OVER w AS y3 FROM geo_points WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
t AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s WHERE x3 IS NOT NULL), f AS (SELECT way_id, pos, x3 - (x1 + {_T} * dx) AS ex, y3 - (y1 + {_T} * dy) AS ey FROM t)
SELECT way_id, pos, round(sqrt(ex * ex + ey * ey), 6) AS straight, round(greatest(abs(ex), abs(ey)), 6) AS chebyshev FROM f""")
def x19(spark, d):
    w = Window.partitionBy("way_id").orderBy("pos")
    s = view(spark, d, "geo_points").select("way_id", "pos", F.col("lon").alias("x1"), F.col("lat").alias("y1"), *(F.lead(c, k).over(w).alias(a) for c, k, a in (("lon", 1, "x2"), ("lat", 1, "y2"), ("lon", 2, "x3"), ("lat", 2, "y3")))).where("x3 is not null")
    args = [F.col(c) for c in ("x3", "y3", "x1", "y1", "x2", "y2")]
    return s.select("way_id", "pos", F.round(G.segment_distance(*args), 6).alias("straight"), F.round(G.segment_chebyshev(*args), 6).alias("chebyshev"))


@query("x21_metres_per_degree", """SELECT node_id, round(110574e0 * (lat + 32.5e0), 3) AS north, round(111320e0 * cos(lat * 0.017453292519943295e0) * (lon - 115.5e0), 3) AS east,
 round(111132.92e0 - 559.82e0 * cos(2 * lat * 0.017453292519943295e0) + 1.175e0 * cos(4 * lat * 0.017453292519943295e0) - 0.0023e0 * cos(6 * lat * 0.017453292519943295e0), 3) AS per_lat,
 round(111412.84e0 * cos(lat * 0.017453292519943295e0) - 93.5e0 * cos(3 * lat * 0.017453292519943295e0) + 0.118e0 * cos(5 * lat * 0.017453292519943295e0), 3) AS per_lon FROM osm_nodes""")
def x21(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    north, east = G.box_metres(lat)
    per_lat, per_lon = G.ellipsoid_metres(lat)
    return view(spark, d, "osm_nodes").select("node_id", F.round(north * (lat + 32.5), 3).alias("north"), F.round(east * (lon - 115.5), 3).alias("east"), F.round(per_lat, 3).alias("per_lat"), F.round(per_lon, 3).alias("per_lon"))
