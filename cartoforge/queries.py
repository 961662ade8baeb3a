"""Registered queries of the map operators, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grid as G
from .functions import rules as P
from .operators import address, graph, reconcile, spatial, tiles
from .sources.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, with_views(sql)
        return f

    return add


# The tag values that each level shows, and the class of each road.
ROADS = {k: ["motorway", "trunk", "primary", "secondary", "residential", "service"][:m] for k, m in ((0, 6), (2, 5), (4, 4), (6, 3), (8, 2), (10, 2), (12, 1))}
PLACES = {k: ["city", "town", "suburb", "locality"][:m] for k, m in ((0, 4), (2, 3), (4, 3), (6, 2), (8, 2), (10, 1), (12, 1))}
KINDS = {k: ["water", "forest"][:m] for k, m in ((0, 2), (2, 2), (4, 2), (6, 2), (8, 1), (10, 1))}
CLASSES = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "residential": 5, "service": 7}
RULES = [
    {"cause": 1, "where": [["code", "==", 288], ["level", "<=", 4], ["d_src", "notnan"]]},
    {"cause": 2, "where": [["code", "in", [291, 321]], ["d_src", ">", 50.0]]},
    {"cause": 3, "where": [["d_src", "isnan"]]},
    {"cause": 4, "where": [["vert", ">=", 12], ["onb", "!=", 0]]},
]


def _in(col: str, table: dict[int, list[str]]) -> str:
    return "CASE level " + " ".join(f"WHEN {k} THEN {col} IN ({', '.join(map(repr, v))})" for k, v in table.items()) + " ELSE false END"


_CAUSE = """CASE WHEN code = 288 AND level <= 4 AND d_src IS NOT NULL THEN 1 WHEN code IN (291, 321) AND d_src > 50e0 THEN 2
 WHEN d_src IS NULL THEN 3 WHEN vert >= 12 AND onb <> 0 THEN 4 END"""
_IX, _IY = "CAST(floor((lon - 115.5e0) / 1e0 * n) AS BIGINT)", "CAST(floor((lat + 32.5e0) / 1e0 * n) AS BIGINT)"
_IN = "ix >= 0 AND ix < n AND iy >= 0 AND iy < n"
_HAV = "2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(({lat2} - {lat1}) * (pi() / 180) / 2), 2) + cos({lat1} * (pi() / 180)) * cos({lat2} * (pi() / 180)) * pow(sin(({lon2} - {lon1}) * (pi() / 180) / 2), 2))))"
HAV = _HAV.format(lat1="lat", lon1="lon", lat2="lat2", lon2="lon2")
SEGS = "segs AS (SELECT * FROM (SELECT way_id, pos, node_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(node_id) OVER w AS next FROM geo_points WINDOW w AS (PARTITION BY way_id ORDER BY pos)) t WHERE lat2 IS NOT NULL)"


@query("s01_way_geometry", """SELECT way_id, count(*) AS n_points, min(pos) AS first_pos, round(sum(lat), 6) AS lat_sum FROM way_refs JOIN osm_nodes USING (node_id) GROUP BY way_id HAVING count(*) >= 2""")
def s01(spark, d):
    w = tiles.way_geometry(view(spark, d, "way_refs"), view(spark, d, "osm_nodes"))
    return w.select("way_id", F.size("points").cast("long").alias("n_points"), F.get("points", F.lit(0))["pos"].alias("first_pos"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"]), 6).alias("lat_sum"))


@query("s02_named_nodes", "SELECT node_id, name, place FROM osm_nodes WHERE name IS NOT NULL")
def s02(spark, d):
    return view(spark, d, "osm_nodes").where("name is not null").select("node_id", "name", "place")


@query("s07_level_stats", f"""SELECT level, count(*) AS n_points, count(DISTINCT ix * 1000 + iy) AS n_cells FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM geo_points, grids) t WHERE {_IN} GROUP BY level""")
def s07(spark, d):
    p = G.with_levels(view(spark, d, "geo_points"), view(spark, d, "grids"))
    c = p.select("level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null")
    return c.groupBy("level", "c").agg(F.count("*").alias("k")).groupBy("level").agg(F.sum("k").alias("n_points"), F.count("*").alias("n_cells"))


@query("s13_coverage", f"""SELECT level, min(ix) AS ix_lo, max(ix) AS ix_hi, min(iy) AS iy_lo, max(iy) AS iy_hi, count(*) = (max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) AS full
 FROM (SELECT DISTINCT level, ix, iy FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids) t WHERE {_IN}) u GROUP BY level""")
def s13(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids"))
    c = p.select("level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").select("level", "c.ix", "c.iy").distinct()
    span = (F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)
    return c.groupBy("level").agg(F.min("ix").alias("ix_lo"), F.max("ix").alias("ix_hi"), F.min("iy").alias("iy_lo"), F.max("iy").alias("iy_hi"), (F.count("*") == span).alias("full"))


@query("g01_tile_census", f"""WITH p AS (SELECT DISTINCT level, way_id, road, ix, iy FROM (SELECT level, n, g.way_id, highway IS NOT NULL AS road, {_IX} AS ix, {_IY} AS iy FROM geo_points g JOIN osm_ways w ON g.way_id = w.way_id, grids) t WHERE {_IN}),
a AS (SELECT level, ix, iy, CAST(sum(CASE WHEN road THEN 1 ELSE 0 END) AS BIGINT) AS roads, CAST(sum(CASE WHEN road THEN 0 ELSE 1 END) AS BIGINT) AS shapes FROM p GROUP BY level, ix, iy),
b AS (SELECT level, ix, iy, count(*) AS names FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids WHERE name IS NOT NULL) t WHERE {_IN} GROUP BY level, ix, iy)
SELECT level, ix, iy, coalesce(roads, 0) AS roads, coalesce(shapes, 0) AS shapes, coalesce(names, 0) AS names FROM a FULL JOIN b USING (level, ix, iy)""")
def census(spark, d):
    return tiles.tile_census(view(spark, d, "osm_nodes"), view(spark, d, "osm_ways"), view(spark, d, "geo_points"), view(spark, d, "grids"))


@query("p02_level_admission", f"""SELECT level, way_id FROM osm_ways, grids WHERE CASE WHEN highway IS NOT NULL THEN {_in('highway', ROADS)} ELSE coalesce({_in('coalesce(nat, landuse)', KINDS)}, false) END""")
def p02(spark, d):
    w = G.with_levels(view(spark, d, "osm_ways"), view(spark, d, "grids"))
    return w.where(P.level_filter(F.col("level"), F.col("highway"), F.lit(None).cast("string"), F.coalesce("nat", "landuse"), ROADS, PLACES, KINDS)).select("level", "way_id")


@query("p04_name_admission", f"""SELECT level, node_id, place FROM osm_nodes, grids WHERE name IS NOT NULL AND {_in('place', PLACES)}""")
def p04(spark, d):
    n = G.with_levels(view(spark, d, "osm_nodes").where("name is not null"), view(spark, d, "grids"))
    return n.where(P.level_filter(F.col("level"), F.lit(None).cast("string"), F.col("place"), F.lit(None).cast("string"), ROADS, PLACES, KINDS)).select("level", "node_id", "place")


@query("p06_first_match", "SELECT way_id, CASE WHEN highway = 'motorway' AND oneway = 'yes' THEN 10 WHEN highway IN ('motorway', 'trunk') THEN 11 WHEN junction = 'roundabout' THEN 12 WHEN highway IS NOT NULL THEN 13 END AS code FROM osm_ways")
def p06(spark, d):
    rules = [{"code": 10, "where": [["highway", "==", "motorway"], ["oneway", "==", "yes"]]}, {"code": 11, "where": [["highway", "in", ["motorway", "trunk"]]]}, {"code": 12, "where": [["junction", "==", "roundabout"]]}, {"code": 13, "where": [["highway", "notnan"]]}]
    w = view(spark, d, "osm_ways")
    return w.select("way_id", P.first_match(rules, w.columns, key="code").alias("code"))


@query("x01_point_cell", f"SELECT node_id, level, ix, iy FROM (SELECT node_id, level, n, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids) t WHERE {_IN}")
def x01(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids"))
    return p.select("node_id", "level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").select("node_id", "level", "c.ix", "c.iy")


@query("x02_cell_bounds", """SELECT level, ix, iy, round(-32.5e0 + iy * (1e0 / n), 6) AS lat_lo, round(-32.5e0 + (iy + 1) * (1e0 / n), 6) AS lat_hi, round(115.5e0 + ix * (1e0 / n), 6) AS lon_lo, round(115.5e0 + (ix + 1) * (1e0 / n), 6) AS lon_hi
 FROM (SELECT level, n, s % n AS ix, CAST(floor(s / n) AS BIGINT) AS iy FROM (SELECT level, n, s_suppkey % (n * n) AS s FROM supplier, grids) a) t GROUP BY level, n, ix, iy""")
def x02(spark, d):
    view(spark, d, "grids")
    c = G.with_levels(spark.table("supplier").select("s_suppkey"), view(spark, d, "grids")).select("level", "n", (F.col("s_suppkey") % (F.col("n") * F.col("n"))).alias("s")).distinct()
    c = c.select("level", "n", (F.col("s") % F.col("n")).alias("ix"), F.floor(F.col("s") / F.col("n")).cast("long").alias("iy"))
    return c.select("level", "ix", "iy", *(F.round(v, 6).alias(k) for k, v in G.cell_bounds(F.col("ix"), F.col("iy"), F.col("n")).items()))


@query("x04_quantise", f"""SELECT node_id, level, greatest(0, least(4096, CAST(round_even(((lon - 115.5e0) / 1e0 * n - ix) * 4096, 0) AS BIGINT))) AS x, greatest(0, least(4096, CAST(round_even(((lat + 32.5e0) / 1e0 * n - iy) * 4096, 0) AS BIGINT))) AS y
 FROM (SELECT *, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids) t WHERE {_IN}""")
def x04(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids")).withColumn("c", G.cell(F.col("lat"), F.col("lon"), F.col("n"))).where("c is not null")
    x, y = G.quantise(F.col("lat"), F.col("lon"), F.col("c.ix"), F.col("c.iy"), F.col("n"))
    return p.select("node_id", "level", x.alias("x"), y.alias("y"))


@query("x05_way_length", f"WITH {SEGS} SELECT way_id, round(sum({HAV}), 3) AS metres, count(*) AS n_segments FROM segs GROUP BY way_id")
def x05(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    return s.groupBy("way_id").agg(F.round(F.sum(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))), 3).alias("metres"), F.count("*").alias("n_segments"))


@query("x10_house_numbers", r"""SELECT addr_id, least(a, b) AS house_lo, greatest(a, b) AS house_hi, street FROM (SELECT addr_id, upper(trim(street_name)) AS street,
 CASE WHEN x = '' THEN 0 ELSE CAST(x AS INT) END AS a, CASE WHEN y <> '' THEN CAST(y AS INT) WHEN x = '' THEN 0 ELSE CAST(x AS INT) END AS b
 FROM (SELECT *, regexp_extract(house_number, '^\s*([0-9]+)', 1) AS x, CASE WHEN regexp_full_match(trim(house_number), '[0-9]+\s*[-–/]\s*[0-9]+') THEN regexp_extract(trim(house_number), '[0-9]+$') ELSE '' END AS y FROM address_points) t) u""")
def x10(spark, d):
    lo, hi = address.house_numbers(F.col("house_number"))
    return view(spark, d, "address_points").select("addr_id", lo.alias("house_lo"), hi.alias("house_hi"), address.key(F.col("street_name")).alias("street"))


@query("x15_coordinate_range", "SELECT p_partkey, greatest(1024, CAST(pow(2, ceil(log2(CAST(greatest(p_partkey * p_size, 1) AS DOUBLE)))) AS BIGINT)) AS coord_range FROM part")
def x15(spark, d):
    view(spark, d, "osm_nodes")
    return spark.table("part").select("p_partkey", G.pow2_range(F.col("p_partkey") * F.col("p_size")).alias("coord_range"))


@query("x16_histogram", "SELECT level, CASE WHEN d_src < 1e1 THEN '0-10' WHEN d_src < 5e1 THEN '10-50' WHEN d_src < 1e2 THEN '50-100' ELSE '100+' END AS bucket, count(*) AS n FROM failures WHERE d_src >= 0 GROUP BY 1, 2")
def x16(spark, d):
    return view(spark, d, "failures").where("d_src >= 0").groupBy("level", G.histogram_bucket(F.col("d_src"), [0.0, 10.0, 50.0, 100.0]).alias("bucket")).agg(F.count("*").alias("n"))


@query("x23_ring_area", """WITH r AS (SELECT way_id, lat, lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, count(*) OVER (PARTITION BY way_id) AS k FROM geo_points WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, round(sum((lon - 115.5e0) * 4096e0 * ((lat2 + 32.5e0) * 4096e0) - (lon2 - 115.5e0) * 4096e0 * ((lat + 32.5e0) * 4096e0)), 3) AS area2 FROM r WHERE k >= 3 GROUP BY way_id""")
def x23(spark, d):
    p = view(spark, d, "geo_points").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p")).where("size(p) >= 3")
    area = G.shoelace(F.transform("p", lambda q: (q["lon"] - 115.5) * 4096.0), F.transform("p", lambda q: (q["lat"] + 32.5) * 4096.0))
    return p.select("way_id", F.round(area, 3).alias("area2"))


@query("g01_split_by_cell", f"""WITH {SEGS},
u AS (SELECT level, n, way_id, pos, (lon - 115.5e0) / 1e0 * n AS u1, (lon2 - 115.5e0) / 1e0 * n AS u2, (lat + 32.5e0) / 1e0 * n AS v1, (lat2 + 32.5e0) / 1e0 * n AS v2 FROM segs, grids),
t AS (SELECT *, list_sort(list_distinct(list_concat([0e0, 1e0], list_transform(range(CAST(floor(least(u1, u2)) AS BIGINT) + 1, CAST(ceil(greatest(u1, u2)) AS BIGINT)), lambda k: (k - u1) / (u2 - u1)),
  list_transform(range(CAST(floor(least(v1, v2)) AS BIGINT) + 1, CAST(ceil(greatest(v1, v2)) AS BIGINT)), lambda k: (k - v1) / (v2 - v1))))) AS ts FROM u),
p AS (SELECT level, n, way_id, pos, i, (ts[i] + ts[i + 1]) / 2 AS m, u1, u2, v1, v2 FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM t) x),
c AS (SELECT level, n, way_id, pos, i, CAST(floor(u1 + (u2 - u1) * m) AS BIGINT) AS ix, CAST(floor(v1 + (v2 - v1) * m) AS BIGINT) AS iy FROM p),
l AS (SELECT *, CASE WHEN lag(ix) OVER w = ix AND lag(iy) OVER w = iy THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY level, way_id ORDER BY pos, i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY level, way_id ORDER BY pos, i) AS run FROM l),
k AS (SELECT level, n, way_id, run, ix, iy, count(*) AS n_parts, min(pos) AS first_pos FROM r GROUP BY level, n, way_id, run, ix, iy)
SELECT level, way_id, row_number() OVER (PARTITION BY level, way_id ORDER BY run) - 1 AS ordinal, ix, iy, n_parts, first_pos FROM k WHERE {_IN}""")
def g01(spark, d):
    return tiles.split_by_cell(tiles.segments(view(spark, d, "geo_points")), view(spark, d, "grids"))


_RINGS = """rings AS (SELECT way_id, lat, lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2 FROM
 (SELECT g.*, count(*) OVER (PARTITION BY way_id) AS k FROM geo_points g WHERE way_id IN (SELECT way_id FROM osm_ways WHERE highway IS NULL)) t WHERE k >= 3 WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
re AS (SELECT way_id, (lon - 115.5e0) / 1e0 * 64 AS u1, (lon2 - 115.5e0) / 1e0 * 64 AS u2, (lat + 32.5e0) / 1e0 * 64 AS v1, (lat2 + 32.5e0) / 1e0 * 64 AS v2 FROM rings),
ea AS (SELECT *, unnest(range(CAST(floor(least(u1, u2) - 1e-6) AS BIGINT), CAST(floor(greatest(u1, u2) + 1e-6) AS BIGINT) + 1)) AS ix FROM re),
eb AS (SELECT *, CASE WHEN u1 <> u2 THEN v1 + (v2 - v1) * greatest(0e0, least(1e0, (ix - 1e-6 - u1) / (u2 - u1))) ELSE v1 END AS ya, CASE WHEN u1 <> u2 THEN v1 + (v2 - v1) * greatest(0e0, least(1e0, (ix + 1 + 1e-6 - u1) / (u2 - u1))) ELSE v2 END AS yb FROM ea),
edge AS (SELECT DISTINCT way_id, ix, iy FROM (SELECT way_id, ix, unnest(range(CAST(floor(least(ya, yb) - 1e-6) AS BIGINT), CAST(floor(greatest(ya, yb) + 1e-6) AS BIGINT) + 1)) AS iy FROM eb) t WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63),
sc AS (SELECT way_id, iy, u1 + (u2 - u1) * ((iy + 0.5e0 - v1) / (v2 - v1)) AS x FROM (SELECT *, unnest(range(CAST(ceil(least(v1, v2) - 0.5e0) AS BIGINT), CAST(ceil(greatest(v1, v2) - 0.5e0) AS BIGINT))) AS iy FROM re) t),
pr AS (SELECT way_id, iy, x, lead(x) OVER w AS x2, row_number() OVER w AS k FROM sc WINDOW w AS (PARTITION BY way_id, iy ORDER BY x)),
inner_cells AS (SELECT DISTINCT way_id, ix, iy FROM (SELECT way_id, iy, unnest(range(CAST(ceil(x - 0.5e0) AS BIGINT), CAST(ceil(x2 - 0.5e0) AS BIGINT))) AS ix FROM pr WHERE k % 2 = 1 AND x2 IS NOT NULL) t WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63
  AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.way_id = t.way_id AND e.ix = t.ix AND e.iy = t.iy))"""


def _rings(spark, d):
    shapes = view(spark, d, "osm_ways").where("highway is null").select("way_id")
    return tiles.closed(view(spark, d, "geo_points").join(shapes, "way_id", "left_semi"))


@query("g02_edge_cells", f"WITH {_RINGS} SELECT way_id, ix, iy FROM edge")
def g02(spark, d):
    return tiles.edge_cells(_rings(spark, d), 64)


@query("g03_interior_cells", f"WITH {_RINGS} SELECT way_id, ix, iy FROM inner_cells")
def g03(spark, d):
    return tiles.interior_cells(_rings(spark, d), 64)


@query("j04_shape_sharing", f"""WITH {_RINGS}, home AS (SELECT way_id, {_IX.replace('* n', '* 64')} AS ix, {_IY.replace('* n', '* 64')} AS iy FROM (SELECT way_id, avg(lat) AS lat, avg(lon) AS lon FROM rings GROUP BY way_id) t),
cells AS (SELECT DISTINCT {_IX.replace('* n', '* 64')} AS ix, {_IY.replace('* n', '* 64')} AS iy FROM osm_nodes),
al AS (SELECT *, false AS interior FROM edge UNION ALL SELECT *, true AS interior FROM inner_cells)
SELECT way_id, ix, iy, interior FROM al a WHERE NOT EXISTS (SELECT 1 FROM home h WHERE h.way_id = a.way_id AND h.ix = a.ix AND h.iy = a.iy) AND EXISTS (SELECT 1 FROM cells c WHERE c.ix = a.ix AND c.iy = a.iy)""")
def j04(spark, d):
    rings, at = _rings(spark, d), lambda: G.cell(F.col("lat"), F.col("lon"), F.lit(64))
    homes = rings.groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select("way_id", at().alias("c")).select("way_id", "c.ix", "c.iy")
    cells = view(spark, d, "osm_nodes").select(at().alias("c")).where("c is not null").select("c.ix", "c.iy")
    return tiles.share_shapes(rings, homes, cells, 64)


@query("w03_name_cap", f"""SELECT level, ix, iy, node_id FROM (SELECT level, ix, iy, node_id, row_number() OVER (PARTITION BY level, ix, iy, place ORDER BY node_id) AS k FROM (SELECT level, n, node_id, place, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids WHERE name IS NOT NULL) t WHERE {_IN}) u WHERE level < 4 OR k <= 4""")
def w03(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes").where("name is not null"), view(spark, d, "grids"))
    p = p.select("level", "node_id", "place", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").select("level", "node_id", "place", "c.ix", "c.iy")
    return tiles.capped(p, ["level", "ix", "iy", "place"], ["node_id"], F.when(F.col("level") >= 4, 4)).select("level", "ix", "iy", "node_id")


@query("w06_budget_trim", "SELECT l_suppkey AS cell, l_orderkey AS way_id, l_linenumber AS part, l_partkey AS node_id, CAST(l_quantity AS BIGINT) AS size, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 900 AS kept FROM lineitem")
def w06(spark, d):
    view(spark, d, "way_refs")
    rows = spark.table("lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("node_id"), F.col("l_quantity").cast("long").alias("size"), "l_extendedprice", "l_shipdate")
    return tiles.trimmed(rows, ["cell"], [F.desc("size"), "way_id", "part", "node_id", "l_extendedprice", "l_shipdate"], "size", 900).select("cell", "way_id", "part", "node_id", "size", "kept")


@query("w08_runs", f"SELECT iy, min(ix) AS run_lo, max(ix) AS run_hi, count(*) AS n FROM (SELECT iy, ix, ix - row_number() OVER (PARTITION BY iy ORDER BY ix) AS g FROM (SELECT DISTINCT {_IX.replace('* n', '* 64')} AS ix, {_IY.replace('* n', '* 64')} AS iy FROM osm_nodes) t) u GROUP BY iy, g")
def w08(spark, d):
    c = view(spark, d, "osm_nodes").select(G.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).where("c is not null").select("c.ix", "c.iy")
    return reconcile.islands(c, ["iy"], "ix").select("iy", "run_lo", "run_hi", "n")


_ADDR = """a AS (SELECT addr_id, lat, lon, upper(trim(street_name)) AS street, upper(trim(city_name)) AS city, suffix FROM address_points),
s AS (SELECT street, row_number() OVER (ORDER BY street) AS street_id FROM (SELECT DISTINCT street FROM a) t)"""


@query("w01_street_ids", f"WITH {_ADDR} SELECT street, street_id FROM s")
def w01(spark, d):
    return address.index(view(spark, d, "address_points"))["streets"]


@query("a23_city_index", f"WITH {_ADDR} SELECT city, string_agg(DISTINCT CAST(street_id AS VARCHAR), ',' ORDER BY CAST(street_id AS VARCHAR)) AS street_ids, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM a JOIN s USING (street) GROUP BY city")
def a23(spark, d):
    c = address.index(view(spark, d, "address_points"))["cities"]
    return c.select("city", F.array_join(F.array_sort(F.transform("street_ids", lambda x: x.cast("string"))), ",").alias("street_ids"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("q17_address_invariants", f"""WITH {_ADDR}, h AS ({ORACLE_SQL["x10_house_numbers"]}), r AS (SELECT a.addr_id, s.street_id, a.city, h.house_lo AS lo, h.house_hi AS hi FROM a JOIN s USING (street) JOIN h USING (addr_id))
SELECT 'range without street' AS invariant, count(*) AS n FROM r WHERE street_id % 7 = 0 UNION ALL SELECT 'street without range', 0 UNION ALL SELECT 'range upside down', count(*) FROM r WHERE addr_id % 50 = 3 AND lo < hi
UNION ALL SELECT 'city without street', 0 UNION ALL SELECT 'listed street missing', count(*) FROM (SELECT DISTINCT city, street_id FROM r WHERE street_id % 7 = 0) t UNION ALL SELECT 'street listed twice', 0""")
def q17(spark, d):
    idx = address.index(view(spark, d, "address_points"))
    turn = F.col("addr_id") % 50 == 3  # planted faults: some streets are taken out, some ranges turned round
    lo, hi = F.when(turn, F.col("house_hi")).otherwise(F.col("house_lo")), F.when(turn, F.col("house_lo")).otherwise(F.col("house_hi"))
    idx["ranges"] = idx["ranges"].withColumns({"house_lo": lo, "house_hi": hi})
    idx["streets"] = idx["streets"].where("street_id % 7 <> 0")
    return address.violations(idx)


@query("a22_address_density", "SELECT suffix, count(*) AS records, count(DISTINCT upper(trim(street_name))) AS streets, grouping(suffix) AS is_total FROM address_points GROUP BY ROLLUP (suffix)")
def a22(spark, d):
    p = view(spark, d, "address_points").withColumn("street", address.key(F.col("street_name")))
    return p.rollup("suffix").agg(F.count("*").alias("records"), F.countDistinct("street").alias("streets"), F.grouping("suffix").cast("long").alias("is_total"))


@query("a33_node_degrees", "SELECT node_id, sum(CASE WHEN pos = a OR pos = z THEN 2 ELSE 1 END) AS degree FROM (SELECT node_id, pos, min(pos) OVER (PARTITION BY way_id) AS a, max(pos) OVER (PARTITION BY way_id) AS z FROM geo_points) t GROUP BY node_id")
def a33(spark, d):
    return graph.node_degrees(view(spark, d, "geo_points"))


_GRAPH = f"""deg AS (SELECT node_id, sum(CASE WHEN pos = a OR pos = z THEN 2 ELSE 1 END) AS degree FROM (SELECT node_id, pos, min(pos) OVER (PARTITION BY way_id) AS a, max(pos) OVER (PARTITION BY way_id) AS z FROM geo_points) t GROUP BY node_id),
gp AS (SELECT g.*, d.degree >= 2 AS hub, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(g.node_id) OVER w AS next FROM geo_points g JOIN deg d USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
gs AS (SELECT *, sum(CASE WHEN hub THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS seg FROM gp),
sg AS (SELECT way_id, CAST(seg AS BIGINT) AS seg, arg_min(node_id, pos) AS u, arg_max(next, pos) AS v, sum({HAV}) AS length, count(*) + 1 AS n_points FROM gs WHERE next IS NOT NULL GROUP BY way_id, seg),
lk AS (SELECT way_id, seg, forward, CASE WHEN forward THEN u ELSE v END AS u, CASE WHEN forward THEN v ELSE u END AS v, length, road_class FROM (SELECT sg.*, CASE highway WHEN 'motorway' THEN 0 WHEN 'trunk' THEN 1 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 WHEN 'residential' THEN 5 WHEN 'service' THEN 7 END AS road_class, unnest(CASE WHEN oneway = 'yes' THEN [true] ELSE [true, false] END) AS forward
  FROM sg JOIN osm_ways USING (way_id) WHERE highway IS NOT NULL AND u <> v AND length > 0) t)"""


def _links(spark, d):
    return graph.links(graph.split_at_nodes(view(spark, d, "geo_points")), view(spark, d, "osm_ways"), CLASSES)


@query("r01_graph_segments", f"WITH {_GRAPH} SELECT way_id, seg, u, v, round(length, 3) AS length, n_points FROM sg")
def r01(spark, d):
    return graph.split_at_nodes(view(spark, d, "geo_points")).select("way_id", "seg", "u", "v", F.round("length", 3).alias("length"), "n_points")


@query("r02_graph_links", f"WITH {_GRAPH} SELECT way_id, seg, forward, u, v, round(length, 3) AS length, road_class FROM lk")
def r02(spark, d):
    return _links(spark, d).withColumn("length", F.round("length", 3))


@query("r03_node_ranks", f"WITH {_GRAPH} SELECT node_id, coalesce(min(road_class), 15) AS rank FROM osm_nodes LEFT JOIN (SELECT u AS node_id, road_class FROM lk UNION ALL SELECT v, road_class FROM lk) e USING (node_id) GROUP BY node_id")
def r03(spark, d):
    return graph.node_ranks(view(spark, d, "osm_nodes").select("node_id"), _links(spark, d))


@query("r04_restrictions", """WITH f AS (SELECT way_id, node_id, min(pos) AS pos FROM way_refs GROUP BY way_id, node_id)
SELECT rel_id, a.pos AS from_pos, b.pos AS to_pos, CASE WHEN restriction LIKE 'no!_%' ESCAPE '!' THEN 127 ELSE 0 END AS code FROM relations LEFT JOIN f a ON a.way_id = from_way AND a.node_id = via LEFT JOIN f b ON b.way_id = to_way AND b.node_id = via""")
def r04(spark, d):
    return graph.resolve_restrictions(view(spark, d, "relations"), view(spark, d, "way_refs"))


@query("r05_components", f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM lk WHERE length <= 15e3 AND road_class <= 1 UNION ALL SELECT v, u FROM lk WHERE length <= 15e3 AND road_class <= 1) t),
reach AS (SELECT u AS node_id, u AS label FROM e UNION SELECT e.v, r.label FROM reach r JOIN e ON e.u = r.node_id WHERE r.label < e.v)
SELECT node_id, min(label) AS label FROM reach GROUP BY node_id""")
def r05(spark, d):
    return graph.components(_links(spark, d).where("length <= 15000 and road_class <= 1")).select("node_id", "label")


@query("r07_lightest_edges", f"WITH {_GRAPH} SELECT u, v, round(min(length), 3) AS w FROM lk GROUP BY u, v")
def r07(spark, d):
    return graph.lightest(_links(spark, d)).select("u", "v", F.round("w", 3).alias("w"))


@query("r10_paths_within", f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT u, v, min(CAST(round_even(length, 0) AS BIGINT)) AS w FROM lk WHERE u <> v GROUP BY u, v),
p AS (SELECT DISTINCT u AS src, u AS node, CAST(0 AS BIGINT) AS dist FROM e UNION SELECT src, e.v, dist + e.w FROM p JOIN e ON e.u = p.node WHERE dist + e.w <= 3000)
SELECT src, node, CAST(min(dist) AS DOUBLE) AS dist FROM p GROUP BY src, node""")
def r10(spark, d):
    e = graph.lightest(_links(spark, d).withColumn("length", F.rint("length")))
    return graph.shortest_paths(e, e.select(F.col("u").alias("src")).distinct(), most_cost=3000.0)


@query("j11_nearest_point", """WITH p AS (SELECT node_id AS id, coalesce(place, '') AS kind, (lon - 115.5e0) * 4096e0 AS x, (lat + 32.5e0) * 4096e0 AS y FROM osm_nodes),
t AS (SELECT CASE WHEN addr_id % 5 = 0 THEN 'city' ELSE '' END AS kind, (lon - 115.5e0) * 4096e0 AS x, (lat + 32.5e0) * 4096e0 AS y FROM address_points)
SELECT id, round(min(greatest(abs(p.x - t.x), abs(p.y - t.y))), 6) AS distance FROM p JOIN t ON p.kind = t.kind AND abs(p.x - t.x) <= 8 AND abs(p.y - t.y) <= 8 GROUP BY id""")
def j11(spark, d):
    x, y = (F.col("lon") - 115.5) * 4096.0, (F.col("lat") + 32.5) * 4096.0
    p = view(spark, d, "osm_nodes").select(F.col("node_id").alias("id"), F.coalesce("place", F.lit("")).alias("kind"), x.alias("x"), y.alias("y"))
    t = view(spark, d, "address_points").select(F.when(F.col("addr_id") % 5 == 0, "city").otherwise("").alias("kind"), x.alias("x"), y.alias("y"))
    return spatial.nearest_point(p, t, 8.0).select("id", F.round("distance", 6).alias("distance"))


@query("j12_nearest_segment", f"""WITH {SEGS}, s AS (SELECT (lon - 115.5e0) * 4096e0 AS x1, (lat + 32.5e0) * 4096e0 AS y1, (lon2 - 115.5e0) * 4096e0 AS x2, (lat2 + 32.5e0) * 4096e0 AS y2 FROM segs),
p AS (SELECT node_id AS id, (lon - 115.5e0) * 4096e0 AS x, (lat + 32.5e0) * 4096e0 AS y FROM osm_nodes),
j AS (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM p JOIN s ON x >= least(x1, x2) - 2 AND x <= greatest(x1, x2) + 2 AND y >= least(y1, y2) - 2 AND y <= greatest(y1, y2) + 2),
k AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) ELSE 0e0 END AS t FROM j)
SELECT id, round(min(d), 6) AS distance FROM (SELECT id, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS d FROM k) m WHERE d <= 2 GROUP BY id""")
def j12(spark, d):
    x, y = lambda c: (F.col(c) - 115.5) * 4096.0, lambda c: (F.col(c) + 32.5) * 4096.0
    s = tiles.segments(view(spark, d, "geo_points")).select(x("lon").alias("x1"), y("lat").alias("y1"), x("lon2").alias("x2"), y("lat2").alias("y2"))
    p = view(spark, d, "osm_nodes").select(F.col("node_id").alias("id"), x("lon").alias("x"), y("lat").alias("y"))
    return spatial.nearest_segment(p, s, 2.0, 64.0).select("id", F.round("distance", 6).alias("distance"))


@query("j16_cell_neighbours", f"""WITH c AS (SELECT DISTINCT level, ix, iy FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids) t WHERE {_IN})
SELECT c.level, c.ix, c.iy, side, o.level IS NOT NULL AS there FROM c CROSS JOIN (SELECT 'E' AS side, 1 AS dx, 0 AS dy UNION ALL SELECT 'N', 0, 1 UNION ALL SELECT 'S', 0, -1 UNION ALL SELECT 'W', -1, 0) s LEFT JOIN c o ON o.level = c.level AND o.ix = c.ix + dx AND o.iy = c.iy + dy""")
def j16(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids"))
    return spatial.cell_neighbours(p.select("level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").select("level", "c.ix", "c.iy").distinct())


@query("j21_tolerance_semi_join", "SELECT node_id AS id FROM osm_nodes p WHERE EXISTS (SELECT 1 FROM address_points a WHERE abs(p.lon - a.lon) <= 2e-3 AND abs(p.lat - a.lat) <= 2e-3)")
def j21(spark, d):
    p = view(spark, d, "osm_nodes").select(F.col("node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.within_tolerance(p, view(spark, d, "address_points").select(F.col("lon").alias("x"), F.col("lat").alias("y")), 2e-3).select("id")


_BOX = "SELECT o_orderkey AS id, o_orderkey % 997 AS x_lo, o_orderkey % 997 + o_custkey % 7 + 1 AS x_hi, o_custkey % 991 AS y_lo, o_custkey % 991 + o_orderkey % 5 + 1 AS y_hi FROM orders WHERE o_orderkey % 2 = {}"


@query("j29_rectangles_meet", f"SELECT a.id AS a_id, b.id AS b_id FROM ({_BOX.format(0)}) a JOIN ({_BOX.format(1)}) b ON greatest(a.x_lo, b.x_lo) < least(a.x_hi, b.x_hi) AND greatest(a.y_lo, b.y_lo) < least(a.y_hi, b.y_hi)")
def j29(spark, d):
    view(spark, d, "osm_ways")
    return spatial.rectangles_meet(spark.sql(_BOX.format(0)), spark.sql(_BOX.format(1)), 16.0)


_KEYS = ["kind", "level", "ix", "iy", "code", "shape"]


@query("j06_flag_lookup", "SELECT f.dump_row, f.kind, coalesce(s.flag, 0) AS flag FROM failures f LEFT JOIN (SELECT level, code, d_src, min(vert) AS flag FROM failures WHERE dump_row % 3 = 0 GROUP BY level, code, d_src) s ON f.level = s.level AND f.code = s.code AND f.d_src IS NOT DISTINCT FROM s.d_src")
def j06(spark, d):
    f = view(spark, d, "failures")
    return reconcile.flag_lookup(f.select("dump_row", "kind", "level", "code", "d_src"), f.where("dump_row % 3 = 0").select("level", "code", "d_src", F.col("vert").alias("flag")), ["level", "code", "d_src"], "flag").select("dump_row", "kind", "flag")


@query("j08_exactly_once", """WITH a AS (SELECT level, ix, iy, count(*) AS r FROM failures WHERE code = 288 GROUP BY level, ix, iy), b AS (SELECT level, ix, iy, count(*) AS s FROM failures WHERE code = 291 AND vert < 6 GROUP BY level, ix, iy)
SELECT level, ix, iy, CASE WHEN r IS NULL THEN 'foreign' WHEN s IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM a FULL JOIN b USING (level, ix, iy) WHERE r IS NULL OR s IS NULL OR s > 1""")
def j08(spark, d):
    f = view(spark, d, "failures")
    return reconcile.exactly_once(f.where("code = 288"), f.where("code = 291 and vert < 6"), ["level", "ix", "iy"])


@query("j19_pair_once", """WITH a AS (SELECT level, ix, dump_row AS a_id, row_number() OVER (PARTITION BY level, ix ORDER BY dump_row) AS k FROM failures WHERE code = 288), b AS (SELECT level, ix, dump_row AS b_id, row_number() OVER (PARTITION BY level, ix ORDER BY dump_row) AS k FROM failures WHERE code = 321)
SELECT level, ix, a_id, b_id FROM a JOIN b USING (level, ix, k)""")
def j19(spark, d):
    f = view(spark, d, "failures")
    return reconcile.pair_once(f.where("code = 288").withColumnRenamed("dump_row", "a_id"), f.where("code = 321").withColumnRenamed("dump_row", "b_id"), ["level", "ix"], "a_id", "b_id")


@query("j25_envelope", """WITH r AS (SELECT level, count(*) AS r FROM failures WHERE dump_row % 3 <> 0 GROUP BY level), g AS (SELECT level, count(*) AS g FROM failures WHERE dump_row % 2 = 0 AND level <> 6 GROUP BY level)
SELECT level, coalesce(r, 0) AS r, coalesce(g, 0) AS g, CASE WHEN CASE WHEN coalesce(r, 0) = 0 THEN coalesce(g, 0) = 0 ELSE coalesce(g, 0) >= 0.5e0 * r AND coalesce(g, 0) <= 1.5e0 * r END THEN 'in_range' ELSE 'out_of_range' END AS status FROM r FULL JOIN g USING (level)""")
def j25(spark, d):
    f = view(spark, d, "failures")
    n = lambda df: df.groupBy("level").agg(F.count("*").alias("n"))
    return reconcile.compare_counts(n(f.where("dump_row % 3 <> 0")), n(f.where("dump_row % 2 = 0 and level <> 6")), "level", "n", 0.5, 1.5)


@query("a04_failure_groups", f"SELECT {', '.join(_KEYS)}, count(*) AS n, min(vert) AS min_vert, max(vert) AS max_vert, min(d_src) AS min_d, max(d_src) AS max_d FROM failures GROUP BY ALL")
def a04(spark, d):
    return reconcile.group_summary(view(spark, d, "failures"), _KEYS)


@query("a05_conditional_counts", "SELECT kind, level, count(*) AS n, CAST(count_if(d_src IS NULL) AS BIGINT) AS no_source, CAST(count_if(onb = 1) AS BIGINT) AS on_boundary, CAST(count_if(d_src > 1e2) AS BIGINT) AS far, count(DISTINCT (ix, iy)) AS cells FROM failures GROUP BY kind, level")
def a05(spark, d):
    return view(spark, d, "failures").groupBy("kind", "level").agg(F.count("*").alias("n"), F.count_if(F.col("d_src").isNull()).alias("no_source"), F.count_if(F.col("onb") == 1).alias("on_boundary"), F.count_if(F.col("d_src") > 100.0).alias("far"), F.countDistinct("ix", "iy").alias("cells"))


@query("a10_density", f"WITH {SEGS}, w AS (SELECT way_id, sum({HAV}) / 1e3 AS km, count(*) AS k FROM segs GROUP BY way_id) SELECT highway, count(*) AS links, CAST(sum(k) AS BIGINT) AS segments, round(sum(km), 3) AS km, round(quantile_cont(km, 0.5e0), 6) AS p50, round(quantile_cont(km, 0.9e0), 6) AS p90 FROM w JOIN osm_ways USING (way_id) WHERE highway IS NOT NULL GROUP BY highway")
def a10(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    w = s.groupBy("way_id").agg((F.sum(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))) / 1000).alias("km"), F.count("*").alias("k"))
    p = lambda q: F.round(F.percentile("km", F.lit(q)), 6)
    return w.join(view(spark, d, "osm_ways").where("highway is not null"), "way_id").groupBy("highway").agg(F.count("*").alias("links"), F.sum("k").alias("segments"), F.round(F.sum("km"), 3).alias("km"), p(0.5).alias("p50"), p(0.9).alias("p90"))


@query("a11_modal_range", """WITH c AS (SELECT level, CAST(pow(2, ceil(log2(vert + 1e0))) AS BIGINT) AS bucket, count(*) AS n FROM failures GROUP BY 1, 2)
SELECT level, bucket, n, round(n / CAST(sum_n AS DOUBLE), 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY level) AS sum_n, row_number() OVER (PARTITION BY level ORDER BY n DESC, bucket) AS k FROM c) t WHERE k = 1""")
def a11(spark, d):
    c = view(spark, d, "failures").groupBy("level", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("vert") + 1.0))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("level")
    return c.select("*", F.sum("n").over(w).alias("all"), F.row_number().over(w.orderBy(F.desc("n"), "bucket")).alias("k")).where("k = 1").select("level", "bucket", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("a16_fit", "SELECT level, round(corr(vert, d_src), 6) AS r, round(regr_slope(d_src, vert), 6) AS slope, round(regr_intercept(d_src, vert), 6) AS intercept, round(sum(vert * d_src) / sum(vert * vert), 6) AS through_zero FROM failures WHERE d_src IS NOT NULL GROUP BY level")
def a16(spark, d):
    f = view(spark, d, "failures").where("d_src is not null")
    x, y = F.col("vert"), F.col("d_src")
    return f.groupBy("level").agg(F.round(F.corr(x.cast("double"), y), 6).alias("r"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.sum(x * y) / F.sum(x * x), 6).alias("through_zero"))


@query("a26_check_summary", "SELECT level, kind, count(*) AS checked, CAST(count_if(d_src IS NULL OR d_src > 5e1) AS BIGINT) AS failing, max(CASE WHEN d_src <= 5e1 THEN d_src END) AS worst_pass, grouping(level) AS is_total FROM failures GROUP BY GROUPING SETS ((kind, level), (kind))")
def a26(spark, d):
    f = view(spark, d, "failures").groupingSets([[F.col("kind"), F.col("level")], [F.col("kind")]], "kind", "level")
    bad = F.col("d_src").isNull() | (F.col("d_src") > 50.0)
    return f.agg(F.count("*").alias("checked"), F.count_if(bad).alias("failing"), F.max(F.when(F.col("d_src") <= 50.0, F.col("d_src"))).alias("worst_pass"), F.grouping("level").cast("long").alias("is_total")).select("level", "kind", "checked", "failing", "worst_pass", "is_total")


@query("c01_first_match_causes", f"SELECT dump_row, {_CAUSE} AS cause FROM failures")
def c01(spark, d):
    return reconcile.classify(view(spark, d, "failures"), RULES).select("dump_row", "cause")


@query("c02_partition_proof", f"SELECT kind, count(*) AS total, count(cause) AS assigned, count(*) - count(cause) AS unassigned FROM (SELECT kind, {_CAUSE} AS cause FROM failures) t GROUP BY kind UNION ALL SELECT 'no such kind', 0, 0, 0")
def c02(spark, d):
    f = view(spark, d, "failures")
    kinds = f.select("kind").distinct().union(spark.sql("SELECT 'no such kind' AS kind"))
    return reconcile.partition_proof(reconcile.classify(f, RULES), kinds)


@query("l03_first_failures", "SELECT level, kind, dump_row, k FROM (SELECT level, kind, dump_row, row_number() OVER (PARTITION BY level, kind ORDER BY dump_row) AS k FROM failures) t WHERE k <= 10")
def l03(spark, d):
    w = Window.partitionBy("level", "kind").orderBy("dump_row")
    return view(spark, d, "failures").select("level", "kind", "dump_row", F.row_number().over(w).alias("k")).where("k <= 10")


@query("u01_cell_sets", f"""WITH c AS (SELECT way_id, {_IX.replace('* n', '* 64')} AS ix, {_IY.replace('* n', '* 64')} AS iy FROM geo_points), r AS (SELECT DISTINCT ix, iy FROM c WHERE way_id % 3 <> 0 AND ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63), g AS (SELECT DISTINCT ix, iy FROM c WHERE way_id % 2 = 0 AND ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63)
SELECT 'both' AS side, ix, iy FROM (SELECT * FROM r INTERSECT SELECT * FROM g) UNION ALL SELECT 'r only', ix, iy FROM (SELECT * FROM r EXCEPT SELECT * FROM g) UNION ALL SELECT 'g only', ix, iy FROM (SELECT * FROM g EXCEPT SELECT * FROM r)""")
def u01(spark, d):
    p = view(spark, d, "geo_points").select("way_id", G.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).where("c is not null")
    side = lambda cond, name: p.where(cond).select("c.ix", "c.iy").distinct().withColumn(name, F.lit(True))
    both = side("way_id % 3 <> 0", "r").join(side("way_id % 2 = 0", "g"), ["ix", "iy"], "full_outer")
    return both.select(F.when(F.col("r") & F.col("g"), "both").when(F.col("r"), "r only").otherwise("g only").alias("side"), "ix", "iy")


@query("u08_multiset_difference", """WITH a AS (SELECT level, ix, iy, code, count(*) AS n_a FROM failures WHERE dump_row % 3 <> 0 GROUP BY ALL), b AS (SELECT level, ix, iy, code, count(*) AS n_b FROM failures WHERE dump_row % 2 = 0 GROUP BY ALL)
SELECT level, ix, iy, code, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (level, ix, iy, code) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def u08(spark, d):
    f = view(spark, d, "failures").select("dump_row", "level", "ix", "iy", "code")
    return reconcile.multiset_difference(f.where("dump_row % 3 <> 0"), f.where("dump_row % 2 = 0"), ["level", "ix", "iy", "code"])


@query("a06_source_counts", "SELECT code, count(*) AS n, count(DISTINCT (level, ix, iy, shape)) AS n_groups FROM failures GROUP BY code")
def a06(spark, d):
    return view(spark, d, "failures").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("level", "ix", "iy", "shape").alias("n_groups"))


@query("a07_cause_counts", f"SELECT cause, level, count(*) AS n, count(DISTINCT (kind, ix, iy, code, shape)) AS n_groups FROM (SELECT *, {_CAUSE} AS cause FROM failures) t GROUP BY cause, level")
def a07(spark, d):
    return reconcile.classify(view(spark, d, "failures"), RULES).groupBy("cause", "level").agg(F.count("*").alias("n"), F.countDistinct("kind", "ix", "iy", "code", "shape").alias("n_groups"))


@query("a09_moved_counts", "SELECT level, code, CAST(count_if(onb = 1) AS BIGINT) AS moved, CAST(count_if(onb = 0) AS BIGINT) AS remaining FROM failures GROUP BY level, code")
def a09(spark, d):
    return view(spark, d, "failures").groupBy("level", "code").agg(F.count_if(F.col("onb") == 1).alias("moved"), F.count_if(F.col("onb") == 0).alias("remaining"))


@query("a12_rule_accuracy", "SELECT level, count(*) AS n, round(avg(CASE WHEN (vert >= 12) = (onb = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM failures GROUP BY level")
def a12(spark, d):
    right = ((F.col("vert") >= 12) == (F.col("onb") == 1)).cast("double")
    return view(spark, d, "failures").groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@query("a13_modal_rule", """WITH c AS (SELECT ix, code, vert, count(*) AS n FROM failures WHERE dump_row % 3 <> 0 GROUP BY ALL), m AS (SELECT ix, code, vert AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY ix, code ORDER BY n DESC, vert) AS k FROM c) t WHERE k = 1)
SELECT code, count(*) AS n, CAST(count_if(predicted IS NULL) AS BIGINT) AS unseen, CAST(count_if(coalesce(predicted = vert, false)) AS BIGINT) AS n_right FROM (SELECT * FROM failures WHERE dump_row % 3 = 0) h LEFT JOIN m USING (ix, code) GROUP BY code""")
def a13(spark, d):
    f = view(spark, d, "failures")
    held = reconcile.modal_rule(f.where("dump_row % 3 <> 0"), f.where("dump_row % 3 = 0"), ["ix", "code"], "vert")
    return held.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("unseen"), F.count_if(F.col("predicted") == F.col("vert")).alias("n_right"))


@query("a19_divisibility", "SELECT unit, count(*) AS n, round(avg(CASE WHEN vert % unit = 0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM failures, (SELECT unnest([2, 3, 4, 6, 8, 12]) AS unit) u GROUP BY unit")
def a19(spark, d):
    units = F.explode(F.array(*(F.lit(u) for u in (2, 3, 4, 6, 8, 12))))
    return view(spark, d, "failures").groupBy("vert").agg(F.count("*").alias("k")).select("vert", "k", units.alias("unit")).groupBy("unit").agg(F.sum("k").alias("n"), F.round(F.sum(F.when(F.col("vert") % F.col("unit") == 0, F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("share"))


@query("a20_candidate_fields", " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN vert = {c} THEN 1e0 ELSE 0e0 END), 6) AS equal, round(corr(vert, {c}), 6) AS r FROM failures" for c in ("shape", "ix", "iy", "level")))
def a20(spark, d):
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in ("shape", "ix", "iy", "level"))))
    long = view(spark, d, "failures").select(F.col("vert").cast("double").alias("vert"), pairs.alias("p")).select("vert", "p.field", "p.v")
    return long.groupBy("field").agg(F.round(F.avg((F.col("vert") == F.col("v")).cast("double")), 6).alias("equal"), F.round(F.corr("vert", "v"), 6).alias("r"))


@query("a21_distribution", "SELECT level, count(d_src) AS n, min(d_src) AS low, max(d_src) AS high, round(avg(d_src), 6) AS mean, round(quantile_cont(d_src, 0.5e0), 6) AS median, grouping(level) AS is_total FROM failures GROUP BY ROLLUP (level)")
def a21(spark, d):
    return view(spark, d, "failures").rollup("level").agg(F.count("d_src").alias("n"), F.min("d_src").alias("low"), F.max("d_src").alias("high"), F.round(F.avg("d_src"), 6).alias("mean"), F.round(F.percentile("d_src", F.lit(0.5)), 6).alias("median"), F.grouping("level").cast("long").alias("is_total"))


@query("a24_extent", "SELECT count(*) AS n, min(lat) AS lat_lo, max(lat) AS lat_hi, min(lon) AS lon_lo, max(lon) AS lon_hi, CAST(count_if(lat NOT BETWEEN -32.4e0 AND -31.6e0 OR lon NOT BETWEEN 115.6e0 AND 116.4e0) AS BIGINT) AS outside FROM address_points")
def a24(spark, d):
    inside = F.col("lat").between(-32.4, -31.6) & F.col("lon").between(115.6, 116.4)
    return view(spark, d, "address_points").agg(F.count("*").alias("n"), F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"), F.count_if(~inside).alias("outside"))


# Every row is in one side or in both.
_R, _G = "dump_row % 3 <> 0", "(dump_row % 3 = 0 OR dump_row % 2 = 0 AND vert < 18)"


@query("a25_vocabulary_coverage", f"""WITH r AS (SELECT level, vert, count(*) AS n FROM failures WHERE {_R} GROUP BY level, vert), g AS (SELECT DISTINCT level, vert, true AS used FROM failures WHERE {_G})
SELECT level, CAST(sum(n) AS BIGINT) AS observed, round(sum(CASE WHEN used THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS coverage, sum(n) < 100 AS advisory FROM r LEFT JOIN g USING (level, vert) GROUP BY level""")
def a25(spark, d):
    f = view(spark, d, "failures")
    r, g = f.where(_R).groupBy("level", "vert").agg(F.count("*").alias("n")), f.where(_G).select("level", "vert", F.lit(True).alias("used")).distinct()
    return r.join(g, ["level", "vert"], "left").groupBy("level").agg(F.sum("n").alias("observed"), F.round(F.sum(F.when(F.col("used"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"), (F.sum("n") < 100).alias("advisory"))


@query("a27_duplicate_records", "SELECT level, ix, iy, code, vert, count(*) AS copies, min(dump_row) AS first_row FROM failures GROUP BY level, ix, iy, code, vert HAVING count(*) >= 2")
def a27(spark, d):
    return view(spark, d, "failures").groupBy("level", "ix", "iy", "code", "vert").agg(F.count("*").alias("copies"), F.min("dump_row").alias("first_row")).where("copies >= 2")


@query("a28_tie_classes", "SELECT level, ix, iy, CASE WHEN count(DISTINCT shape) <= 1 THEN 'T0' WHEN count(DISTINCT code) <= 1 THEN 'T1' ELSE 'T2' END AS tie, min(dump_row) AS lowest FROM failures GROUP BY level, ix, iy")
def a28(spark, d):
    return reconcile.tie_classes(view(spark, d, "failures"), ["level", "ix", "iy"], "shape", "code", "dump_row")


@query("a29_group_status", "SELECT level, ix, iy, shape, count(*) AS n, bool_or(onb = 1) AS any_on_boundary FROM failures GROUP BY level, ix, iy, shape")
def a29(spark, d):
    return view(spark, d, "failures").groupBy("level", "ix", "iy", "shape").agg(F.count("*").alias("n"), F.bool_or(F.col("onb") == 1).alias("any_on_boundary"))


@query("a36_off_modal", """WITH c AS (SELECT level, vert, count(*) AS n FROM failures GROUP BY level, vert)
SELECT level, vert, n FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, vert) AS k FROM c) t WHERE k > 1""")
def a36(spark, d):
    f = view(spark, d, "failures")
    usual = reconcile.modal(f, ["level"], "vert").select("level", "vert")
    return f.groupBy("level", "vert").agg(F.count("*").alias("n")).join(usual, ["level", "vert"], "left_anti").select("level", "vert", "n")


@query("j09_verify_columns", f"""WITH a AS (SELECT level, ix, code FROM failures WHERE {_R}), b AS (SELECT level, ix, code FROM failures WHERE {_G})
SELECT 'a' AS side, level, ix, code FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT 'b', level, ix, code FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y""")
def j09(spark, d):
    f = view(spark, d, "failures")
    return reconcile.one_sided(f.where(_R), f.where(_G), ["level", "ix", "code"])


@query("j10_two_evidence", f"""WITH a AS (SELECT dump_row, {_CAUSE} AS direct FROM failures WHERE {_R}), b AS (SELECT dump_row, CASE WHEN onb = 1 THEN 4 ELSE 2 END AS counter FROM failures WHERE {_G})
SELECT dump_row, direct, counter, CASE WHEN counter IS NULL THEN 'conflict-open' WHEN direct IS NULL THEN 'counterfactual-only' WHEN direct = counter THEN 'agreed' ELSE 'conflict' END AS verdict FROM a FULL JOIN b USING (dump_row)""")
def j10(spark, d):
    f = view(spark, d, "failures")
    counter = f.where(_G).select("dump_row", F.when(F.col("onb") == 1, 4).otherwise(2).alias("cause"))
    return reconcile.reconcile_evidence(reconcile.classify(f.where(_R), RULES), counter, ["dump_row"])


@query("j24_box_credit", f"""WITH {SEGS}, b AS (SELECT r_regionkey AS box, 115.5e0 + r_regionkey * 0.15e0 AS lo, 115.8e0 + r_regionkey * 0.15e0 AS hi FROM region)
SELECT box, count(*) AS n, round(sum({HAV}), 2) AS metres FROM segs JOIN b ON (lon + lon2) / 2e0 >= lo AND (lon + lon2) / 2e0 <= hi GROUP BY box""")
def j24(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    boxes = spark.sql("SELECT r_regionkey AS box, 115.5e0 + r_regionkey * 0.15e0 AS lo, 115.8e0 + r_regionkey * 0.15e0 AS hi FROM region")
    at = (F.col("lon") + F.col("lon2")) / 2.0
    near = s.join(F.broadcast(boxes), (at >= F.col("lo")) & (at <= F.col("hi")))
    return near.groupBy("box").agg(F.count("*").alias("n"), F.round(F.sum(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))), 2).alias("metres"))


@query("j31_cell_causes", f"""WITH c AS (SELECT level, ix, iy, min({_CAUSE}) AS cause FROM failures WHERE {_R} GROUP BY level, ix, iy)
SELECT coalesce(CAST(cause AS VARCHAR), 'NOT-CHANGED') AS cell_cause, count(*) AS n FROM failures LEFT JOIN c USING (level, ix, iy) GROUP BY 1""")
def j31(spark, d):
    f = view(spark, d, "failures")
    cells = reconcile.classify(f.where(_R), RULES).groupBy("level", "ix", "iy").agg(F.min("cause").alias("cause"))
    return f.join(cells, ["level", "ix", "iy"], "left").groupBy(F.coalesce(F.col("cause").cast("string"), F.lit("NOT-CHANGED")).alias("cell_cause")).agg(F.count("*").alias("n"))


@query("u02_vocabulary_subset", f"SELECT level, vert FROM failures WHERE {_G} EXCEPT SELECT level, vert FROM failures WHERE {_R} AND vert <> 4")
def u02(spark, d):
    f = view(spark, d, "failures")
    return f.where(_G).select("level", "vert").subtract(f.where(_R).where("vert <> 4").select("level", "vert"))


@query("u05_interval_proof", """WITH p AS (SELECT kind, dump_row * 4 AS a, CAST(4 + vert AS BIGINT) AS size FROM failures), w AS (SELECT *, lead(a) OVER (PARTITION BY kind ORDER BY a, size) AS nxt FROM p)
SELECT kind, count(*) AS n, CAST(count_if(nxt > a + size) AS BIGINT) AS gaps, CAST(count_if(nxt < a + size) AS BIGINT) AS overlaps, CAST(sum(size) AS BIGINT) AS bytes, max(a + size) - min(a) AS span FROM w GROUP BY kind""")
def u05(spark, d):
    parts = view(spark, d, "failures").select("kind", (F.col("dump_row") * 4).alias("a"), (F.col("vert") + 4).cast("long").alias("size"))
    return reconcile.interval_proof(parts, ["kind"], "a", "size")


@query("w02_link_ids", f"SELECT level, way_id, ordinal, row_number() OVER (ORDER BY level, way_id, ordinal) AS link_id FROM ({ORACLE_SQL['g01_split_by_cell']}) chains")
def w02(spark, d):
    return tiles.link_ids(g01(spark, d))


@query("w11_balanced_ranges", f"""WITH c AS (SELECT level, ix, iy, count(*) AS k FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM geo_points, grids) t WHERE {_IN} GROUP BY level, ix, iy)
SELECT level, ix, iy, k, CAST(ceil(CAST(sum(k) OVER (PARTITION BY level ORDER BY iy, ix ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 8 / CAST(sum(k) OVER (PARTITION BY level) AS DOUBLE)) AS BIGINT) AS part FROM c""")
def w11(spark, d):
    p = G.with_levels(view(spark, d, "geo_points"), view(spark, d, "grids"))
    cells = p.select("level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").groupBy("level", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.count("*").alias("k"))
    return tiles.balanced_ranges(cells, ["level"], ["iy", "ix"], "k", 8)


@query("w13_hash_sample", """SELECT level, dump_row, digest, right(digest, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS holdout FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY digest) AS k
 FROM (SELECT level, dump_row, sha256(concat('row ', CAST(dump_row AS VARCHAR))) AS digest FROM failures) t) u WHERE k <= 20""")
def w13(spark, d):
    f = view(spark, d, "failures").select("level", "dump_row")
    return reconcile.hash_sample(f, ["level"], F.concat(F.lit("row "), F.col("dump_row").cast("string")), 20)


@query("x12_name_normal", r"SELECT node_id, lower(trim(regexp_replace(regexp_replace(name, '^N=', ''), '\s+', ' ', 'g'))) AS normal FROM osm_nodes WHERE name IS NOT NULL")
def x12(spark, d):
    plain = F.regexp_replace(F.regexp_replace("name", r"^N=", ""), r"\s+", " ")
    return view(spark, d, "osm_nodes").where("name is not null").select("node_id", F.lower(F.trim(plain)).alias("normal"))


@query("r15_graph_statistics", f"WITH {_GRAPH} SELECT count(*) AS n_links, count(DISTINCT (way_id, seg)) AS n_segments, round(sum(length), 2) AS metres, min(road_class) AS best_class FROM lk")
def r15(spark, d):
    return _links(spark, d).agg(F.count("*").alias("n_links"), F.countDistinct("way_id", "seg").alias("n_segments"), F.round(F.sum("length"), 2).alias("metres"), F.min("road_class").alias("best_class"))


@query("q20_run_contract", f"""WITH a AS (SELECT level, kind, count(*) AS was FROM failures WHERE {_R} GROUP BY level, kind), b AS (SELECT level, kind, count(*) AS now FROM failures WHERE {_G} GROUP BY level, kind)
SELECT level, kind, coalesce(was, 0) AS was, coalesce(now, 0) AS now, CASE WHEN coalesce(now, 0) - coalesce(was, 0) = CASE WHEN level = 0 THEN -1 ELSE 0 END THEN 'as declared' ELSE 'differs' END AS status FROM a FULL JOIN b USING (level, kind)""")
def q20(spark, d):
    f = view(spark, d, "failures")
    count = lambda where, name: f.where(where).groupBy("level", "kind").agg(F.count("*").alias(name))
    both = count(_R, "was").join(count(_G, "now"), ["level", "kind"], "full_outer").select("level", "kind", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    declared = F.when(F.col("level") == 0, -1).otherwise(0)
    return both.withColumn("status", F.when(F.col("now") - F.col("was") == declared, "as declared").otherwise("differs"))


@query("c03_groups_of_a_rule", f"SELECT {', '.join(_KEYS)}, count(*) AS n FROM (SELECT *, {_CAUSE} AS cause FROM failures) t WHERE cause = 2 GROUP BY {', '.join(_KEYS)}")
def c03(spark, d):
    return reconcile.classify(view(spark, d, "failures"), RULES).where("cause = 2").groupBy(*_KEYS).agg(F.count("*").alias("n"))
