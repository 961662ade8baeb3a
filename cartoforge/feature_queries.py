"""Queries of scans, admission, projection, scalar functions and joins of map features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import grid as G
from .operators import address, features, graph, reconcile, spatial, tiles
from .queries import _ADDR, _IN, _IX, _IY, HAV, ROADS, SEGS, _in, query
from .sources.adapters import view

_WAY_BOX = "SELECT way_id, min(lon) AS x_lo, max(lon) AS x_hi, min(lat) AS y_lo, max(lat) AS y_hi FROM geo_points GROUP BY way_id"
_AT64 = (_IX.replace("* n", "* 64"), _IY.replace("* n", "* 64"))


def _boxes(spark, d):
    return features.bounds(view(spark, d, "geo_points"), ["way_id"])


@query("s03_ways_in_region", f"SELECT way_id FROM ({_WAY_BOX}) b JOIN osm_ways USING (way_id) WHERE highway IS NOT NULL AND x_hi >= 115.9e0 AND x_lo <= 116e0 AND y_hi >= -32.1e0 AND y_lo <= -32e0")
def s03(spark, d):
    roads = view(spark, d, "osm_ways").where("highway is not null").select("way_id")
    return _boxes(spark, d).where("x_hi >= 115.9e0 and x_lo <= 116e0 and y_hi >= -32.1e0 and y_lo <= -32e0").join(roads, "way_id", "left_semi").select("way_id")


@query("s04_restriction_members", "SELECT rel_id, from_way, via, to_way FROM relations")
def s04(spark, d):
    r = view(spark, d, "relations")
    members = r.select("rel_id", F.inline(F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("ref")) for role, c in (("from", "from_way"), ("via", "via"), ("to", "to_way"))))))
    return features.restriction_members(members).select("rel_id", F.col("from").alias("from_way"), "via", F.col("to").alias("to_way"))


_PLACES = "SELECT n_nationkey AS id, 115.5e0 + n_nationkey % 5 * 2e-1 AS x_lo, 115.55e0 + n_nationkey % 5 * 2e-1 AS x_hi, -32.5e0 + n_regionkey * 2e-1 AS y_lo, -32.45e0 + n_regionkey * 2e-1 AS y_hi FROM nation"


@query("s14_ways_in_boxes", f"SELECT way_id, p.id AS box FROM ({_WAY_BOX}) b JOIN osm_ways USING (way_id) JOIN ({_PLACES}) p ON greatest(b.x_lo, p.x_lo) < least(b.x_hi, p.x_hi) AND greatest(b.y_lo, p.y_lo) < least(b.y_hi, p.y_hi) WHERE highway IN ('motorway', 'trunk')")
def s14(spark, d):
    roads = view(spark, d, "osm_ways").where("highway in ('motorway', 'trunk')").select("way_id")
    ways = _boxes(spark, d).join(roads, "way_id", "left_semi").withColumnRenamed("way_id", "id")
    return spatial.rectangles_meet(ways, spark.sql(_PLACES), 0.25).select(F.col("a_id").alias("way_id"), F.col("b_id").alias("box"))


@query("s15_three_hops", """WITH n AS (SELECT node_id FROM osm_nodes WHERE lat BETWEEN -32.2e0 AND -32e0 AND lon BETWEEN 115.8e0 AND 116e0), w AS (SELECT DISTINCT way_id FROM way_refs WHERE node_id IN (SELECT node_id FROM n)),
r AS (SELECT rel_id FROM relations WHERE from_way IN (SELECT way_id FROM w) OR to_way IN (SELECT way_id FROM w) OR via IN (SELECT node_id FROM n))
SELECT 'node' AS type, node_id AS id FROM n UNION ALL SELECT 'way', way_id FROM w UNION ALL SELECT 'relation', rel_id FROM r""")
def s15(spark, d):
    r = view(spark, d, "relations")
    members = r.select("rel_id", F.inline(F.array(*(F.struct(F.lit(kind).alias("type"), F.col(c).alias("ref")) for kind, c in (("way", "from_way"), ("node", "via"), ("way", "to_way"))))))
    box = view(spark, d, "osm_nodes").where("lat between -32.2e0 and -32e0 and lon between 115.8e0 and 116e0").select("node_id")
    return features.three_hops(box, view(spark, d, "way_refs").select("way_id", "node_id"), members)


@query("p03_way_name_gate", f"SELECT level, way_id FROM osm_ways, grids WHERE name IS NOT NULL AND highway IS NOT NULL AND (level > 6 OR {_in('highway', {k: v[:3] for k, v in ROADS.items() if k <= 6})})")
def p03(spark, d):
    w = G.with_levels(view(spark, d, "osm_ways").where("name is not null and highway is not null"), view(spark, d, "grids"))
    return w.where(features.name_gate(F.col("level"), F.col("highway"), {k: v[:3] for k, v in ROADS.items() if k <= 6})).select("level", "way_id")


@query("p05_long_enough", f"WITH {SEGS}, w AS (SELECT way_id, sum({HAV}) AS metres FROM segs GROUP BY way_id) SELECT level, way_id FROM w, grids WHERE metres >= level * 2e4")
def p05(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    w = s.groupBy("way_id").agg(F.sum(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("metres"))
    return G.with_levels(w, view(spark, d, "grids")).where(F.col("metres") >= F.col("level") * 2e4).select("level", "way_id")


@query("p08_periodic_box_filter", f"""SELECT way_id FROM (SELECT way_id, x_lo + 36e1 * (way_id % 3 - 1) AS x_lo, x_hi + 36e1 * (way_id % 3 - 1) AS x_hi, y_lo, y_hi FROM ({_WAY_BOX}) b) t
 WHERE y_hi >= -32.1e0 AND y_lo <= -32e0 AND ceil((115.9e0 - x_hi - 1e-9) / 36e1) <= floor((116e0 - x_lo + 1e-9) / 36e1)""")
def p08(spark, d):
    turn = (F.col("way_id") % 3 - 1) * 360.0
    b = _boxes(spark, d).withColumn("x_lo", F.col("x_lo") + turn).withColumn("x_hi", F.col("x_hi") + turn)
    return b.where(features.meets_box(F.col("x_lo"), F.col("x_hi"), F.col("y_lo"), F.col("y_hi"), 115.9, 116.0, -32.1, -32.0)).select("way_id")


_RANGE = ", ".join(f"CAST(floor(({a} - {o}e0) / 1e0 * n) AS BIGINT) AS {b}" for a, o, b in (("x_lo", "115.5", "ix_lo"), ("x_hi", "115.5", "ix_hi"), ("y_lo", "-32.5", "iy_lo"), ("y_hi", "-32.5", "iy_hi")))


@query("p09_target_cells", f"SELECT level, way_id, {_RANGE} FROM ({_WAY_BOX}) b, grids")
def p09(spark, d):
    b = G.with_levels(_boxes(spark, d), view(spark, d, "grids"))
    at = lambda c, o: F.floor((F.col(c) - o) / 1.0 * F.col("n")).cast("long")
    return b.select("level", "way_id", at("x_lo", 115.5).alias("ix_lo"), at("x_hi", 115.5).alias("ix_hi"), at("y_lo", -32.5).alias("iy_lo"), at("y_hi", -32.5).alias("iy_hi"))


@query("p10_window_meet", f"""SELECT level, way_id, ix_lo, ix_hi, iy_lo, iy_hi FROM (SELECT level, way_id, greatest(ix_lo, n // 4) AS ix_lo, least(ix_hi, n // 2) AS ix_hi, greatest(iy_lo, n // 4) AS iy_lo, least(iy_hi, n // 2) AS iy_hi
 FROM (SELECT level, n, way_id, {_RANGE} FROM ({_WAY_BOX}) b, grids) t) u WHERE ix_lo <= ix_hi AND iy_lo <= iy_hi""")
def p10(spark, d):
    cells = p09(spark, d).join(F.broadcast(view(spark, d, "grids")), "level")
    lo, hi = F.expr("n div 4"), F.expr("n div 2")
    met = cells.select("level", "way_id", *(F.greatest(c, lo).alias(c) if c.endswith("lo") else F.least(c, hi).alias(c) for c in ("ix_lo", "ix_hi", "iy_lo", "iy_hi")))
    return met.where("ix_lo <= ix_hi and iy_lo <= iy_hi")


@query("p11_road_links", """SELECT way_id, road_class, count(*) AS n_points, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM (SELECT g.way_id, CASE highway WHEN 'motorway' THEN 0 WHEN 'trunk' THEN 1 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 END AS road_class,
 greatest(0, least(262144, CAST(round_even((lon - 115.5e0) * 262144e0, 0) AS BIGINT))) AS x, greatest(0, least(262144, CAST(round_even((lat + 32.5e0) * 262144e0, 0) AS BIGINT))) AS y FROM geo_points g JOIN osm_ways w ON g.way_id = w.way_id) t WHERE road_class IS NOT NULL GROUP BY way_id, road_class""")
def p11(spark, d):
    links = features.road_links(view(spark, d, "geo_points"), view(spark, d, "osm_ways"), {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3}, 262144)
    total = lambda c: F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p[c]).alias(f"{c}_sum")
    return links.select("way_id", "road_class", F.size("points").cast("long").alias("n_points"), total("x"), total("y"))


@query("p12_shape_class", "SELECT way_id, CASE WHEN count(*) >= 3 THEN 2 ELSE 1 END AS shape_class FROM geo_points WHERE way_id IN (SELECT way_id FROM osm_ways WHERE highway IS NULL) GROUP BY way_id")
def p12(spark, d):
    shapes = view(spark, d, "osm_ways").where("highway is null").select("way_id")
    return view(spark, d, "geo_points").join(shapes, "way_id", "left_semi").groupBy("way_id").agg(F.when(F.count("*") >= 3, 2).otherwise(1).alias("shape_class"))


_NAME_TYPE = "CASE WHEN place = 'city' THEN 1 WHEN place = 'town' AND level <= 8 THEN 2 WHEN place = 'suburb' AND level <= 4 THEN 3 END"


@query("p13_name_records", f"SELECT level, node_id, {_NAME_TYPE} AS string_type, CASE WHEN level >= 6 THEN 1 ELSE 2 END AS priority FROM osm_nodes, grids WHERE name IS NOT NULL AND {_NAME_TYPE} IS NOT NULL")
def p13(spark, d):
    n = G.with_levels(view(spark, d, "osm_nodes").where("name is not null"), view(spark, d, "grids"))
    kind = features.decide(F.col("place"), F.col("level"), [("city", 12, 1), ("town", 8, 2), ("suburb", 4, 3)])
    return n.select("level", "node_id", kind.alias("string_type"), F.when(F.col("level") >= 6, 1).otherwise(2).alias("priority")).where("string_type is not null")


@query("p14_anchor_rejects", f"SELECT level, ix, iy, count(*) AS n, CAST(count_if(x > 4000 OR y > 4000) AS BIGINT) AS rejected FROM (SELECT level, ix, iy, ((lon - 115.5e0) / 1e0 * n - ix) * 4096 AS x, ((lat + 32.5e0) / 1e0 * n - iy) * 4096 AS y FROM (SELECT *, {_IX} AS ix, {_IY} AS iy FROM osm_nodes, grids WHERE name IS NOT NULL) t WHERE {_IN}) u GROUP BY level, ix, iy")
def p14(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes").where("name is not null"), view(spark, d, "grids")).withColumn("c", G.cell(F.col("lat"), F.col("lon"), F.col("n"))).where("c is not null")
    x, y = ((F.col("lon") - 115.5) / 1.0 * F.col("n") - F.col("c.ix")) * 4096, ((F.col("lat") + 32.5) / 1.0 * F.col("n") - F.col("c.iy")) * 4096
    return p.groupBy("level", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.count("*").alias("n"), F.count_if((x > 4000) | (y > 4000)).alias("rejected"))


@query("p15_outside_shells", f"SELECT ix, iy, n_names FROM (SELECT {_AT64[0]} AS ix, {_AT64[1]} AS iy, count(name) AS n_names FROM osm_nodes GROUP BY 1, 2) t WHERE (ix BETWEEN 16 AND 47 AND iy BETWEEN 16 AND 47) OR n_names > 0")
def p15(spark, d):
    c = view(spark, d, "osm_nodes").select("name", G.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).groupBy(F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.count("name").alias("n_names"))
    return c.where((F.col("ix").between(16, 47) & F.col("iy").between(16, 47)) | (F.col("n_names") > 0))


@query("p17_in_box", "SELECT addr_id FROM address_points WHERE lat BETWEEN -32.25e0 AND -32e0 AND lon BETWEEN 115.75e0 AND 116.25e0")
def p17(spark, d):
    return view(spark, d, "address_points").where("lat between -32.25e0 and -32e0 and lon between 115.75e0 and 116.25e0").select("addr_id")


@query("p18_cell_class", f"""WITH u AS (SELECT CAST(floor((lon - 115.5e0) * 8) AS BIGINT) AS tx, CAST(floor((lat + 32.5e0) * 8) AS BIGINT) AS ty, CAST(count_if(place = 'city') AS BIGINT) AS cities FROM osm_nodes WHERE place IN ('city', 'town') GROUP BY 1, 2),
c AS (SELECT DISTINCT {_AT64[0]} AS ix, {_AT64[1]} AS iy FROM geo_points) SELECT ix, iy, CASE WHEN cities >= 3 THEN 'divided' WHEN cities >= 1 THEN 'urban' WHEN cities = 0 THEN 'full' ELSE 'sparse' END AS class
FROM c LEFT JOIN u ON tx = CAST(floor(ix / 8e0) AS BIGINT) AND ty = CAST(floor(iy / 8e0) AS BIGINT) WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63""")
def p18(spark, d):
    tile = lambda c, o: F.floor((F.col(c) - o) * 8).cast("long")
    urban = view(spark, d, "osm_nodes").where("place in ('city', 'town')").groupBy(tile("lon", 115.5).alias("tx"), tile("lat", -32.5).alias("ty")).agg(F.count_if(F.col("place") == "city").alias("cities"))
    cells = view(spark, d, "geo_points").select(G.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).where("c is not null").select("c.ix", "c.iy").distinct()
    return features.cell_class(cells, urban, 8)


@query("x03_longitude_wrap", "SELECT addr_id, round(CASE WHEN e >= 0 AND e <= 1 THEN e ELSE e - 36e1 * floor(e / 36e1) END, 6) AS delta FROM (SELECT addr_id, lon + 36e1 * (addr_id % 3 - 1) - 115.5e0 AS e FROM address_points) t")
def x03(spark, d):
    return view(spark, d, "address_points").select("addr_id", F.round(G.lon_delta(F.col("lon") + (F.col("addr_id") % 3 - 1) * 360.0, 115.5, 1.0), 6).alias("delta"))


_RAD = "(pi() / 180)"


@query("x06_bearing", f"""WITH {SEGS} SELECT way_id, pos, CAST(floor(fmod(atan2(sin((lon2 - lon) * {_RAD}) * cos(lat2 * {_RAD}), cos(lat * {_RAD}) * sin(lat2 * {_RAD}) - sin(lat * {_RAD}) * cos(lat2 * {_RAD}) * cos((lon2 - lon) * {_RAD})) / {_RAD} + 36e1, 36e1)) AS BIGINT) AS bearing FROM segs WHERE lat <> lat2 OR lon <> lon2""")
def x06(spark, d):
    s = tiles.segments(view(spark, d, "geo_points")).where("lat <> lat2 or lon <> lon2")
    return s.select("way_id", "pos", G.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("bearing"))


@query("x08_centroid", "SELECT way_id, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM geo_points GROUP BY way_id")
def x08(spark, d):
    return view(spark, d, "geo_points").groupBy("way_id").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query("x09_closed_rings", "SELECT way_id, count(*) + 1 AS n_vertices, min(lat) AS y_lo, max(lat) AS y_hi, min(lon) AS x_lo, max(lon) AS x_hi FROM geo_points WHERE way_id IN (SELECT way_id FROM osm_ways WHERE highway IS NULL) GROUP BY way_id HAVING count(*) >= 3")
def x09(spark, d):
    shapes = view(spark, d, "osm_ways").where("highway is null").select("way_id")
    r = features.rings(view(spark, d, "geo_points").join(shapes, "way_id", "left_semi"))
    end = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return r.select("way_id", F.size("ring").cast("long").alias("n_vertices"), end(F.array_min, "lat").alias("y_lo"), end(F.array_max, "lat").alias("y_hi"), end(F.array_min, "lon").alias("x_lo"), end(F.array_max, "lon").alias("x_hi"))


@query("x17_key_pack", "SELECT dump_row, ((CAST(level AS BIGINT) * 16 + ix) * 16 + iy) * 1024 + code AS packed FROM failures")
def x17(spark, d):
    return view(spark, d, "failures").select("dump_row", features.packed([("level", 14), ("ix", 16), ("iy", 16), ("code", 1024)]).alias("packed"))


@query("x20_densified", f"""WITH {SEGS}, k AS (SELECT *, greatest(1, CAST(ceil(greatest(abs(lat2 - lat), abs(lon2 - lon)) / 5e-2) AS BIGINT)) AS k FROM segs), i AS (SELECT *, unnest(range(k)) AS step FROM k)
SELECT way_id, pos, step, round(lat + (lat2 - lat) * (step / CAST(k AS DOUBLE)), 6) AS lat, round(lon + (lon2 - lon) * (step / CAST(k AS DOUBLE)), 6) AS lon FROM i""")
def x20(spark, d):
    return features.densified(tiles.segments(view(spark, d, "geo_points")), 0.05).select("way_id", "pos", "step", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("g10_occupied_share", f"""WITH {SEGS}, k AS (SELECT *, greatest(1, CAST(ceil(greatest(abs(lat2 - lat), abs(lon2 - lon)) / 5e-2) AS BIGINT)) AS k FROM segs), i AS (SELECT *, unnest(range(k)) AS step FROM k),
p AS (SELECT DISTINCT way_id, floor((lat + (lat2 - lat) * (step / CAST(k AS DOUBLE)) + 32.5e0) * 8) AS i, floor((lon + (lon2 - lon) * (step / CAST(k AS DOUBLE)) - 115.5e0) * 8) AS j FROM i)
SELECT way_id, round(count(*) / 64e0, 6) AS share FROM p GROUP BY way_id""")
def g10(spark, d):
    p = features.densified(tiles.segments(view(spark, d, "geo_points")), 0.05)
    seen = p.select("way_id", F.floor((F.col("lat") + 32.5) * 8).alias("i"), F.floor((F.col("lon") - 115.5) * 8).alias("j")).distinct()
    return seen.groupBy("way_id").agg(F.round(F.count("*") / 64.0, 6).alias("share"))


@query("x22_tag_mask", "SELECT way_id, " + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {1 << i} END" for i, c in enumerate(("highway", "nat", "landuse", "oneway", "junction", "name"))) + " AS mask FROM osm_ways")
def x22(spark, d):
    return view(spark, d, "osm_ways").select("way_id", features.presence_mask(["highway", "nat", "landuse", "oneway", "junction", "name"]).alias("mask"))


@query("x25_state_suffix", "SELECT suffix, min(r_name) AS state, count(*) AS n FROM (SELECT CASE WHEN addr_id % 7 = 0 THEN 201 ELSE suffix END AS suffix FROM address_points) a JOIN region ON r_regionkey + 201 = suffix GROUP BY suffix")
def x25(spark, d):
    a = view(spark, d, "address_points")
    states = spark.sql("SELECT r_regionkey + 201 AS suffix, r_name AS state FROM region")
    code = F.when(F.col("addr_id") % 7 == 0, None).when(F.col("addr_id") % 2 == 0, F.col("suffix").cast("string")).otherwise(F.lower("state"))
    a = a.join(states, "suffix").select(code.alias("code"))  # every second one has its state's name for a code
    return address.state_suffix(a, "code", states, 201).groupBy("suffix", "state").agg(F.count("*").alias("n"))


@query("j02_restriction_status", """WITH f AS (SELECT DISTINCT way_id, node_id FROM way_refs)
SELECT restriction, count(*) AS n, CAST(count_if(a.way_id IS NOT NULL AND b.way_id IS NOT NULL) AS BIGINT) AS resolved FROM relations LEFT JOIN f a ON a.way_id = from_way AND a.node_id = via LEFT JOIN f b ON b.way_id = to_way AND b.node_id = via GROUP BY restriction""")
def j02(spark, d):
    r = view(spark, d, "relations")
    done = graph.resolve_restrictions(r, view(spark, d, "way_refs")).join(r.select("rel_id", "restriction"), "rel_id")
    return done.groupBy("restriction").agg(F.count("*").alias("n"), F.count_if(F.col("from_pos").isNotNull() & F.col("to_pos").isNotNull()).alias("resolved"))


@query("j03_street_ranges", f"WITH {_ADDR} SELECT street, count(DISTINCT city) AS n_cities, count(DISTINCT suffix) > 1 AS many_states FROM a GROUP BY street")
def j03(spark, d):
    idx = address.index(view(spark, d, "address_points"))
    cities = view(spark, d, "address_points").select(address.key(F.col("city_name")).alias("city"), "suffix").distinct()
    at = idx["ranges"].join(idx["streets"], "street_id").select("street", "city").distinct().join(cities, "city")
    return at.groupBy("street").agg(F.countDistinct("city").alias("n_cities"), (F.countDistinct("suffix") > 1).alias("many_states"))


@query("j22_coarse_with_road", """WITH a AS (SELECT DISTINCT CAST(floor((lon - 115.5e0) * 16) AS BIGINT) AS ix, CAST(floor((lat + 32.5e0) * 16) AS BIGINT) AS iy FROM address_points), m AS (SELECT avg(lat) AS lat, avg(lon) AS lon FROM geo_points JOIN osm_ways USING (way_id) WHERE highway = 'motorway' GROUP BY way_id)
SELECT ix, iy FROM a WHERE EXISTS (SELECT 1 FROM m WHERE CAST(floor((lon - 115.5e0) * 16) AS BIGINT) = ix AND CAST(floor((lat + 32.5e0) * 16) AS BIGINT) = iy)""")
def j22(spark, d):
    at = lambda: G.cell(F.col("lat"), F.col("lon"), F.lit(16))
    roads = view(spark, d, "osm_ways").where("highway = 'motorway'").select("way_id")
    centres = view(spark, d, "geo_points").join(roads, "way_id", "left_semi").groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select(at().alias("c"))
    return view(spark, d, "address_points").select(at().alias("c")).distinct().join(centres, "c", "left_semi").select("c.ix", "c.iy")


@query("j23_spot_check", f"""WITH c AS (SELECT node_id, name, {_IX.replace('* n', '* 8')} AS ix, {_IY.replace('* n', '* 8')} AS iy FROM osm_nodes WHERE name IS NOT NULL),
e AS (SELECT node_id, ix, iy, name AS want FROM c UNION ALL SELECT node_id, ix, iy, 'Nowhere' FROM c WHERE node_id % 2 = 0)
SELECT node_id, count(*) = count(CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.ix = e.ix AND c.iy = e.iy AND c.name = e.want) THEN 1 END) AS passed FROM e GROUP BY node_id""")
def j23(spark, d):
    c = view(spark, d, "osm_nodes").where("name is not null").select("node_id", "name", G.cell(F.col("lat"), F.col("lon"), F.lit(8)).alias("c"))
    wanted = c.select("node_id", "c", F.explode(F.when(F.col("node_id") % 2 == 0, F.array("name", F.lit("Nowhere"))).otherwise(F.array("name"))).alias("name"))
    return features.spot_check(wanted, c.select("c", "name"), "node_id").select("node_id", "passed")


@query("j27_own_vertices", "SELECT way_id, node_id FROM way_refs r WHERE NOT EXISTS (SELECT 1 FROM way_refs o WHERE o.node_id = r.node_id AND o.way_id <> r.way_id AND o.pos = 0)")
def j27(spark, d):
    refs = view(spark, d, "way_refs")
    return features.exclusive(refs.select("way_id", "node_id"), refs.where("pos = 0").select("way_id", "node_id"), "way_id", "node_id")


@query("l05_name_search", "SELECT node_id, name FROM osm_nodes WHERE contains(name, 'a') ORDER BY node_id LIMIT 20")
def l05(spark, d):
    return view(spark, d, "osm_nodes").where(F.col("name").contains("a")).select("node_id", "name").orderBy("node_id").limit(20)


@query("w05_best_first", f"WITH {SEGS}, w AS (SELECT way_id, CAST(round(sum({HAV})) AS BIGINT) AS metres FROM segs GROUP BY way_id) SELECT highway, way_id, row_number() OVER (PARTITION BY highway ORDER BY metres DESC, way_id) AS k FROM w JOIN osm_ways USING (way_id) WHERE highway IS NOT NULL")
def w05(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    w = s.groupBy("way_id").agg(F.round(F.sum(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))).cast("long").alias("metres"))
    named = w.join(view(spark, d, "osm_ways").where("highway is not null").select("way_id", "highway"), "way_id")
    return features.ranked(named, ["highway"], [F.desc("metres"), F.asc("way_id")]).select("highway", "way_id", "k")


@query("w12_rank_levels", """WITH g AS (SELECT node_id, count(*) AS degree FROM way_refs GROUP BY node_id), r AS (SELECT node_id, row_number() OVER (ORDER BY degree, node_id) AS rank, count(*) OVER () AS total FROM g)
SELECT node_id, rank, CASE WHEN rank <= round_even(0.55e0 * total, 0) THEN 2 WHEN rank <= round_even(0.8e0 * total, 0) THEN 4 WHEN rank <= round_even(0.93e0 * total, 0) THEN 6 ELSE 8 END AS level FROM r""")
def w12(spark, d):
    degree = view(spark, d, "way_refs").groupBy("node_id").agg(F.count("*").alias("degree")).select(F.struct("degree", "node_id").alias("key"))
    ranks = address.dense_ids(degree, "key", "rank").select("key.node_id", "rank")
    return features.rank_levels(ranks, "rank", [(0.55, 2), (0.8, 4), (0.93, 6)], 8)


@query("a02_admission_counts", f"""SELECT level, CAST(count_if(highway IS NOT NULL AND {_in('highway', ROADS)}) AS BIGINT) AS roads, count(*) AS ways FROM osm_ways, grids GROUP BY level""")
def a02(spark, d):
    w = G.with_levels(view(spark, d, "osm_ways").groupBy("highway").agg(F.count("*").alias("k")), view(spark, d, "grids"))
    shown = F.col("highway").isNotNull() & features.name_gate(F.col("level"), F.col("highway"), ROADS)
    return w.groupBy("level").agg(F.sum(F.when(shown, F.col("k")).otherwise(0)).alias("roads"), F.sum("k").alias("ways"))


@query("a17_size_histogram", f"SELECT level, CASE WHEN k < 10 THEN '0-10' WHEN k < 100 THEN '10-100' WHEN k < 1000 THEN '100-1000' ELSE '1000+' END AS bucket, count(*) AS n_cells FROM (SELECT level, ix, iy, count(*) AS k FROM (SELECT level, n, {_IX} AS ix, {_IY} AS iy FROM geo_points, grids) t WHERE {_IN} GROUP BY level, ix, iy) u GROUP BY 1, 2")
def a17(spark, d):
    p = G.with_levels(view(spark, d, "geo_points"), view(spark, d, "grids")).select("level", G.cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null")
    cells = p.groupBy("level", "c").agg(F.count("*").alias("k"))
    return cells.groupBy("level", G.histogram_bucket(F.col("k"), [0, 10, 100, 1000]).alias("bucket")).agg(F.count("*").alias("n_cells"))


@query("a18_region_roads", f"""WITH {SEGS}, m AS (SELECT way_id, {_IX.replace('* n', '* 4').replace('lon', '((lon + lon2) / 2e0)')} AS ix, {_IY.replace('* n', '* 4').replace('lat', '((lat + lat2) / 2e0)')} AS iy, {HAV} / 1e3 AS km FROM segs)
SELECT ix, iy, round(sum(km), 2) AS km, round(sum(CASE WHEN highway IN ('motorway', 'trunk') THEN km ELSE 0 END), 2) AS major_km FROM m JOIN osm_ways USING (way_id) WHERE highway IS NOT NULL AND ix BETWEEN 0 AND 3 AND iy BETWEEN 0 AND 3 GROUP BY ix, iy""")
def a18(spark, d):
    s = tiles.segments(view(spark, d, "geo_points"))
    at = G.cell((F.col("lat") + F.col("lat2")) / 2.0, (F.col("lon") + F.col("lon2")) / 2.0, F.lit(4))
    m = s.select("way_id", at.alias("c"), (G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 1000).alias("km")).where("c is not null")
    m = m.join(view(spark, d, "osm_ways").where("highway is not null").select("way_id", "highway"), "way_id")
    major = F.when(F.col("highway").isin("motorway", "trunk"), F.col("km")).otherwise(0.0)
    return m.groupBy(F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.round(F.sum("km"), 2).alias("km"), F.round(F.sum(major), 2).alias("major_km"))


@query("w10_tile_order", f"""WITH c AS (SELECT DISTINCT {_AT64[0]} AS ix, {_AT64[1]} AS iy FROM osm_nodes), o AS (SELECT *, row_number() OVER (PARTITION BY iy // 8 ORDER BY iy, ix) AS plain, row_number() OVER (PARTITION BY iy // 8 ORDER BY iy // 2, ix // 2, iy, ix) AS tiled FROM c)
SELECT iy // 8 AS band, count(*) AS n, CAST(count_if(plain <> tiled) AS BIGINT) AS moved, min(CASE WHEN plain <> tiled THEN plain END) AS first_moved FROM o GROUP BY 1""")
def w10(spark, d):
    c = view(spark, d, "osm_nodes").select(G.cell(F.col("lat"), F.col("lon"), F.lit(64)).alias("c")).distinct().select("c.ix", "c.iy", F.expr("c.iy div 8").alias("band"))
    return reconcile.order_divergence(c, ["band"], ["iy", "ix"], [F.expr("iy div 2"), F.expr("ix div 2"), "iy", "ix"])
