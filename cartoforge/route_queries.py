"""Queries on contraction, regions, rings of relations, and further comparisons of two products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import grid as G
from .functions import rings as R
from .functions import rules as P
from .operators import address, contraction, features, graph, reconcile, spatial, tiles
from .queries import _CAUSE, _G, _GRAPH, _R, _RINGS, RULES, _links, _rings, query
from .ring_queries import _AREA, _BEFORE, _CLIPPED, _LATTICE, _clipped, lattice_rings
from .sources.adapters import tasks, view

_E0 = f"{_GRAPH}, e0 AS (SELECT u, v, min(CAST(round_even(length, 0) AS BIGINT)) AS w FROM lk WHERE u <> v GROUP BY u, v)"


def _round_sql(k: int) -> str:
    e, c, s = f"e{k - 1}", f"c{k}", f"s{k}"
    return f"""d{k} AS (SELECT node, sum(i) * sum(o) AS p FROM (SELECT u AS node, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT v, 1, 0 FROM {e}) t GROUP BY node),
n{k} AS (SELECT u AS a, v AS b FROM {e} UNION SELECT v, u FROM {e}),
{c} AS (SELECT x.node FROM d{k} x WHERE NOT EXISTS (SELECT 1 FROM n{k} n JOIN d{k} y ON y.node = n.b WHERE n.a = x.node AND (y.p < x.p OR y.p = x.p AND y.node < x.node))),
t{k} AS (SELECT u, v, w FROM {e} WHERE u NOT IN (SELECT node FROM {c}) AND v NOT IN (SELECT node FROM {c})),
{s} AS (SELECT i.u, o.v, min(i.w + o.w) AS w FROM {e} i JOIN {c} ON i.v = {c}.node JOIN {e} o ON o.u = {c}.node WHERE i.u <> o.v GROUP BY i.u, o.v),
h{k} AS (SELECT DISTINCT {s}.u, {s}.v FROM {s} JOIN t{k} a ON a.u = {s}.u JOIN t{k} b ON b.u = a.v AND b.v = {s}.v WHERE a.w + b.w <= {s}.w),
e{k} AS (SELECT u, v, min(w) AS w FROM (SELECT * FROM t{k} UNION ALL SELECT u, v, w FROM {s} WHERE NOT EXISTS (SELECT 1 FROM t{k} a WHERE a.u = {s}.u AND a.v = {s}.v AND a.w <= {s}.w) AND NOT EXISTS (SELECT 1 FROM h{k} h WHERE h.u = {s}.u AND h.v = {s}.v)) x GROUP BY u, v)"""


_ROUNDS = f"{_E0}, {_round_sql(1)}, {_round_sql(2)}"


def _edges(spark, d) -> DataFrame:
    return _links(spark, d).where("u <> v").groupBy("u", "v").agg(F.min(F.rint("length").cast("long")).alias("w"))


@query("r08_contraction_ranks", f"WITH {_ROUNDS} SELECT node, 1 AS round FROM c1 UNION ALL SELECT node, 2 FROM c2")
def r08(spark, d):
    return contraction.contract(_edges(spark, d), 2, last=False)[0]


@query("r09_graph_snapshots", f"WITH {_ROUNDS} SELECT 0 AS round, u, v, w FROM e0 UNION ALL SELECT 1, u, v, w FROM e1 UNION ALL SELECT 2, u, v, w FROM e2")
def r09(spark, d):
    return contraction.contract(_edges(spark, d), 2)[1]


@query("r11_distances_kept", f"""WITH RECURSIVE {_ROUNDS}, alive AS (SELECT u AS node FROM e2 UNION SELECT v FROM e2), p AS (SELECT node AS src, node, CAST(0 AS BIGINT) AS dist FROM alive UNION SELECT src, e.v, dist + e.w FROM p JOIN e0 e ON e.u = p.node WHERE dist + e.w <= 6000)
SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS broken FROM (SELECT DISTINCT src, node FROM p WHERE node IN (SELECT node FROM alive)) t""")
def r11(spark, d):
    _, shots = contraction.contract(_edges(spark, d), 2)
    before, after = (shots.where(f"round = {k}").select("u", "v", "w") for k in (0, 2))
    return contraction.preserved(before, after, None, 6000.0)


_LEVELLED = """g AS (SELECT node_id, count(*) AS degree FROM way_refs GROUP BY node_id), r AS (SELECT node_id, row_number() OVER (ORDER BY degree, node_id) AS rank, count(*) OVER () AS total FROM g),
lv AS (SELECT r.node_id, n.lat, n.lon, CASE WHEN rank <= round_even(0.55e0 * total, 0) THEN 2 WHEN rank <= round_even(0.8e0 * total, 0) THEN 4 WHEN rank <= round_even(0.93e0 * total, 0) THEN 6 ELSE 8 END AS node_level FROM r JOIN osm_nodes n ON r.node_id = n.node_id),
sd AS (SELECT * FROM (VALUES (2, 8), (4, 4), (6, 2), (8, 1)) t(level, n)),
cx AS (SELECT level, n, node_id, node_level, lat, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS rx FROM lv, sd WHERE node_level >= level UNION ALL SELECT level, n, node_id, node_level, lat, CAST(floor((lon - 115.5e0) * n) AS BIGINT) - 1 FROM lv, sd WHERE node_level >= level AND (lon - 115.5e0) * n = floor((lon - 115.5e0) * n)),
cy AS (SELECT *, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS ry FROM cx UNION ALL SELECT *, CAST(floor((lat + 32.5e0) * n) AS BIGINT) - 1 FROM cx WHERE (lat + 32.5e0) * n = floor((lat + 32.5e0) * n)),
mb AS (SELECT level, rx, ry, node_id, node_level FROM cy WHERE rx >= 0 AND rx < n AND ry >= 0 AND ry < n)"""


def _members(spark, d) -> DataFrame:
    degree = view(spark, d, "way_refs").groupBy("node_id").agg(F.count("*").alias("degree")).select(F.struct("degree", "node_id").alias("key"))
    ranks = address.dense_ids(degree, "key", "rank").select("key.node_id", "rank")
    levels = features.rank_levels(ranks, "rank", [(0.55, 2), (0.8, 4), (0.93, 6)], 8).select("node_id", F.col("level").alias("node_level"))
    nodes = view(spark, d, "osm_nodes").select("node_id", "lat", "lon").join(levels, "node_id")
    return contraction.memberships(nodes, [(2, 8), (4, 4), (6, 2), (8, 1)])


@query("r12_region_tree", f"WITH {_LEVELLED} SELECT level, rx, ry, count(*) AS nodes, CAST(count_if(node_level > level) AS BIGINT) AS boundary FROM mb GROUP BY level, rx, ry")
def r12(spark, d):
    return _members(spark, d).groupBy("level", "rx", "ry").agg(F.count("*").alias("nodes"), F.count_if(F.col("node_level") > F.col("level")).alias("boundary"))


@query("r13_region_links", f"""WITH {_LEVELLED}, {_E0}, pr AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(w) AS w FROM e0 GROUP BY 1, 2)
SELECT x.level, x.rx, x.ry, count(*) AS links, CAST(sum(w) AS BIGINT) AS metres FROM pr JOIN mb x ON x.node_id = a JOIN mb y ON y.node_id = b AND y.level = x.level AND y.rx = x.rx AND y.ry = x.ry GROUP BY x.level, x.rx, x.ry""")
def r13(spark, d):
    return contraction.region_links(_members(spark, d), _edges(spark, d)).groupBy("level", "rx", "ry").agg(F.count("*").alias("links"), F.sum("w").alias("metres"))


@query("r14_escape_links", f"""WITH {_LEVELLED} SELECT a.level, a.rx, a.ry, a.node_id, b.rx AS px, b.ry AS py FROM mb a JOIN mb b ON b.level = a.level + 2 AND b.node_id = a.node_id AND b.rx = floor(a.rx / 2e0) AND b.ry = floor(a.ry / 2e0) WHERE a.node_level > a.level""")
def r14(spark, d):
    return contraction.escapes(_members(spark, d), 2)


@query("j20_region_parents", "SELECT c_nationkey AS parent, count(*) AS n, CAST(count_if(NOT (c_custkey >= c_nationkey * 60 AND c_custkey < c_nationkey * 60 + 600)) AS BIGINT) AS outside FROM customer GROUP BY c_nationkey")
def j20(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    parents = c.select(F.col("c_nationkey").alias("parent")).distinct().select("parent", (F.col("parent") * 60).alias("first"), F.lit(600).alias("n"))
    return reconcile.outside_parent(c.select("c_custkey", F.col("c_nationkey").alias("parent")), parents, "c_custkey")


def _failures(spark, d) -> DataFrame:
    return view(spark, d, "failures")


@query("j18_mirrored_ends", """WITH a AS (SELECT DISTINCT level, ix, iy, vert FROM failures WHERE onb = 1), b AS (SELECT DISTINCT level, ix - 1 AS ix, iy, vert FROM failures WHERE onb = 0)
SELECT level, count(*) AS n, CAST(count_if(ix = 15) AS BIGINT) AS outer_edge, CAST(count_if(ix < 15 AND EXISTS (SELECT 1 FROM b WHERE b.level = a.level AND b.ix = a.ix AND b.iy = a.iy AND b.vert = a.vert)) AS BIGINT) AS mirrored,
 CAST(count_if(ix < 15 AND NOT EXISTS (SELECT 1 FROM b WHERE b.level = a.level AND b.ix = a.ix AND b.iy = a.iy AND b.vert = a.vert)) AS BIGINT) AS missing FROM a GROUP BY level""")
def j18(spark, d):
    f = _failures(spark, d)
    return reconcile.mirror_census(f.where("onb = 1").select("level", "ix", "iy", "vert"), f.where("onb = 0").select("level", "ix", "iy", "vert"), 15)


@query("j17_corner_cells", """WITH c AS (SELECT DISTINCT level, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS ix, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS iy FROM osm_nodes, grids)
SELECT a.level, a.ix, a.iy, count(*) AS corners FROM c a JOIN c b ON b.level = a.level AND abs(b.ix - a.ix) = 1 AND abs(b.iy - a.iy) = 1 GROUP BY a.level, a.ix, a.iy""")
def j17(spark, d):
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids"))
    cells = p.select("level", F.floor((F.col("lon") - 115.5) * F.col("n")).alias("ix"), F.floor((F.col("lat") + 32.5) * F.col("n")).alias("iy")).distinct()
    return spatial.corner_cells(cells).groupBy("level", "ix", "iy").agg(F.count("*").alias("corners"))


@query("a32_crossing_census", """WITH c AS (SELECT DISTINCT level, ix, iy FROM failures), s AS (SELECT * FROM (VALUES ('E', 1, 0), ('N', 0, 1), ('S', 0, -1), ('W', -1, 0)) t(side, dx, dy))
SELECT c.level, side, o.level IS NOT NULL AS there, count(*) AS n FROM c JOIN s ON true LEFT JOIN c o ON o.level = c.level AND o.ix = c.ix + dx AND o.iy = c.iy + dy GROUP BY ALL""")
def a32(spark, d):
    return spatial.cell_neighbours(_failures(spark, d).select("level", "ix", "iy").distinct()).groupBy("level", "side", "there").agg(F.count("*").alias("n"))


_DIV = """t AS (SELECT level, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS cy FROM osm_nodes, grids), z AS (SELECT level, cx, cy, count(*) AS size, count(*) > 12 AS divided FROM t GROUP BY ALL)"""


@query("a35_divided_neighbours", f"""WITH {_DIV} SELECT level, size, divided, EXISTS (SELECT 1 FROM z o WHERE o.level = z.level AND o.divided AND abs(o.cx - z.cx) <= 1 AND abs(o.cy - z.cy) <= 1 AND (o.cx <> z.cx OR o.cy <> z.cy)) AS beside, count(*) AS n FROM z GROUP BY ALL""")
def a35(spark, d):
    sub = tiles.retiled(G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids")), 4)
    z = tiles.divide(sub, F.lit(1), 12).select("level", F.col("cx").alias("ix"), F.col("cy").alias("iy"), "size", (F.col("division") > 1).alias("divided"))
    return spatial.beside_marked(z, "divided").groupBy("level", "size", "divided", "beside").agg(F.count("*").alias("n"))


_ORDERS = {"by_row": "dump_row", "by_value": "vert, dump_row", "by_shape": "shape, dump_row"}


@query("a37_order_rules", "WITH t AS (SELECT kind, level, dump_row, row_number() OVER (PARTITION BY kind, level ORDER BY ix, dump_row) AS k, " + ", ".join(f"row_number() OVER (PARTITION BY kind, level ORDER BY {o}) AS {n}" for n, o in _ORDERS.items()) + """ FROM failures)
SELECT rule, split, count(*) AS n, CAST(count_if(k = p) AS BIGINT) AS hits FROM (""" + " UNION ALL ".join(f"SELECT '{n}' AS rule, dump_row % 2 AS split, k, {n} AS p FROM t" for n in _ORDERS) + ") u GROUP BY rule, split")
def a37(spark, d):
    return reconcile.score_orders(_failures(spark, d), ["kind", "level"], ["ix", "dump_row"], {n: o.split(", ") for n, o in _ORDERS.items()}, F.col("dump_row") % 2)


@query("q25_rule_scores", """SELECT rule, split, count(*) AS n, round(avg(CASE WHEN right_ THEN 1e0 ELSE 0e0 END), 6) AS share FROM (SELECT 'first' AS rule, dump_row % 2 AS split, (vert >= 12) = (shape >= 5) AS right_ FROM failures UNION ALL SELECT 'second', dump_row % 2, (level >= 6) = (shape >= 5) FROM failures) t GROUP BY rule, split""")
def q25(spark, d):
    return reconcile.score_rules(_failures(spark, d), {"first": F.col("vert") >= 12, "second": F.col("level") >= 6}, F.col("shape") >= 5, F.col("dump_row") % 2)


@query("j28_reclassified", f"WITH c AS (SELECT level, coalesce({_CAUSE}, 65535) AS old, CASE WHEN vert >= 12 THEN 7 WHEN shape < 3 THEN 8 ELSE 9 END AS new FROM failures) SELECT level AS parent, old, new, count(*) AS n FROM c GROUP BY level, old, new")
def j28(spark, d):
    f = _failures(spark, d)
    old = f.select("dump_row", F.col("level").alias("parent"), F.coalesce(P.first_match(RULES, f.columns), F.lit(65535)).alias("old"))
    new = f.select("dump_row", F.when(F.col("vert") >= 12, 7).when(F.col("shape") < 3, 8).otherwise(9).alias("new"))
    return old.join(new, "dump_row").groupBy("parent", "old", "new").agg(F.count("*").alias("n"))


@query("j32_still_present", f"""WITH r AS (SELECT * FROM failures WHERE {_R}), g AS (SELECT * FROM failures WHERE NOT ({_R})) SELECT level, count(*) AS n, CAST(count_if(EXISTS (SELECT 1 FROM g WHERE g.level = r.level AND g.ix = r.ix AND g.iy = r.iy AND g.shape = r.shape)) AS BIGINT) AS same_shape,
 CAST(count_if(EXISTS (SELECT 1 FROM g WHERE g.level = r.level AND g.ix = r.ix AND g.iy = r.iy AND g.shape = r.shape AND g.vert = r.vert)) AS BIGINT) AS same_vertex FROM r GROUP BY level""")
def j32(spark, d):
    f = _failures(spark, d)
    return reconcile.still_present(f.where(_R), f.where(f"not ({_R})"), ["level", "ix", "iy", "shape"], "vert")


@query("j33_without_source", """WITH a AS (SELECT level, ix, iy, count(DISTINCT shape) AS shapes, max(vert) AS top FROM failures GROUP BY level, ix, iy), b AS (SELECT level, ix, iy, count(DISTINCT shape) AS shapes, max(vert) AS top FROM failures WHERE kind <> (SELECT min(kind) FROM failures) GROUP BY level, ix, iy)
SELECT * FROM a EXCEPT ALL SELECT * FROM b""")
def j33(spark, d):
    f = _failures(spark, d)
    first = f.agg(F.min("kind")).first()[0]
    derive = lambda df: df.groupBy("level", "ix", "iy").agg(F.countDistinct("shape").alias("shapes"), F.max("vert").alias("top"))
    return reconcile.products_of(f, F.col("kind") == first, derive)


@query("j34_demanding_shapes", f"""WITH {_CLIPPED}, a AS (SELECT kind, cx, cy, way_id, round(abs({_AREA}), 3) AS area FROM clipped) SELECT kind, cx, cy, count(*) AS shapes, CAST(count_if(area >= 1e5) AS BIGINT) AS able, min(CASE WHEN k = 1 THEN way_id END) AS first_way FROM (SELECT *, row_number() OVER (PARTITION BY kind, cx, cy ORDER BY area DESC, way_id) AS k FROM a) t GROUP BY kind, cx, cy""")
def j34(spark, d):
    a = _clipped(spark, d).select("kind", "cx", "cy", "way_id", F.round(F.abs(R.area(F.col("v"))), 3).alias("area"))
    return a.groupBy("kind", "cx", "cy").agg(F.count("*").alias("shapes"), F.count_if(F.col("area") >= 1e5).alias("able"), F.min(F.struct((-F.col("area")).alias("a"), "way_id")).alias("low")).select("kind", "cx", "cy", "shapes", "able", F.col("low.way_id").alias("first_way"))


@query("j35_cells_unmet", f"""WITH {_RINGS}, c AS (SELECT DISTINCT CAST(floor((lon - 115.5e0) * 64) AS BIGINT) AS cell_x, CAST(floor((lat + 32.5e0) * 64) AS BIGINT) AS cell_y FROM osm_nodes),
m AS (SELECT DISTINCT ix, iy, coalesce(nat, landuse) AS kind FROM (SELECT way_id, ix, iy FROM edge UNION ALL SELECT way_id, ix, iy FROM inner_cells) x JOIN osm_ways USING (way_id)),
l AS (SELECT DISTINCT cell_x, cell_y, k AS kind FROM local_shapes, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t)
SELECT 'ways' AS source, cell_x, cell_y, kind FROM c, (SELECT 'water' AS kind UNION ALL SELECT 'forest') k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ix = c.cell_x AND m.iy = c.cell_y AND m.kind = k.kind)
UNION ALL SELECT 'shapes', cell_x, cell_y, CAST(kind AS VARCHAR) FROM l WHERE NOT EXISTS (SELECT 1 FROM local_shapes s WHERE s.cell_x = l.cell_x AND s.cell_y = l.cell_y AND s.kind = l.kind)""")
def j35(spark, d):
    r = _rings(spark, d)
    ways = view(spark, d, "osm_ways").select("way_id", F.coalesce("nat", "landuse").alias("kind"))
    met = tiles.ring_cells(r, 64).join(ways, "way_id").select(F.col("ix").alias("cell_x"), F.col("iy").alias("cell_y"), "kind").distinct()
    c = view(spark, d, "osm_nodes").select(F.floor((F.col("lon") - 115.5) * 64).alias("cell_x"), F.floor((F.col("lat") + 32.5) * 64).alias("cell_y")).distinct()
    s = view(spark, d, "local_shapes").select(F.col("cell_x").cast("long"), F.col("cell_y").cast("long"), F.col("kind").cast("string")).distinct()
    unmet = lambda cells, kinds, have: cells.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).join(have, ["cell_x", "cell_y", "kind"], "left_anti")
    by_shape = unmet(s.select("cell_x", "cell_y").distinct(), ["0", "1", "2"], s)
    return unmet(c, ["water", "forest"], met).select(F.lit("ways").alias("source"), "*").unionByName(by_shape.select(F.lit("shapes").alias("source"), "*"))


@query("j26_producers", f"""WITH {_CLIPPED}, s AS (SELECT cx, cy, way_id, array_to_string(list_transform(v, lambda p: CAST(CAST(round_even(p.x / 1024, 0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round_even(p.y / 1024, 0) AS BIGINT) AS VARCHAR)), ',') AS shape FROM clipped),
n AS (SELECT cx, cy, shape, count(DISTINCT way_id) AS k FROM s GROUP BY ALL) SELECT cx, cy, CASE WHEN k = 1 THEN 'unique' ELSE 'ambiguous' END AS class, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def j26(spark, d):
    at = lambda p, k: F.rint(p[k] / 1024).cast("long")
    shape = F.array_join(F.transform("v", lambda p: F.concat_ws(":", at(p, "x"), at(p, "y"))), ",")
    clips = _clipped(spark, d).select("cx", "cy", F.unhex(F.sha2(shape, 256)).alias("shape"), "way_id")
    # nearly every clip is a shape of its own, so none is summed up before it is dealt, and one pass tells one way from several
    n = clips.repartition(tasks(spark, d), "cx", "cy", "shape").groupBy("cx", "cy", "shape").agg((F.min("way_id") == F.max("way_id")).alias("one"))
    return n.groupBy("cx", "cy", F.when(F.col("one"), "unique").otherwise("ambiguous").alias("class")).agg(F.count("*").alias("n"))


@query("g12_ring_faults", f"""WITH {_LATTICE}, e AS (SELECT way_id, i, len(v) AS n, {_BEFORE} AS p, v[i] AS q FROM (SELECT way_id, v, unnest(range(1, len(v) + 1)) AS i FROM lat_rings) t),
c AS (SELECT a.way_id FROM e a JOIN e b ON a.way_id = b.way_id AND a.i + 1 < b.i AND NOT (a.i = 1 AND b.i = b.n) WHERE
 ((a.q.x - a.p.x) * (b.p.y - a.p.y) - (a.q.y - a.p.y) * (b.p.x - a.p.x)) * ((a.q.x - a.p.x) * (b.q.y - a.p.y) - (a.q.y - a.p.y) * (b.q.x - a.p.x)) < 0 AND
 ((b.q.x - b.p.x) * (a.p.y - b.p.y) - (b.q.y - b.p.y) * (a.p.x - b.p.x)) * ((b.q.x - b.p.x) * (a.q.y - b.p.y) - (b.q.y - b.p.y) * (a.q.x - b.p.x)) < 0)
SELECT way_id, len(v) - len(list_distinct(v)) AS repeated, (SELECT count(*) FROM c WHERE c.way_id = r.way_id) AS crossings FROM lat_rings r""")
def g12(spark, d):
    r = lattice_rings(spark, d)
    e = r.select("way_id", F.size("v").alias("n"), F.posexplode("v").alias("i", "q"), F.col("v")).select("way_id", "n", "i", "q", F.element_at("v", F.when(F.col("i") == 0, F.col("n")).otherwise(F.col("i"))).alias("p"))
    side = lambda a, p: (F.col(f"{a}.q.x") - F.col(f"{a}.p.x")) * (F.col(f"{p}.y") - F.col(f"{a}.p.y")) - (F.col(f"{a}.q.y") - F.col(f"{a}.p.y")) * (F.col(f"{p}.x") - F.col(f"{a}.p.x"))
    cross = (side("a", "b.p") * side("a", "b.q") < 0) & (side("b", "a.p") * side("b", "a.q") < 0)
    apart = F.expr("a.i + 1 < b.i and not (a.i = 0 and b.i = b.n - 1)")
    c = e.alias("a").join(e.alias("b"), F.col("a.way_id") == F.col("b.way_id")).where(apart & cross).groupBy(F.col("a.way_id").alias("way_id")).agg(F.count("*").alias("k"))
    return r.join(c, "way_id", "left").select("way_id", (F.size("v") - F.size(F.array_distinct("v"))).cast("long").alias("repeated"), F.coalesce("k", F.lit(0)).alias("crossings"))


_NAMED = "nm AS (SELECT node_id, name, CAST(floor((lon - 115.5e0) * 16) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * 16) AS BIGINT) AS cy, (lon - 115.5e0) * 16 AS x, (lat + 32.5e0) * 16 AS y FROM osm_nodes WHERE name IS NOT NULL)"


@query("w15_name_halo", f"""WITH {_NAMED}, c AS (SELECT DISTINCT cx, cy FROM nm), h AS (SELECT c.cx, c.cy, name, lower(name) AS low, node_id, round(greatest(abs(x - c.cx - 0.5e0), abs(y - c.cy - 0.5e0)), 6) AS dist FROM c JOIN nm ON abs(nm.cx - c.cx) <= 1 AND abs(nm.cy - c.cy) <= 1 AND (nm.cx <> c.cx OR nm.cy <> c.cy)
 WHERE NOT EXISTS (SELECT 1 FROM nm o WHERE o.cx = c.cx AND o.cy = c.cy AND lower(o.name) = lower(nm.name))),
b AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, low ORDER BY dist, node_id) AS k FROM h), s AS (SELECT *, sum(length(name)) OVER (PARTITION BY cx, cy ORDER BY dist, low ROWS UNBOUNDED PRECEDING) AS total FROM b WHERE k = 1)
SELECT cx, cy, node_id, name FROM s WHERE total <= 60""")
def w15(spark, d):
    n = view(spark, d, "osm_nodes").where("name is not null")
    n = n.select("node_id", "name", ((F.col("lon") - 115.5) * 16).alias("x"), ((F.col("lat") + 32.5) * 16).alias("y")).withColumn("cx", F.floor("x")).withColumn("cy", F.floor("y"))
    return features.name_halo(n, 60)


@query("q21_path_comparison", f"""WITH r AS (SELECT level, ix, iy, count(*) AS n, sum(vert) AS size FROM failures WHERE {_R} GROUP BY ALL), g AS (SELECT level, ix, iy, count(*) AS n, sum(vert) AS size FROM failures WHERE {_G} GROUP BY ALL)
SELECT level, ix, iy, CAST(coalesce(g.size, 0) - coalesce(r.size, 0) AS BIGINT) AS delta, CASE WHEN r.n IS NULL THEN 'added' WHEN g.n IS NULL THEN 'removed' WHEN r.n = g.n AND r.size = g.size THEN 'same' WHEN r.n = g.n THEN 'resized' ELSE 'changed' END AS status FROM r FULL JOIN g USING (level, ix, iy)""")
def q21(spark, d):
    f = _failures(spark, d)
    return reconcile.compare_paths(f.where(_R), f.where(_G), ["level", "ix", "iy"], "vert")


@query("q22_change_causes", f"""WITH s AS (SELECT level, ix, iy, CAST(count_if({_R}) AS BIGINT) - CAST(count_if(NOT ({_R})) AS BIGINT) AS d, count(DISTINCT kind) AS kinds, max(vert) AS top FROM failures GROUP BY ALL)
SELECT level, CASE WHEN d = 0 THEN 'equal' WHEN kinds = 1 THEN 'one_section' WHEN top < 12 THEN 'small' WHEN d > 0 THEN 'lost' ELSE 'gained' END AS cause, count(*) AS n FROM s GROUP BY ALL""")
def q22(spark, d):
    f = _failures(spark, d)
    s = f.groupBy("level", "ix", "iy").agg(F.sum(F.when(F.expr(_R), 1).otherwise(-1)).alias("d"), F.countDistinct("kind").alias("kinds"), F.max("vert").alias("top"))
    cause = F.when(F.col("d") == 0, "equal").when(F.col("kinds") == 1, "one_section").when(F.col("top") < 12, "small").when(F.col("d") > 0, "lost").otherwise("gained")
    return s.groupBy("level", cause.alias("cause")).agg(F.count("*").alias("n"))


_LEVELS = "x AS (SELECT level, n FROM grids WHERE level IN (0, 4))"
_SOURCES = f"""{_LEVELS}, src AS (SELECT 'node' AS kind, node_id AS id, lon, lat FROM osm_nodes UNION ALL SELECT 'road_point', way_id * 64 + pos, lon, lat FROM geo_points JOIN osm_ways USING (way_id) WHERE highway = 'motorway'
 UNION ALL SELECT 'name_anchor', node_id, lon, lat FROM osm_nodes WHERE name IS NOT NULL),
f AS (SELECT kind, id, level, (lon - 115.5e0) * n * 4096 AS x, (lat + 32.5e0) * n * 4096 AS y FROM src, x)"""


@query("q11_round_trip", f"""WITH {_SOURCES}, p AS (SELECT kind, id, level, round_even(x, 0) + CASE WHEN id % 97 = 0 THEN 3e0 WHEN id % 89 = 0 THEN 2e0 ELSE 0e0 END AS x, round_even(y, 0) AS y FROM f),
m AS (SELECT p.kind, p.level, p.id, min(greatest(abs(p.x - f.x), abs(p.y - f.y))) AS off FROM (SELECT *, unnest([floor(x) - 1, floor(x)]) AS bx FROM p) p LEFT JOIN f ON f.kind = p.kind AND f.level = p.level AND floor(f.x) = p.bx AND abs(p.x - f.x) <= 0.5e0 AND abs(p.y - f.y) <= 0.5e0 GROUP BY ALL)
SELECT kind, level, count(*) AS checked, count(*) FILTER (WHERE off IS NULL AND id % 89 <> 0) AS failing, count(*) FILTER (WHERE off IS NULL AND id % 89 = 0) AS explained, round(max(off), 4) AS worst FROM m GROUP BY kind, level""")
def q11(spark, d):
    named = view(spark, d, "osm_nodes")
    roads = view(spark, d, "geo_points").join(view(spark, d, "osm_ways").where("highway = 'motorway'").select("way_id"), "way_id")
    of = lambda kind, df, key: df.select(F.lit(kind).alias("source"), key.alias("id"), "lon", "lat")
    node = F.col("node_id")
    sources = of("node", named, node).unionByName(of("road_point", roads, F.col("way_id") * 64 + F.col("pos"))).unionByName(of("name_anchor", named.where("name is not null"), node))
    at = G.with_levels(sources, view(spark, d, "grids").where("level in (0, 4)"))
    at = at.select("source", "id", "level", ((F.col("lon") - 115.5) * F.col("n") * 4096).alias("x"), ((F.col("lat") + 32.5) * F.col("n") * 4096).alias("y"))
    moved = F.when(F.col("id") % 97 == 0, 3.0).when(F.col("id") % 89 == 0, 2.0).otherwise(0.0)  # planted faults; the second kind is a declared one
    product = at.select("source", "id", "level", (F.rint("x") + moved).alias("x"), F.rint("y").alias("y"))
    return reconcile.round_trip(product, at, ["source", "level"], 0.5, F.col("id") % 89 == 0).withColumnRenamed("source", "kind")
