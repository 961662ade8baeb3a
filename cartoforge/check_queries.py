"""Queries on stored tables, rule documents and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import grid as G
from .functions import rules as P
from .operators import address, checks, reconcile, store, tiles
from .queries import _CAUSE, KINDS, PLACES, ROADS, RULES, _in, query
from .sources.adapters import tasks, view

LEVELS = (0, 2, 4, 6, 8, 10, 12)
# A vocabulary with two ranges of levels, and the coordinate range of each level and class.
ROAD_TYPES = {"ranges": [[0, 4], [6, 12]], "default": 9, "rules": [
    {"levels": [0, 4], "match": {"highway": ["motorway"], "oneway": ["yes"]}, "value": 0}, {"levels": [0, 4], "match": {"highway": ["motorway", "trunk"]}, "value": 1},
    {"levels": [0, 4], "match": {"highway": ["primary", "secondary"]}, "value": 2}, {"levels": [0, 4], "match": {"junction": ["*"]}, "value": 3},
    {"levels": [6, 12], "match": {"highway": ["motorway", "trunk", "primary"]}, "value": 4}, {"levels": [6, 12], "match": {"highway": ["*"], "oneway": ["yes"]}, "value": 5}]}
UNITS = [(level, kind, 1024 << (level % 3) << (kind == "road")) for level in LEVELS for kind in ("road", "background")]

_CODED = """CASE WHEN level <= 4 THEN CASE WHEN highway = 'motorway' AND oneway = 'yes' THEN 0 WHEN highway IN ('motorway', 'trunk') THEN 1 WHEN highway IN ('primary', 'secondary') THEN 2 WHEN junction IS NOT NULL THEN 3 ELSE 9 END
 ELSE CASE WHEN highway IN ('motorway', 'trunk', 'primary') THEN 4 WHEN highway IS NOT NULL AND oneway = 'yes' THEN 5 ELSE 9 END END"""


def _failures(spark, d) -> DataFrame:
    return view(spark, d, "failures")


def _values(spark, d) -> DataFrame:
    w = G.with_levels(view(spark, d, "osm_ways"), view(spark, d, "grids"))
    return w.withColumn("value", store.coded(ROAD_TYPES, F.col("level"), LEVELS, {c: F.col(c) for c in ("highway", "oneway", "junction")}))


@query("s05_tiled_rows", "SELECT level, ix, iy, count(*) AS n, min(dump_row) AS first_row FROM failures GROUP BY level, ix, iy")
def s05(spark, d):
    content = _failures(spark, d).groupBy("level", "ix", "iy").agg(F.count("*").alias("n"), F.min("dump_row").alias("first_row"))
    store.write_tiles(content, path := store.fresh_path(spark, "tiles"))
    return store.read_tiles(spark, path)


@query("s06_tile_range", "SELECT level, ix, iy, shape, count(*) AS n FROM failures WHERE level = 4 AND iy BETWEEN 3 AND 9 AND ix BETWEEN 2 AND 11 GROUP BY level, ix, iy, shape")
def s06(spark, d):
    content = _failures(spark, d).groupBy("level", "ix", "iy", "shape").agg(F.count("*").alias("n"))
    store.write_tiles(content, path := store.fresh_path(spark, "tiles"))
    return store.read_tiles(spark, path, level=4, rows=(3, 9), columns=(2, 11))


@query("l01_tiled_order", "SELECT level, ix, iy, CAST(floor(ix / 4e0) AS BIGINT) AS tx, CAST(floor(iy / 4e0) AS BIGINT) AS ty, row_number() OVER (PARTITION BY level, floor(iy / 4e0), floor(ix / 4e0) ORDER BY iy, ix) AS place FROM (SELECT DISTINCT level, ix, iy FROM failures) t")
def l01(spark, d):
    return store.tiled_order(_failures(spark, d).select("level", "ix", "iy").distinct(), 4)


@query("s08_coded_ways", f"SELECT level, value, count(*) AS n, min(way_id) AS first_way FROM (SELECT way_id, level, {_CODED} AS value FROM osm_ways, grids) t GROUP BY level, value")
def s08(spark, d):
    return _values(spark, d).groupBy("level", "value").agg(F.count("*").alias("n"), F.min("way_id").alias("first_way"))


@query("p07_emitted_values", f"""WITH e AS (SELECT level, value FROM grids, (SELECT unnest([0, 1, 2, 3, 9]) AS value) v WHERE level <= 4 UNION ALL SELECT level, value FROM grids, (SELECT unnest([4, 5, 9]) AS value) v WHERE level > 4),
c AS (SELECT level, {_CODED} AS value, count(*) AS k FROM osm_ways, grids GROUP BY ALL) SELECT level, value, coalesce(k, 0) AS n FROM e LEFT JOIN c USING (level, value)""")
def p07(spark, d):
    seen = _values(spark, d).groupBy("level", "value").agg(F.count("*").alias("k"))
    return store.emitted(spark, ROAD_TYPES, LEVELS).join(seen, ["level", "value"], "left").select("level", "value", F.coalesce("k", F.lit(0)).alias("n"))


@query("s09_selected_features", f"""SELECT level, 'road' AS class, count(*) AS n FROM osm_ways, grids WHERE highway IS NOT NULL AND {_in('highway', ROADS)} GROUP BY level
UNION ALL SELECT level, 'place', count(*) FROM osm_nodes, grids WHERE place IS NOT NULL AND {_in('place', PLACES)} GROUP BY level
UNION ALL SELECT level, 'background', count(*) FROM osm_ways, grids WHERE highway IS NULL AND {_in('coalesce(nat, landuse)', KINDS)} GROUP BY level""")
def s09(spark, d):
    table = store.selection({k: {"highway": ROADS.get(k, []), "place": PLACES.get(k, []), "background": KINDS.get(k, [])} for k in LEVELS}, LEVELS)
    grids = view(spark, d, "grids").select("level")
    ways, nodes = view(spark, d, "osm_ways"), view(spark, d, "osm_nodes")

    def chosen(df: DataFrame, value, field: str, name: str) -> DataFrame:
        shown = F.lit(False)
        for k, row in table.items():
            shown = F.when(F.col("level") == k, value.isin(row[field])).otherwise(shown)
        return G.with_levels(df, grids).where(shown).groupBy("level").agg(F.count("*").alias("n")).select("level", F.lit(name).alias("class"), "n")

    out = chosen(ways.where("highway is not null"), F.col("highway"), "highway", "road")
    out = out.unionByName(chosen(nodes.where("place is not null"), F.col("place"), "place", "place"))
    return out.unionByName(chosen(ways.where("highway is null"), F.coalesce("nat", "landuse"), "background", "background"))


@query("x13_range_lookup", """SELECT level, class, units, count(*) AS n FROM (SELECT level, CASE WHEN highway IS NULL THEN 'background' ELSE 'road' END AS class, CASE level % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 4096 END * CASE WHEN highway IS NULL THEN 1 ELSE 2 END AS units
FROM osm_ways, grids) t GROUP BY level, class, units""")
def x13(spark, d):
    w = G.with_levels(view(spark, d, "osm_ways"), view(spark, d, "grids")).select("level", F.when(F.col("highway").isNull(), "background").otherwise("road").alias("class"))
    found = store.range_lookup(w, spark.createDataFrame(UNITS, "level int, class string, units int"), ["level", "class"])
    return found.groupBy("level", "class", "units").agg(F.count("*").alias("n"))


@query("s10_dump_check", """WITH n AS (SELECT kind, count(*) AS n FROM failures GROUP BY kind), m AS (SELECT kind, n + CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END AS wanted FROM n UNION ALL SELECT 'never', 3)
SELECT kind, coalesce(n, 0) AS n, wanted, coalesce(n, 0) = wanted AS ok FROM m LEFT JOIN n USING (kind)""")
def s10(spark, d):
    f = _failures(spark, d)
    manifest = f.groupBy("kind").agg((F.count("*") + F.count("*") % 2).alias("n")).union(spark.createDataFrame([("never", 3)], "kind string, n long"))
    return store.check_dump(f, manifest)


@query("s11_canonical_dump", """WITH o AS (SELECT kind, dump_row, row_number() OVER (PARTITION BY kind ORDER BY level, ix, iy, code, shape, dump_row) AS k FROM failures)
SELECT kind, count(*) AS n, min(dump_row) AS first_row, max(dump_row) AS last_row, min(CASE WHEN k = 1 THEN dump_row END) AS head FROM o GROUP BY kind""")
def s11(spark, d):
    f, order = _failures(spark, d), ["kind", "level", "ix", "iy", "code", "shape", "dump_row"]
    path = store.fresh_path(spark, "dump")
    manifest = store.write_canonical(f, order, path)
    back = spark.read.parquet(path).groupBy("kind").agg(F.min("dump_row").alias("first_row"), F.max("dump_row").alias("last_row"), F.min(F.struct(*order)).alias("low"))
    return manifest.join(back, "kind").select("kind", "n", "first_row", "last_row", F.col("low.dump_row").alias("head"))


@query("s12_report_lines", "SELECT kind || chr(9) || CAST(level AS VARCHAR) || chr(9) || CAST(count(*) AS VARCHAR) || chr(9) || CASE WHEN sum(d_src) IS NULL THEN '' ELSE printf('%.6f', sum(d_src)) END AS line FROM failures GROUP BY kind, level")
def s12(spark, d):
    rows = _failures(spark, d).groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum("d_src").alias("total"))
    store.write_report(rows, ["kind", "level", "n", "total"], path := store.fresh_path(spark, "report"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("l06_sorted_ranges", """WITH p AS (SELECT addr_id, upper(trim(street_name)) AS street, CASE WHEN regexp_extract(house_number, '^\\s*([0-9]+)', 1) = '' THEN 0 ELSE CAST(regexp_extract(house_number, '^\\s*([0-9]+)', 1) AS INT) END AS first FROM address_points)
SELECT street, first, addr_id, row_number() OVER (PARTITION BY street ORDER BY first, addr_id) AS place FROM p""")
def l06(spark, d):
    from pyspark.sql import Window

    p = view(spark, d, "address_points")
    digits = F.regexp_extract("house_number", r"^\s*([0-9]+)", 1)
    p = p.select("addr_id", address.key(F.col("street_name")).alias("street"), F.when(digits == "", 0).otherwise(digits.cast("int")).alias("first"))
    return p.select("street", "first", "addr_id", F.row_number().over(Window.partitionBy("street").orderBy("first", "addr_id")).cast("long").alias("place"))


@query("x11_street_keys", "SELECT upper(trim(street_name)) AS street, upper(trim(city_name)) AS city, count(*) AS n FROM address_points GROUP BY ALL")
def x11(spark, d):
    return view(spark, d, "address_points").groupBy(address.key(F.col("street_name")).alias("street"), address.key(F.col("city_name")).alias("city")).agg(F.count("*").alias("n"))


@query("x26_content_hash", "SELECT dump_row, sha256(kind || ':' || CAST(level AS VARCHAR) || ':' || CAST(ix AS VARCHAR) || ':' || CAST(iy AS VARCHAR) || ':' || CAST(dump_row AS VARCHAR)) AS hash FROM failures")
def x26(spark, d):
    return _failures(spark, d).select("dump_row", F.sha2(F.concat_ws(":", "kind", "level", "ix", "iy", "dump_row"), 256).alias("hash"))


@query("p01_level_fan_out", "SELECT way_id, level, n FROM osm_ways, grids WHERE highway IS NOT NULL")
def p01(spark, d):
    return G.with_levels(view(spark, d, "osm_ways").where("highway is not null").select("way_id"), view(spark, d, "grids"))


@query("p16_row_predicates", "SELECT dump_row FROM failures WHERE code IN (288, 578) AND level >= 4 AND level < 12 AND shape <> 3 AND d_src IS NOT NULL AND d_src <= 80e0")
def p16(spark, d):
    f = _failures(spark, d)
    return f.where(P.predicate([["code", "in", [288, 578]], ["level", ">=", 4], ["level", "<", 12], ["shape", "!=", 3], ["d_src", "notnan"], ["d_src", "<=", 80.0]], f.columns)).select("dump_row")


@query("j01_located_refs", "SELECT way_id, pos, r.node_id, lat, lon FROM way_refs r JOIN osm_nodes n ON r.node_id = n.node_id")
def j01(spark, d):
    return view(spark, d, "way_refs").join(view(spark, d, "osm_nodes").select("node_id", "lat", "lon"), "node_id").select("way_id", "pos", "node_id", "lat", "lon")


@query("w04_islands", """WITH c AS (SELECT DISTINCT way_id, pos, floor((lon - 115.5e0) * 4) * 4 + floor((lat + 32.5e0) * 4) AS cell FROM geo_points), b AS (SELECT *, CASE WHEN cell = lag(cell) OVER (PARTITION BY way_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY way_id ORDER BY pos) AS run FROM b) SELECT way_id, CAST(run AS BIGINT) AS run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM i GROUP BY way_id, run""")
def w04(spark, d):
    c = view(spark, d, "geo_points").select("way_id", "pos", (F.floor((F.col("lon") - 115.5) * 4) * 4 + F.floor((F.col("lat") + 32.5) * 4)).alias("cell"))
    return tiles.islands(c, tasks(spark, d))


@query("f05_rules_as_data", f"SELECT coalesce({_CAUSE}, 65535) AS cause, count(*) AS n FROM failures GROUP BY 1")
def f05(spark, d):
    import json

    f = _failures(spark, d)
    rules = json.loads(json.dumps({"version": 1, "rules": RULES}))["rules"]  # as they come from a file
    return f.groupBy(F.coalesce(P.first_match(rules, f.columns), F.lit(65535)).alias("cause")).agg(F.count("*").alias("n"))


@query("a08_partition_proof", f"""WITH m AS (SELECT kind, count(*) AS n FROM failures GROUP BY kind UNION ALL SELECT 'never', 0), c AS (SELECT kind, count({_CAUSE}) AS assigned, count(*) - count({_CAUSE}) AS unclassified FROM failures GROUP BY kind)
SELECT kind, n AS wanted, coalesce(assigned, 0) AS assigned, coalesce(unclassified, 0) AS unclassified, n = coalesce(assigned, 0) AND coalesce(unclassified, 0) = 0 AS proven FROM m LEFT JOIN c USING (kind)""")
def a08(spark, d):
    f = _failures(spark, d)
    manifest = f.groupBy("kind").agg(F.count("*").alias("n")).union(spark.createDataFrame([("never", 0)], "kind string, n long"))
    return checks.partition_proof(f, manifest, P.first_match(RULES, f.columns).isNotNull())


@query("c05_kind_census", "SELECT kind, CASE WHEN kind IN ('never', 'none') THEN 0 ELSE count(*) END AS n FROM (SELECT kind FROM failures UNION ALL SELECT 'never' UNION ALL SELECT 'none') t GROUP BY kind")
def c05(spark, d):
    f = _failures(spark, d)
    kinds = f.select("kind").distinct().union(spark.createDataFrame([("never",), ("none",)], "kind string"))
    return checks.kind_census(f, kinds)


@query("c04_dispositions", f"""SELECT kind, level, code, cause, count(*) AS n, string_agg(CAST(dump_row AS VARCHAR), ',' ORDER BY dump_row) FILTER (WHERE k <= 5) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY kind, level, code, cause ORDER BY dump_row) AS k FROM (SELECT kind, level, code, dump_row, coalesce({_CAUSE}, 65535) AS cause FROM failures) a) t GROUP BY kind, level, code, cause""")
def c04(spark, d):
    f = _failures(spark, d)
    f = f.withColumn("cause", F.coalesce(P.first_match(RULES, f.columns), F.lit(65535)))
    return reconcile.dispositions(f, ["kind", "level", "code", "cause"], "dump_row", 5)


_MADE, _WANTED = "dump_row % 5 <> 0", "dump_row % 7 <> 0"
_CHECKS = f"""WITH g AS (SELECT * FROM failures WHERE {_MADE}), r AS (SELECT * FROM failures WHERE {_WANTED} AND NOT (level = 6 AND code = 578)),
ce AS (SELECT level, (SELECT count(*) FROM g WHERE g.level = l.level) AS a, (SELECT count(*) FROM r WHERE r.level = l.level) AS b FROM (SELECT DISTINCT level FROM (SELECT level FROM g UNION ALL SELECT level FROM r) u) l),
ps AS (SELECT level, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.level = c.level AND r.code = c.code)) AS extra FROM (SELECT DISTINCT level, code FROM g) c GROUP BY level),
cr AS (SELECT level, count(*) FILTER (WHERE vert NOT BETWEEN 0 AND 22) AS bad, min(vert) AS lo, max(vert) AS hi FROM g GROUP BY level),
gb AS (SELECT level, min(ix) AS a, max(ix) AS b, min(iy) AS c, max(iy) AS d FROM g GROUP BY level), rb AS (SELECT level, min(ix) AS a, max(ix) AS b, min(iy) AS c, max(iy) AS d FROM r GROUP BY level),
gs AS (SELECT level, greatest(abs(gb.a - rb.a), abs(gb.b - rb.b), abs(gb.c - rb.c), abs(gb.d - rb.d)) AS apart FROM gb JOIN rb USING (level)),
sp AS (SELECT DISTINCT CAST(level AS VARCHAR) || '-' || CAST(ix AS VARCHAR) || '-' || CAST(iy AS VARCHAR) AS spot, level, ix, iy FROM failures WHERE shape = 0)
SELECT 'count_envelope' AS "check", CAST(level AS VARCHAR) AS scope, CASE WHEN level = 0 OR CASE WHEN b = 0 THEN a = 0 ELSE a BETWEEN 0.5e0 * b AND 1.5e0 * b END THEN 'PASS' ELSE 'FAIL' END AS status, CAST(a AS VARCHAR) || '/' || CAST(b AS VARCHAR) AS detail FROM ce
UNION ALL SELECT 'presence_subset', CAST(level AS VARCHAR), CASE WHEN extra = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(extra AS VARCHAR) FROM ps
UNION ALL SELECT 'coordinate_range', CAST(level AS VARCHAR), CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(bad AS VARCHAR) || '/' || CAST(lo AS VARCHAR) || '/' || CAST(hi AS VARCHAR) FROM cr
UNION ALL SELECT 'grid_shape', CAST(level AS VARCHAR), CASE WHEN apart <= 1 THEN 'PASS' ELSE 'FAIL' END, CAST(apart AS VARCHAR) FROM gs
UNION ALL SELECT 'spot_check', spot, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.level = sp.level AND g.ix = sp.ix AND g.iy = sp.iy) THEN 'PASS' ELSE 'FAIL' END, CAST(level AS VARCHAR) || '/' || CAST(ix AS VARCHAR) || '/' || CAST(iy AS VARCHAR) FROM sp"""


def _tables(spark, d) -> dict[str, DataFrame]:
    f = _failures(spark, d)
    spots = f.where("shape = 0").select(F.concat_ws("-", "level", "ix", "iy").alias("spot"), "level", "ix", "iy").distinct()
    return {"made": f.where(_MADE), "wanted": f.where(f"{_WANTED} and not (level = 6 and code = 578)"), "spots": spots}


@query("q09_all_checks", _CHECKS)
def q09(spark, d):
    return checks.run_checks(_tables(spark, d))


def _one(name: str, key: str):
    @query(name, f"""SELECT * FROM ({_CHECKS}) x WHERE "check" = '{key}'""")
    def f(spark, d):
        return checks.run_checks(_tables(spark, d), [key])


for _name, _key in (("q01_count_envelope", "count_envelope"), ("q03_presence_subset", "presence_subset"), ("q04_coordinate_range", "coordinate_range"), ("q05_grid_shape", "grid_shape"), ("q07_spot_checks", "spot_check")):
    _one(_name, _key)


@query("w14_even_spread", """WITH p AS (SELECT kind, level, dump_row, row_number() OVER (PARTITION BY kind, level ORDER BY dump_row) - 1 AS spot, count(*) OVER (PARTITION BY kind, level) AS n FROM failures),
s AS (SELECT *, least(8, n) AS k FROM p), m AS (SELECT *, CASE WHEN k = 1 THEN spot = 0 ELSE len(list_filter(range(0, k), lambda i: round_even(i * (n - 1) / CAST(k - 1 AS DOUBLE), 0) = spot)) > 0 END AS pick FROM s)
SELECT kind, level, dump_row, row_number() OVER (PARTITION BY kind, level ORDER BY pick DESC, spot) AS turn FROM m""")
def w14(spark, d):
    return checks.spread_first(_failures(spark, d).select("kind", "level", "dump_row"), ["kind", "level"], ["dump_row"], 8)


@query("j07_scoped_flag", """WITH s AS (SELECT kind, level, ix, iy, code, shape, max(onb) AS onb FROM failures WHERE dump_row % 3 = 0 GROUP BY ALL)
SELECT f.dump_row, CASE WHEN f.level = 0 AND f.code = 291 AND f.d_src IS NULL THEN coalesce(s.onb, 0) ELSE -1 END AS verified FROM failures f LEFT JOIN s ON f.kind = s.kind AND f.level = s.level AND f.ix = s.ix AND f.iy = s.iy AND f.code = s.code AND f.shape = s.shape""")
def j07(spark, d):
    f, keys = _failures(spark, d), ["kind", "level", "ix", "iy", "code", "shape"]
    side = f.where("dump_row % 3 = 0").groupBy(*keys).agg(F.max("onb").alias("verified"))
    return reconcile.scoped_flag(f, side, keys, "verified", (F.col("level") == 0) & (F.col("code") == 291) & F.col("d_src").isNull()).select("dump_row", "verified")


@query("g06_retiled", """SELECT level, cx, cy, sx, sy, count(*) AS n FROM (SELECT level, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS cy,
 CAST(floor(((lon - 115.5e0) * n - floor((lon - 115.5e0) * n)) * 4) AS BIGINT) AS sx, CAST(floor(((lat + 32.5e0) * n - floor((lat + 32.5e0) * n)) * 4) AS BIGINT) AS sy FROM osm_nodes, grids) t GROUP BY ALL""")
def g06(spark, d):
    return tiles.retiled(G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids")), 4).groupBy("level", "cx", "cy", "sx", "sy").agg(F.count("*").alias("n"))


_SUB = "CAST(floor(((lon - 115.5e0) * n - floor((lon - 115.5e0) * n)) * 4) AS BIGINT) AS sx, CAST(floor(((lat + 32.5e0) * n - floor((lat + 32.5e0) * n)) * 4) AS BIGINT) AS sy"


@query("g11_divided_cells", f"""WITH t AS (SELECT level, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS cx, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS cy, {_SUB} FROM osm_nodes, grids),
q AS (SELECT level, cx, cy, floor(sx / 2) AS hx, floor(sy / 2) AS hy, count(*) AS k FROM t GROUP BY ALL), c AS (SELECT level, cx, cy, sum(k) AS size, max(k) AS largest FROM q GROUP BY ALL)
SELECT level, cx, cy, CAST(size AS BIGINT) AS size, CASE WHEN size <= 12 THEN 1 WHEN largest <= 12 THEN 2 ELSE 4 END AS division FROM c""")
def g11(spark, d):
    sub = tiles.retiled(G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids")), 4)
    return tiles.divide(sub, F.lit(1), 12)
