"""Map tables as views of the driver's tables: nodes, ways, relations, addresses, failures. Spark and the oracle share the text."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: By session: the tables of each folder that it has opened, and the folder (now) whose views are set.
_OPENED: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "osm_nodes": """SELECT CAST(p_partkey AS BIGINT) AS node_id,
 -32.5e0 + CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007e0 AS lat, 115.5e0 + CAST((p_partkey * 104729) % 10009 AS DOUBLE) / 10009e0 AS lon,
 CASE WHEN p_partkey % 5 = 0 THEN p_name END AS name,
 CASE WHEN p_partkey % 5 = 0 THEN CASE p_size % 4 WHEN 0 THEN 'suburb' WHEN 1 THEN 'city' WHEN 2 THEN 'town' ELSE 'locality' END END AS place FROM part""",
    "way_refs": """SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
 l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS pos, l_partkey AS node_id FROM lineitem""",
    "geo_points": """SELECT way_id, CAST(pos * 2 AS INT) AS pos, node_id, lat, lon FROM geo_steps UNION ALL
 SELECT way_id, CAST(pos * 2 + 1 AS INT) AS pos, 1000000000 + way_id * 64 + pos AS node_id, (lat + lat2) / 2e0 + 1e-3 AS lat, (lon + lon2) / 2e0 - 1e-3 AS lon FROM geo_steps WHERE n2 IS NOT NULL""",
    "geo_steps": """SELECT r.way_id, r.pos, r.node_id, n.lat, n.lon, lead(r.node_id) OVER w AS n2, lead(n.lat) OVER w AS lat2, lead(n.lon) OVER w AS lon2
 FROM way_refs r JOIN osm_nodes n ON r.node_id = n.node_id WINDOW w AS (PARTITION BY r.way_id ORDER BY r.pos)""",
    "osm_ways": """SELECT o_orderkey AS way_id,
 CASE o_orderkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'residential' WHEN 5 THEN 'service' END AS highway,
 CASE WHEN o_orderkey % 8 = 6 THEN 'water' END AS nat, CASE WHEN o_orderkey % 8 = 7 THEN 'forest' END AS landuse, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS oneway,
 CASE WHEN o_orderkey % 40 = 4 THEN 'roundabout' END AS junction, CASE WHEN o_orderkey % 3 = 0 THEN concat('WAY ', CAST(o_custkey AS VARCHAR(20))) END AS name FROM orders""",
    "relations": """SELECT from_way AS rel_id, from_way, via, CASE WHEN from_way % 15 = 0 THEN to_way + 1 ELSE to_way END AS to_way, CASE WHEN from_way % 2 = 0 THEN 'no_left_turn' ELSE 'only_right_turn' END AS restriction FROM (
 SELECT f.from_way, f.via, min(r.way_id) AS to_way FROM (SELECT way_id AS from_way, node_id AS via FROM way_refs WHERE pos = 0 AND way_id % 5 = 0) f
 JOIN way_refs r ON r.node_id = f.via AND r.way_id <> f.from_way AND r.pos = 0 GROUP BY f.from_way, f.via) t""",
    "address_points": """SELECT o_orderkey AS addr_id, -32.5e0 + CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 AS lat,
 115.5e0 + CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / 10009e0 AS lon,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 97 AS VARCHAR(20)) WHEN 1 THEN concat(CAST(o_orderkey % 97 AS VARCHAR(20)), '-', CAST(o_orderkey % 89 AS VARCHAR(20)))
 WHEN 2 THEN concat(CAST(o_orderkey % 97 AS VARCHAR(20)), 'A') WHEN 3 THEN concat(CAST(o_orderkey % 97 AS VARCHAR(20)), ' / ', CAST(o_orderkey % 89 AS VARCHAR(20)))
 WHEN 4 THEN 'LOT' ELSE '0' END AS house_number,
 concat(CASE WHEN o_orderkey % 2 = 0 THEN ' Street ' ELSE 'STREET ' END, CAST(o_custkey % 50 AS VARCHAR(20))) AS street_name, n_name AS city_name, 201 + n_regionkey AS suffix
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "failures": """SELECT event_id AS dump_row, event_type AS kind, CAST(user_id % 7 * 2 AS INT) AS level, CAST(user_id % 16 AS INT) AS ix, CAST(event_id % 16 AS INT) AS iy,
 CASE event_id % 4 WHEN 0 THEN 288 WHEN 1 THEN 291 WHEN 2 THEN 321 ELSE 578 END AS code, CAST(event_id % 11 AS INT) AS shape, CAST(event_id % 23 AS INT) AS vert,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS d_src, CAST(event_id % 2 AS INT) AS onb FROM events""",
    "area_parts": """SELECT way_id, z, k, j, CAST(floor(z * j / (k * 1e0)) AS INT) AS lo, CAST(floor(z * (j + 1) / (k * 1e0)) AS INT) AS hi FROM (
 SELECT g.way_id, max(g.pos) AS z, CAST(2 + g.way_id % 3 AS INT) AS k FROM geo_points g JOIN osm_ways w ON g.way_id = w.way_id WHERE w.highway IS NULL GROUP BY g.way_id HAVING max(g.pos) >= 4) b
 JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s ON s.j < b.k""",
    "area_corners": """SELECT g.way_id, CAST(g.pos AS INT) AS i, 3000000000 + g.way_id * 8 + g.pos AS node_id, c.lat + 4e-1 * (g.lat - c.lat) AS lat, c.lon + 4e-1 * (g.lon - c.lon) AS lon FROM geo_points g JOIN (
 SELECT a.way_id, (a.lat + b.lat + c.lat) / 3e0 AS lat, (a.lon + b.lon + c.lon) / 3e0 AS lon FROM geo_points a JOIN geo_points b ON b.way_id = a.way_id AND b.pos = 1 JOIN geo_points c ON c.way_id = a.way_id AND c.pos = 2 WHERE a.pos = 0 AND a.way_id % 3 = 0) c
 ON c.way_id = g.way_id WHERE g.pos <= 2""",
    "area_points": """SELECT way_id, pos, node_id, (lon - 115.5e0) * 64 AS x, (lat + 32.5e0) * 64 AS y FROM (
 SELECT p.way_id * 16 + p.j AS way_id, CAST(CASE WHEN (p.j + p.way_id) % 2 = 1 THEN p.hi - g.pos ELSE g.pos - p.lo END AS INT) AS pos, g.node_id, g.lat, g.lon FROM area_parts p JOIN geo_points g ON g.way_id = p.way_id WHERE g.pos BETWEEN p.lo AND p.hi
 UNION ALL SELECT p.way_id * 16 + 7 AS way_id, CAST(CASE WHEN g.pos = 0 THEN 1 ELSE 0 END AS INT) AS pos, g.node_id, g.lat, g.lon FROM area_parts p JOIN geo_points g ON g.way_id = p.way_id WHERE p.j = 0 AND (g.pos = 0 OR g.pos = p.z)
 UNION ALL SELECT p.way_id * 16 + 9 AS way_id, CAST(CASE WHEN g.pos = 0 THEN 0 ELSE 1 END AS INT) AS pos, g.node_id, g.lat, g.lon FROM area_parts p JOIN geo_points g ON g.way_id = p.way_id WHERE p.j = 0 AND (g.pos = 0 OR g.pos = p.hi)
 UNION ALL SELECT way_id * 16 + 10 AS way_id, i AS pos, node_id, lat, lon FROM area_corners
 UNION ALL SELECT way_id * 16 + 11 AS way_id, CAST(CASE WHEN i = 0 THEN 0 ELSE 1 END AS INT) AS pos, node_id, lat, lon FROM area_corners WHERE i <> 1) u""",
    "area_members": """SELECT way_id AS rel_id, CAST((j * 5 + way_id) % 7 AS BIGINT) AS seq, CASE WHEN j = 0 THEN '' ELSE 'outer' END AS role, CASE WHEN way_id % 19 = 0 AND j = 1 THEN 'r' ELSE 'w' END AS type, way_id * 16 + j AS way_id FROM area_parts
 UNION ALL SELECT way_id, CAST(7 AS BIGINT), 'outer', 'w', way_id * 16 + 7 FROM area_parts WHERE j = 0 AND way_id % 11 <> 0 UNION ALL SELECT way_id, CAST(9 AS BIGINT), 'outer', 'w', way_id * 16 + 9 FROM area_parts WHERE j = 0 AND way_id % 13 = 0
 UNION ALL SELECT way_id, CAST(10 AS BIGINT), 'inner', 'w', way_id * 16 + 10 FROM area_parts WHERE j = 0 AND way_id % 3 = 0 UNION ALL SELECT way_id, CAST(11 AS BIGINT), 'inner', 'w', way_id * 16 + 11 FROM area_parts WHERE j = 0 AND way_id % 3 = 0
 UNION ALL SELECT way_id, CAST(12 AS BIGINT), 'outer', 'w', way_id * 16 + 12 FROM area_parts WHERE j = 0 AND way_id % 17 = 0 UNION ALL SELECT way_id, CAST(13 AS BIGINT), 'label', 'n', way_id FROM area_parts WHERE j = 0""",
    "local_ways": """SELECT way_id, CAST(k AS INT) AS pos, x + k * (4e-1 + (way_id % 5) * 1e-1) AS x, y + k * ((way_id % 7) - 3) * 15e-2 + (k % 2) * 2e-1 AS y FROM (
 SELECT c_custkey AS way_id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 64e0 AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 64e0 AS y FROM customer) c
 JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s ON true""",
    "probe_lines": """SELECT s_suppkey AS line_id, w.pos, w.x + 3e-2 + (s_suppkey % 4) * 1e-1 AS x, w.y - 2e-2 AS y FROM supplier JOIN local_ways w ON w.way_id = s_suppkey * 7 + 3 WHERE w.pos <= 1 + s_suppkey % 3""",
    "overlay_links": """SELECT way_id * 64 + c AS link_id, CAST(c AS INT) AS cx, CAST(floor(first_value(y) OVER (PARTITION BY way_id, c ORDER BY pos) / 4e0) AS INT) AS cy, CAST(pos AS INT) AS pos, x, y FROM (
 SELECT way_id, CAST(floor(x / 4e0) AS BIGINT) AS c, pos * 2 AS pos, x, y FROM overlay_steps UNION ALL
 SELECT way_id, CAST(floor(x / 4e0) AS BIGINT) AS c, pos * 2 + 1 AS pos, floor(x2 / 4e0) * 4e0 - gap AS x, y + (y2 - y) * (floor(x2 / 4e0) * 4e0 - x) / (x2 - x) AS y FROM overlay_steps WHERE floor(x2 / 4e0) > floor(x / 4e0) UNION ALL
 SELECT way_id, CAST(floor(x2 / 4e0) AS BIGINT) AS c, pos * 2 + 1 AS pos, floor(x2 / 4e0) * 4e0 + gap AS x, y + (y2 - y) * (floor(x2 / 4e0) * 4e0 - x) / (x2 - x) AS y FROM overlay_steps WHERE floor(x2 / 4e0) > floor(x / 4e0)) t""",
    "overlay_steps": """SELECT way_id, pos, x, y, CASE WHEN way_id % 5 = 0 THEN 1e-2 ELSE 0e0 END AS gap, lead(x) OVER (PARTITION BY way_id ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY pos) AS y2 FROM (
 SELECT way_id, pos, x + 3e-2 + (way_id % 4) * 1e-1 AS x, y - 2e-2 - CASE WHEN way_id % 12 = 1 THEN 8e-1 ELSE 0e0 END AS y FROM local_ways WHERE way_id % 6 = 1) l""",
    "local_shapes": """SELECT shape_id, cell_x, cell_y, kind, k AS pos, CASE variant WHEN 2 THEN cx + (CASE k WHEN 0 THEN -s WHEN 1 THEN s WHEN 2 THEN s ELSE -s / 2 END) / 2 WHEN 3 THEN cx + m + (CASE k WHEN 0 THEN -s WHEN 1 THEN s WHEN 2 THEN s ELSE -s / 2 END)
 WHEN 1 THEN cx + (CASE k WHEN 2 THEN -s WHEN 1 THEN s WHEN 0 THEN s ELSE -s / 2 END) ELSE cx + (CASE k WHEN 0 THEN -s WHEN 1 THEN s WHEN 2 THEN s ELSE -s / 2 END) END AS x,
 CASE variant WHEN 2 THEN cy + (CASE k WHEN 0 THEN -s WHEN 1 THEN -s / 2 WHEN 2 THEN s ELSE s END) / 2 WHEN 1 THEN cy + (CASE k WHEN 2 THEN -s WHEN 1 THEN -s / 2 WHEN 0 THEN s ELSE s END) ELSE cy + (CASE k WHEN 0 THEN -s WHEN 1 THEN -s / 2 WHEN 2 THEN s ELSE s END) END AS y FROM (
 SELECT c_custkey AS shape_id, CAST(c_custkey % 4 AS INT) AS variant, CAST(g % 16 AS INT) AS cell_x, CAST((floor(g / 16e0) * 7 + g) % 64 AS INT) AS cell_y, CAST(g % 3 AS INT) AS kind, 20e0 + (g % 13) * 4e0 AS s, 3e2 + CAST((g * 31) % 3400 AS DOUBLE) AS cx,
 3e2 + CAST((g * 57) % 3400 AS DOUBLE) AS cy, CASE WHEN g % 5 = 0 THEN 2e2 ELSE 12e0 + g % 9 END AS m FROM (SELECT c_custkey, CAST(floor(c_custkey / 4e0) AS BIGINT) AS g FROM customer) b) c
 JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t ON true""",
    "town_ways": """SELECT c_custkey AS way_id, CASE WHEN c_custkey % 3 = 0 THEN 'secondary' ELSE 'residential' END AS highway, CASE WHEN c_custkey % 4 = 1 THEN 'yes' END AS oneway, CASE WHEN c_custkey % 10 = 0 THEN 'roundabout' END AS junction FROM customer""",
    "town_points": """SELECT way_id, pos, town * 1000 + i * 18 + j AS node_id, -32e0 + floor(i / 3e0) * 2e-3 + (i % 3) * 135e-6 AS lat, 115.5e0 + (town % 100) * 5e-2 + floor(j / 3e0) * 2e-3 + (j % 3) * 16e-5 AS lon, (i = 0 OR j = 0) AS edge FROM (
 SELECT c_custkey AS way_id, CAST(k AS INT) AS pos, CAST(floor(c_custkey / 100e0) AS BIGINT) AS town, (c_custkey * 5) % 14 + CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN k = 2 OR k = 3 THEN 1 ELSE 0 END WHEN c_custkey % 2 = 0 THEN k ELSE 0 END AS i,
 CAST(floor(c_custkey * 7 / 10e0) AS BIGINT) % 13 + CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN k = 1 OR k = 2 THEN 1 ELSE 0 END WHEN c_custkey % 2 = 0 THEN 0 ELSE k END AS j
 FROM customer JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s ON k < 4 OR c_custkey % 10 = 0) t""",
    "town_turns": """SELECT a.way_id * 8 + a.pos AS rel_id, a.node_id AS via, a.way_id AS from_way, min(b.way_id) AS to_way FROM town_points a JOIN town_points b ON b.node_id = a.node_id AND b.way_id <> a.way_id GROUP BY a.way_id, a.pos, a.node_id""",
    "grids": """SELECT CAST(l * 2 AS INT) AS level, CAST(k AS BIGINT) AS n FROM (SELECT 0 AS l, 64 AS k UNION ALL SELECT 1, 32 UNION ALL SELECT 2, 16
 UNION ALL SELECT 3, 8 UNION ALL SELECT 4, 4 UNION ALL SELECT 5, 2 UNION ALL SELECT 6, 1) t""",
}

#: The same rows as Spark makes them with less to shuffle. Rows of a way that are alike in line number and part are alike in what
#: way_refs shows, so no further column orders them. Nodes are met first, by a list of the places of each id, so that a way's
#: rows are brought together once, with their places; steps and points stay where their way is.
SPARK_VIEWS = {
    "way_lines": "SELECT l_orderkey AS way_id, l_linenumber AS line, l_partkey AS node_id FROM lineitem",
    "way_refs": "SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY line, node_id) - 1 AS INT) AS pos, node_id FROM way_lines",
    "geo_steps": """SELECT way_id, pos, node_id, at.lat AS lat, at.lon AS lon, lead(node_id) OVER w AS n2, lead(at.lat) OVER w AS lat2, lead(at.lon) OVER w AS lon2 FROM (SELECT way_id, pos, node_id, explode(places) AS at FROM (
 SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY line, node_id) - 1 AS INT) AS pos, node_id, places FROM way_lines
 LEFT JOIN (SELECT node_id AS id, collect_list(struct(lat, lon)) AS places FROM osm_nodes GROUP BY node_id) n ON id = node_id) o) s WINDOW w AS (PARTITION BY way_id ORDER BY pos)""",
    "geo_points": """SELECT way_id, p.pos, p.node_id, p.lat, p.lon FROM (SELECT way_id, explode(CASE WHEN n2 IS NULL THEN array(struct(CAST(pos * 2 AS INT) AS pos, node_id, lat, lon))
 ELSE array(struct(CAST(pos * 2 AS INT) AS pos, node_id, lat, lon), struct(CAST(pos * 2 + 1 AS INT) AS pos, 1000000000 + way_id * 64 + pos AS node_id, (lat + lat2) / 2e0 + 1e-3 AS lat, (lon + lon2) / 2e0 - 1e-3 AS lon)) END) AS p FROM geo_steps) t""",
}

#: In the order in which each may use those before it.
ORDER = ("osm_nodes", "way_lines", "way_refs", "geo_steps", "geo_points", "osm_ways", "relations", "area_parts", "area_corners", "area_points", "area_members", "local_ways", "probe_lines", "overlay_steps", "overlay_links", "local_shapes", "town_ways", "town_points", "town_turns", "address_points", "failures", "grids")


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A map table over the driver's tables in sf_dir, which are opened once for a session and folder. Tables `given` by their
    name, such as ones that are written already, stand for the views of that name."""
    known = _OPENED.setdefault(spark, {})
    if known.get("now") != sf_dir:
        if sf_dir not in known:
            known[sf_dir] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
        for t, df in known[sf_dir].items():
            df.createOrReplaceTempView(t)
        known["now"] = sf_dir
    sql = with_views("SELECT * FROM " + name, VIEWS | SPARK_VIEWS)
    for k, df in (given or {}).items():
        df.createOrReplaceTempView(f"given_{k}")
        sql = sql.replace(f"{k} AS ({(VIEWS | SPARK_VIEWS)[k]})", f"{k} AS (SELECT * FROM given_{k})")
    return spark.sql(sql)


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem", rows: int = 500_000) -> int:
    """Tasks that take about `rows` rows of a given table each, so what one task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/{name}.parquet").count() // rows))


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """sql with the views that it names, and those that they need, put before it."""
    need, text = [], sql
    for name in reversed(ORDER):
        if name in text:
            need.insert(0, name)
            text += views[name]
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in need)
    sql = sql.strip()
    if not ctes or sql[:5].upper() != "WITH ":
        return f"WITH {ctes}\n{sql}" if ctes else sql
    loop = "RECURSIVE " if sql[5:].upper().startswith("RECURSIVE ") else ""
    return f"WITH {loop}{ctes},\n{sql[5 + len(loop) :].lstrip()}"
