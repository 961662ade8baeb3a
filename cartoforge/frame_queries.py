"""Queries on frames of one or four slots a side and the nodes on their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import grid as G
from .operators import frames
from .queries import query
from .sources.adapters import view

_SPARSE = "level = 0 AND (floor(gx / 4e0) + floor(gy / 4e0)) % 3 <> 0"
# The same from the frames' rectangles: those that share a stretch of an edge, or that a corner point touches.
_FRAMES = f"""sl AS (SELECT DISTINCT level, CAST(floor((lon - 115.5e0) * n) AS BIGINT) AS gx, CAST(floor((lat + 32.5e0) * n) AS BIGINT) AS gy FROM osm_nodes, grids WHERE level <= 4),
fr AS (SELECT DISTINCT level, CASE WHEN {_SPARSE} THEN gx - gx % 4 ELSE gx END AS fx, CASE WHEN {_SPARSE} THEN gy - gy % 4 ELSE gy END AS fy, CAST(CASE WHEN {_SPARSE} THEN 4 ELSE 1 END AS BIGINT) AS n FROM sl),
bl AS (SELECT DISTINCT level, floor(fx / 8e0) AS bx, floor(fy / 8e0) AS b_y FROM fr)"""


def _near(places: str, touch: str, slots: str) -> str:
    """places: rows place, dx, dy; touch: whether b lies there; slots: condition that a slot (gx, gy) lies there."""
    return f"""pl AS (SELECT fr.*, place, dx, dy FROM fr, (VALUES {places}) t(place, dx, dy)),
hit AS (SELECT a.*, b.fx AS tx, b.fy AS ty, b.n AS tn FROM pl a JOIN fr b ON b.level = a.level AND (b.fx <> a.fx OR b.fy <> a.fy) AND {touch}),
res AS (SELECT level, fx, fy, n, place, 'resolved' AS status, tx, ty, tn, CASE WHEN floor(fx / 8e0) = floor(tx / 8e0) AND floor(fy / 8e0) = floor(ty / 8e0) THEN 'same_block' WHEN floor(fx / 16e0) = floor(tx / 16e0) AND floor(fy / 16e0) = floor(ty / 16e0) THEN 'cross_block' ELSE 'cross_blockset' END AS crossing FROM hit
 UNION ALL SELECT level, fx, fy, n, place, CASE WHEN EXISTS (SELECT 1 FROM bl, range(-1, 5) s(i), range(-1, 5) r(j) WHERE bl.level = a.level AND {slots} AND (i < 0 OR j < 0 OR i >= a.n OR j >= a.n) AND floor((a.fx + i) / 8e0) = bl.bx AND floor((a.fy + j) / 8e0) = bl.b_y) THEN 'empty_slot' ELSE 'outside_coverage' END, NULL, NULL, NULL, NULL
 FROM pl a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.level = a.level AND h.fx = a.fx AND h.fy = a.fy AND h.place = a.place))"""


_EDGE = _near(
    "('E', 1, 0), ('N', 0, 1), ('S', 0, -1), ('W', -1, 0)",
    "(dx = 1 AND b.fx = a.fx + a.n OR dx = -1 AND b.fx + b.n = a.fx OR dx = 0 AND b.fx < a.fx + a.n AND b.fx + b.n > a.fx) AND (dy = 1 AND b.fy = a.fy + a.n OR dy = -1 AND b.fy + b.n = a.fy OR dy = 0 AND b.fy < a.fy + a.n AND b.fy + b.n > a.fy)",
    "(dx = 1 AND i = a.n OR dx = -1 AND i = -1 OR dx = 0 AND i BETWEEN 0 AND a.n - 1) AND (dy = 1 AND j = a.n OR dy = -1 AND j = -1 OR dy = 0 AND j BETWEEN 0 AND a.n - 1)",
)
_CORNER = _near(
    "('NE', 1, 1), ('NW', 0, 1), ('SE', 1, 0), ('SW', 0, 0)",
    "a.fx + dx * a.n BETWEEN b.fx AND b.fx + b.n AND a.fy + dy * a.n BETWEEN b.fy AND b.fy + b.n",
    "i BETWEEN dx * a.n - 1 AND dx * a.n AND j BETWEEN dy * a.n - 1 AND dy * a.n",
)


def _frames(spark, d) -> DataFrame:
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids").where("level <= 4"))
    slots = p.select("level", F.floor((F.col("lon") - 115.5) * F.col("n")).alias("gx"), F.floor((F.col("lat") + 32.5) * F.col("n")).alias("gy")).distinct()
    return frames.frames_of(slots, F.when(F.expr(_SPARSE), 4).otherwise(1))


@query("j17_frame_neighbours", f"WITH {_FRAMES}, {_EDGE} SELECT * FROM res")
def j17_edges(spark, d):
    return frames.frame_neighbours(_frames(spark, d), 8, 2)


@query("j17_corner_frames", f"WITH {_FRAMES}, {_CORNER} SELECT * FROM res")
def j17_corners(spark, d):
    return frames.corner_frames(_frames(spark, d), 8, 2)


@query("a32_frame_crossings", f"WITH {_FRAMES}, {_EDGE} SELECT level, n, place, status, crossing, count(*) AS faced, count(DISTINCT (fx, fy)) AS frames FROM res GROUP BY ALL")
def a32_frames(spark, d):
    t = frames.frame_neighbours(_frames(spark, d), 8, 2)
    return t.groupBy("level", "n", "place", "status", "crossing").agg(F.count("*").alias("faced"), F.countDistinct("fx", "fy").alias("frames"))


@query("j18_frame_mirrors", f"""WITH {_FRAMES}, lp AS (SELECT DISTINCT level, node_id % 7 = 0 AS alone, CAST(round_even((lon - 115.5e0) * n * 8, 0) AS BIGINT) AS x, CAST(round_even((lat + 32.5e0) * n * 8, 0) AS BIGINT) AS y FROM osm_nodes, grids WHERE level <= 4),
nd AS (SELECT DISTINCT fr.*, x, y FROM lp JOIN fr ON fr.level = lp.level AND x BETWEEN fx * 8 AND (fx + n) * 8 AND y BETWEEN fy * 8 AND (fy + n) * 8 WHERE NOT alone OR x < (fx + n) * 8 AND y < (fy + n) * 8),
ed AS (SELECT *, (CASE WHEN y = (fy + n) * 8 THEN 'N' WHEN y = fy * 8 THEN 'S' ELSE '' END) || (CASE WHEN x = (fx + n) * 8 THEN 'E' WHEN x = fx * 8 THEN 'W' ELSE '' END) AS place FROM nd),
st AS (SELECT level, fx, fy, place, status FROM (WITH {_EDGE} SELECT * FROM res) t GROUP BY ALL UNION ALL SELECT level, fx, fy, place, status FROM (WITH {_CORNER} SELECT * FROM res) t GROUP BY ALL),
m AS (SELECT e.level, length(e.place) = 2 AS corner, status, CASE WHEN status = 'resolved' THEN EXISTS (SELECT 1 FROM nd o WHERE o.level = e.level AND o.x = e.x AND o.y = e.y AND (o.fx <> e.fx OR o.fy <> e.fy)) END AS mirrored FROM ed e JOIN st USING (level, fx, fy, place) WHERE e.place <> '')
SELECT level, corner, status, mirrored, count(*) AS nodes FROM m GROUP BY ALL""")
def j18_frames(spark, d):
    """Way nodes on a lattice of 8 units a slot; every 7th is held by the frame of its own slot alone."""
    f, at = _frames(spark, d), lambda c, o: F.rint((F.col(c) - o) * F.col("n") * 8).cast("long")
    p = G.with_levels(view(spark, d, "osm_nodes"), view(spark, d, "grids").where("level <= 4"))
    p = p.select("level", (F.col("node_id") % 7 == 0).alias("alone"), at("lon", 115.5).alias("x"), at("lat", -32.5).alias("y")).distinct()
    held = lambda c: F.explode(F.array_distinct(F.when(F.col("alone"), F.array(F.floor(F.col(c) / 8))).otherwise(F.array(F.floor(F.col(c) / 8), F.floor((F.col(c) - 1) / 8)))))
    p = p.withColumn("gx", held("x")).withColumn("gy", held("y"))
    nodes = p.join(frames.frame_slots(f), ["level", "gx", "gy"]).select(*frames.FRAME, "x", "y").distinct()
    m = frames.mirrored_nodes(nodes, f, 8, 8, 2).withColumn("corner", F.length("place") == 2)
    return m.groupBy("level", "corner", "status", "mirrored").agg(F.count("*").alias("nodes"))
