"""Queries that meet a product's rings with the rings that they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import outlines
from .operators.multipolygon import clipped_to_cells
from .queries import query
from .ring_queries import _half_sql
from .sources.adapters import view

# Shapes over cells of 64 units, so that many cross an edge; the product is their clips on the lattice, some of them moved.
_AT = "CAST(floor(list_{m}(list_transform(v, lambda p: p.{a})) / 64e0) AS BIGINT)"
_PIECES = f"""sh AS (SELECT shape_id AS way_id, kind, list({{'x': cell_x * 512e0 + x / 8e0, 'y': cell_y * 512e0 + y / 8e0}} ORDER BY pos) AS v FROM local_shapes GROUP BY ALL),
rc AS (SELECT way_id, kind, cx, unnest(range({_AT.format(m='min', a='y')}, {_AT.format(m='max', a='y')} + 1)) AS cy, v FROM (SELECT way_id, kind, unnest(range({_AT.format(m='min', a='x')}, {_AT.format(m='max', a='x')} + 1)) AS cx, v FROM sh) t),
{_half_sql('rc', 'c1', 'x', '>=', '(cx * 64e0)')}, {_half_sql('c1', 'c2', 'x', '<=', '(cx * 64e0 + 64e0)')}, {_half_sql('c2', 'c3', 'y', '>=', '(cy * 64e0)')}, {_half_sql('c3', 'c4', 'y', '<=', '(cy * 64e0 + 64e0)')},
pv AS (SELECT way_id, kind, cx, cy, i, round_even(v[i].x, 0) + CASE WHEN way_id % 29 = 0 THEN 3 ELSE 0 END AS x, round_even(v[i].y, 0) - CASE WHEN way_id % 31 = 0 THEN 20 ELSE 0 END AS y FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM c4 WHERE len(v) >= 3) t),
pe AS (SELECT *, x = cx * 64 OR x = cx * 64 + 64 OR y = cy * 64 OR y = cy * 64 + 64 AS on_edge FROM pv)"""


def source_rings(spark, d) -> DataFrame:
    s = view(spark, d, "local_shapes").select("shape_id", "kind", "pos", (F.col("cell_x") * 512 + F.col("x") / 8).alias("x"), (F.col("cell_y") * 512 + F.col("y") / 8).alias("y"))
    v = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return s.groupBy("kind", F.col("shape_id").alias("ring")).agg(v.alias("v"))


def product_vertices(rings: DataFrame) -> DataFrame:
    """kind, id, cx, cy, x, y of clips on the lattice; every 29th and 31st shape is moved."""
    p = clipped_to_cells(rings, 64, -8, 1 << 20).select("kind", "ring", "cx", "cy", F.posexplode("v").alias("i", "p"))
    moved = lambda k, by: F.when(F.col("ring") % k == 0, by).otherwise(0)
    return p.select("kind", F.struct("ring", "cx", "cy", "i").alias("id"), "cx", "cy", (F.rint("p.x") + moved(29, 3)).alias("x"), (F.rint("p.y") - moved(31, 20)).alias("y"))


@query("q12_outline_round_trip", f"""WITH {_PIECES}, e AS (SELECT way_id, kind, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM (SELECT way_id, kind, v[CASE WHEN i = 1 THEN len(v) ELSE i - 1 END] AS p, v[i] AS q FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM sh) t) u),
g AS (SELECT p.way_id, p.kind, p.cx, p.cy, p.i, p.x, p.y, on_edge, e.way_id AS ring, x1, y1, x2, y2, greatest(0e0, least(1e0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM pe p JOIN e ON e.kind = p.kind AND abs(e.x1 - p.x) <= 64 AND abs(e.y1 - p.y) <= 64),
n AS (SELECT way_id, kind, cx, cy, i, min(greatest(abs(x - (x1 + t * (x2 - x1))), abs(y - (y1 + t * (y2 - y1))))) AS d FROM g GROUP BY ALL),
h AS (SELECT DISTINCT way_id, kind, cx, cy, i FROM (SELECT way_id, kind, cx, cy, i, ring FROM g WHERE on_edge AND (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1) t),
r AS (SELECT pe.kind, on_edge, CASE WHEN d <= 0.500001e0 THEN d END AS d, h.way_id IS NOT NULL AND NOT coalesce(d <= 0.500001e0, false) AS inside FROM pe LEFT JOIN n USING (way_id, kind, cx, cy, i) LEFT JOIN h USING (way_id, kind, cx, cy, i))
SELECT kind, on_edge, count(*) AS checked, count(*) FILTER (WHERE d IS NULL AND NOT inside) AS failing, count(*) FILTER (WHERE inside) AS by_inside, round(max(d), 6) AS worst FROM r GROUP BY kind, on_edge""")
def q12(spark, d):
    rings = source_rings(spark, d)
    side = lambda c, k: (F.col(c) == F.col(k) * 64) | (F.col(c) == F.col(k) * 64 + 64)
    return outlines.outline_summary(outlines.outline_check(product_vertices(rings), rings, ["kind"], side("x", "cx") | side("y", "cy"), 0.500001, 16.0), ["kind"])
