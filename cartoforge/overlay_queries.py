"""Queries that lay a product's links over the source's ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from .area_queries import _MATCHED, _dense
from .operators import overlay
from .queries import query
from .sources.adapters import view

_OVER = _MATCHED.replace("probe_lines", "overlay_links").replace("line_id", "link_id")
_OVERLAY = f"""{_OVER}, lk AS (SELECT DISTINCT link_id, cx, cy FROM overlay_links), bd AS (SELECT link_id, min(distance) AS distance FROM md GROUP BY link_id),
ds AS (SELECT cx, cy, count(*) AS links, avg(CASE WHEN distance <= 0.35 THEN 1e0 ELSE 0e0 END) AS matched_fraction, quantile_cont(distance, 0.5) AS distance_p50, quantile_cont(distance, 0.9) AS distance_p90 FROM lk LEFT JOIN bd USING (link_id) GROUP BY ALL),
ee AS (SELECT cx, cy, least(x - cx * 4e0, y - cy * 4e0, 4e0 - (x - cx * 4e0), 4e0 - (y - cy * 4e0)) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY link_id ORDER BY pos DESC) AS b FROM overlay_links) t JOIN (VALUES (1), (2)) s(e) ON e = 1 AND a = 1 OR e = 2 AND b = 1),
ec AS (SELECT cx, cy, count(*) FILTER (WHERE gap <= 0.02) AS ends, count(*) FILTER (WHERE gap = 0) AS exact FROM ee GROUP BY ALL),
pc AS (SELECT cx, cy, max(greatest((x - cx * 4e0) / 4e0, (y - cy * 4e0) / 4e0)) AS reach, avg(CASE WHEN (x - cx * 4e0) / 4e0 BETWEEN -1e-9 AND 1.000000001e0 AND (y - cy * 4e0) / 4e0 BETWEEN -1e-9 AND 1.000000001e0 THEN 1e0 ELSE 0e0 END) AS inside FROM overlay_links GROUP BY ALL),
lq AS ({_dense('overlay_links', 'link_id', '0.0625e0')}), wq AS ({_dense('local_ways', 'way_id', '0.0625e0')}),
lo AS (SELECT cx, cy, count(DISTINCT (least(floor((x - cx * 4e0) / 4e0 * 16), 15), least(floor((y - cy * 4e0) / 4e0 * 16), 15))) / 256e0 AS occupied_links FROM lq JOIN lk USING (link_id) WHERE x BETWEEN cx * 4e0 AND cx * 4e0 + 4 AND y BETWEEN cy * 4e0 AND cy * 4e0 + 4 GROUP BY cx, cy),
wo AS (SELECT floor(x / 4e0) AS cx, floor(y / 4e0) AS cy, count(DISTINCT (floor(x * 4), floor(y * 4))) / 256e0 AS occupied_ways FROM wq GROUP BY ALL),
ov AS (SELECT ds.*, ends, exact, reach, inside, coalesce(occupied_links, 0e0) AS occupied_links, coalesce(occupied_ways, 0e0) AS occupied_ways FROM ds JOIN ec USING (cx, cy) JOIN pc USING (cx, cy) LEFT JOIN lo USING (cx, cy) LEFT JOIN wo USING (cx, cy)),
ok AS (SELECT *, exact / nullif(ends, 0) AS clip_share, occupied_links / nullif(occupied_ways, 0e0) AS occupied_ratio FROM ov)"""
_FIGURES = ["matched_fraction", "distance_p50", "distance_p90", "clip_share", "reach", "inside", "occupied_links", "occupied_ways", "occupied_ratio"]


@query("q19_overlay", f"""WITH {_OVERLAY} SELECT cx, cy, links, ends, exact, {', '.join(f'round({c}, 5) AS {c}' for c in _FIGURES)}, matched_fraction >= 0.8 AS within_tolerance, coalesce(clip_share >= 0.9, false) AS clipped_at_edge, reach BETWEEN 0.9 AND 1.000000001e0 AS coord_max,
 coalesce(occupied_ratio >= 0.5, false) AS no_clustering, matched_fraction >= 0.8 AND coalesce(clip_share >= 0.9, false) AND reach BETWEEN 0.9 AND 1.000000001e0 AND coalesce(occupied_ratio >= 0.5, false) AS passed FROM ok""")
def q19(spark, d):
    got = overlay.criteria(overlay.overlay(view(spark, d, "overlay_links"), view(spark, d, "local_ways"), 4.0, 0.35, 0.1))
    for c in _FIGURES:
        got = got.withColumn(c, F.round(c, 5))
    return got
