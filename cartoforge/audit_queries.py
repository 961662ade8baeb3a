"""Queries that compare, count and classify: profiles, orders, differences of two products, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import graph, reconcile, tiles
from .queries import _CAUSE, _G, _GRAPH, _KEYS, _R, RULES, _links, query
from .sources.adapters import view
from .sources.lineage import cut_lineage


def _failures(spark, d):
    return view(spark, d, "failures")


@query("a01_profile", """WITH r AS (SELECT level, vert, row_number() OVER (PARTITION BY level ORDER BY vert) - 1 AS k, count(*) OVER (PARTITION BY level) AS n FROM failures)
SELECT level, count(*) AS n, min(vert) AS least, max(vert) AS most, round(avg(vert), 6) AS mean, max(CASE WHEN k = CAST(round_even((n - 1) * 0.95e0, 0) AS BIGINT) THEN vert END) AS at_share FROM r GROUP BY level""")
def a01(spark, d):
    return reconcile.nearest_rank(_failures(spark, d), ["level"], "vert", 0.95).withColumn("mean", F.round("mean", 6))


@query("a01_histograms", "SELECT level, field, value, count(*) AS n FROM (SELECT level, 'vert' AS field, vert AS value FROM failures UNION ALL SELECT level, 'shape', shape FROM failures UNION ALL SELECT level, 'code', code FROM failures) t GROUP BY level, field, value")
def a01_histograms(spark, d):
    fields = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("vert", "shape", "code"))))
    return _failures(spark, d).select("level", fields).groupBy("level", "field", "value").agg(F.count("*").alias("n"))


@query("a03_envelope", f"""WITH r AS (SELECT level, kind, count(*) AS r FROM failures WHERE {_R} GROUP BY level, kind), g AS (SELECT level, kind, count(*) AS g FROM failures WHERE {_G} GROUP BY level, kind)
SELECT level, kind, coalesce(r, 0) AS r, coalesce(g, 0) AS g, CASE WHEN level = 0 THEN 'exempt' WHEN coalesce(r, 0) = 0 THEN CASE WHEN coalesce(g, 0) = 0 THEN 'in_range' ELSE 'out_of_range' END WHEN coalesce(g, 0) BETWEEN 0.5e0 * r AND 0.8e0 * r THEN 'in_range' ELSE 'out_of_range' END AS status FROM r FULL JOIN g USING (level, kind)""")
def a03(spark, d):
    f = _failures(spark, d)
    n = lambda where: f.where(where).groupBy(F.struct("level", "kind").alias("key")).agg(F.count("*").alias("n"))
    out = reconcile.compare_counts(n(_R), n(_G), "key", "n", 0.5, 0.8)
    return out.select("key.level", "key.kind", "r", "g", F.when(F.col("key.level") == 0, "exempt").otherwise(F.col("status")).alias("status"))


@query("a14_occupancy", f"""WITH r AS (SELECT DISTINCT level, ix, iy FROM failures WHERE {_R}), g AS (SELECT DISTINCT level, ix, iy FROM failures WHERE {_G}), b AS (SELECT level, ix, iy, r.level IS NOT NULL AS in_r, g.level IS NOT NULL AS in_g FROM r FULL JOIN g USING (level, ix, iy))
SELECT level, CAST(count_if(in_r AND in_g) AS BIGINT) AS n_both, CAST(count_if(in_r AND NOT in_g) AS BIGINT) AS r_only, CAST(count_if(in_g AND NOT in_r) AS BIGINT) AS g_only, round(count(*) / CAST((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) AS DOUBLE), 6) AS fill FROM b GROUP BY level""")
def a14(spark, d):
    f = _failures(spark, d)
    b = f.where(f"({_R}) or ({_G})").groupBy("level", "ix", "iy").agg(F.bool_or(F.expr(_R)).alias("r"), F.bool_or(F.expr(_G)).alias("g"))
    area = (F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)
    return b.groupBy("level").agg(F.count_if(F.col("r") & F.col("g")).alias("n_both"), F.count_if(F.col("r") & ~F.col("g")).alias("r_only"), F.count_if(F.col("g") & ~F.col("r")).alias("g_only"), F.round(F.count("*") / area, 6).alias("fill"))


@query("a15_shared_frames", "SELECT level, shape, count(DISTINCT (ix, iy)) AS n_cells, min(ix) AS ix_lo, max(ix) AS ix_hi, min(iy) AS iy_lo, max(iy) AS iy_hi FROM failures GROUP BY level, shape")
def a15(spark, d):
    cells = _failures(spark, d).select("level", "shape", "ix", "iy").distinct()
    return cells.groupBy("level", "shape").agg(F.count("*").alias("n_cells"), F.min("ix").alias("ix_lo"), F.max("ix").alias("ix_hi"), F.min("iy").alias("iy_lo"), F.max("iy").alias("iy_hi"))


_OLD, _NEW = "CASE WHEN vert >= 12 THEN 1 ELSE 2 END", "CASE WHEN shape >= 5 THEN 1 ELSE 2 END"
_NO_A, _NO_B = "CASE WHEN ix >= 8 THEN 1 ELSE 2 END", "CASE WHEN iy >= 8 THEN 1 ELSE 2 END"


@query("a30_transitions", f"""SELECT was, now, CASE WHEN x = was AND y = was THEN 'joint' WHEN x = was THEN 'x' WHEN y = was THEN 'y' ELSE 'none' END AS cause, count(*) AS n FROM (SELECT {_OLD} AS was, {_NEW} AS now, {_NO_A} AS x, {_NO_B} AS y FROM failures) t WHERE was <> now GROUP BY 1, 2, 3""")
def a30(spark, d):
    rows = _failures(spark, d).selectExpr(f"{_OLD} AS old", f"{_NEW} AS new", f"{_NO_A} AS without_x", f"{_NO_B} AS without_y")
    return reconcile.transitions(rows, "old", "new", {"x": "without_x", "y": "without_y"})


@query("a31_pooled", "SELECT kind, count(d_src) AS n, round(quantile_cont(d_src, 0.5e0), 6) AS median, round(quantile_cont(d_src, 0.9e0), 6) AS p90, bool_and(coalesce(d_src < 1e6, true)) AS all_near FROM failures GROUP BY kind")
def a31(spark, d):
    p = lambda q: F.round(F.percentile("d_src", F.lit(q)), 6)
    return _failures(spark, d).groupBy("kind").agg(F.count("d_src").alias("n"), p(0.5).alias("median"), p(0.9).alias("p90"), F.bool_and(F.coalesce(F.col("d_src") < 1e6, F.lit(True))).alias("all_near"))


@query("a34_slot_census", "SELECT level, n_slots, count(*) AS n_cells FROM (SELECT level, ix, iy, count(DISTINCT shape) AS n_slots FROM failures GROUP BY level, ix, iy) t GROUP BY level, n_slots")
def a34(spark, d):
    return _failures(spark, d).groupBy("level", "ix", "iy").agg(F.countDistinct("shape").alias("n_slots")).groupBy("level", "n_slots").agg(F.count("*").alias("n_cells"))


@query("w07_ceiling_by_kind", """SELECT level, kind, dump_row, size, sum(size) OVER (PARTITION BY level ORDER BY kind, dump_row ROWS UNBOUNDED PRECEDING) <= 2000 AS kept FROM (SELECT level, kind, dump_row, CAST(vert + 4 AS BIGINT) AS size FROM failures) t""")
def w07(spark, d):
    rows = _failures(spark, d).select("level", "kind", "dump_row", (F.col("vert") + 4).cast("long").alias("size"))
    return tiles.trimmed(rows, ["level"], [F.asc("kind"), F.asc("dump_row")], "size", 2000).select("level", "kind", "dump_row", "size", "kept")


@query("w09_candidate_orders", "SELECT level, candidate, CAST(sum(b) AS BIGINT) AS n_breaks, sum(b) = 0 AS is_monotonic FROM (" + " UNION ALL ".join(f"SELECT level, '{c}' AS candidate, CASE WHEN {c} < lag({c}) OVER (PARTITION BY level ORDER BY dump_row) THEN 1 ELSE 0 END AS b FROM failures" for c in ("dump_row", "ix", "iy", "code", "shape")) + ") t GROUP BY level, candidate")
def w09(spark, d):
    return reconcile.monotonic(_failures(spark, d), ["level"], ["dump_row"], ["dump_row", "ix", "iy", "code", "shape"])


@query("l02_largest_groups", f"SELECT {', '.join(_KEYS)}, n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_KEYS)} FROM failures) u) - 50 AS n_cut FROM (SELECT {', '.join(_KEYS)}, count(*) AS n FROM failures GROUP BY ALL) t ORDER BY n DESC, {', '.join(_KEYS)} LIMIT 50")
def l02(spark, d):
    groups = _failures(spark, d).groupBy(*_KEYS).agg(F.count("*").alias("n"))
    cut = groups.agg((F.count("*") - 50).alias("n_cut"))
    return groups.orderBy(F.desc("n"), *_KEYS).limit(50).crossJoin(F.broadcast(cut))


@query("u03_levels_of_both", f"SELECT DISTINCT level FROM (SELECT level FROM failures WHERE {_R} AND level <> 2 UNION ALL SELECT level FROM failures WHERE {_G} AND level <> 6) t")
def u03(spark, d):
    f = _failures(spark, d)
    return f.where(_R).where("level <> 2").select("level").union(f.where(_G).where("level <> 6").select("level")).distinct()


@query("u04_key_order", f"""WITH a AS (SELECT level, ix, min(dump_row) AS a_at FROM failures WHERE {_R} AND ix <> 3 GROUP BY level, ix), b AS (SELECT level, ix, min(dump_row) AS b_at FROM failures WHERE {_G} AND ix <> 5 GROUP BY level, ix),
s AS (SELECT level, ix, a_at, b_at, CASE WHEN b_at IS NULL THEN 'a only' WHEN a_at IS NULL THEN 'b only' ELSE 'both' END AS side FROM a FULL JOIN b USING (level, ix))
SELECT level, ix, side, CASE WHEN side = 'both' THEN row_number() OVER (PARTITION BY level, side ORDER BY a_at, ix) = row_number() OVER (PARTITION BY level, side ORDER BY b_at, ix) END AS same_place FROM s""")
def u04(spark, d):
    f = _failures(spark, d)
    first = lambda where, but: f.where(where).where(f"ix <> {but}").groupBy("level", "ix").agg(F.min("dump_row").alias("at"))
    return reconcile.key_order(first(_R, 3), first(_G, 5), ["level"], "ix", "at")


@query("u06_same_differences", f"""WITH a AS (SELECT level, ix, iy, sha256(CAST(sum(vert) AS VARCHAR)) AS digest FROM failures WHERE {_R} GROUP BY level, ix, iy), b AS (SELECT level, ix, iy, sha256(CAST(sum(vert) AS VARCHAR)) AS digest FROM failures WHERE {_G} GROUP BY level, ix, iy)
SELECT 'a' AS side, level, ix, iy, digest FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT 'b', level, ix, iy, digest FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y""")
def u06(spark, d):
    f = _failures(spark, d)
    digest = lambda where: f.where(where).groupBy("level", "ix", "iy").agg(F.sha2(F.sum("vert").cast("string"), 256).alias("digest"))
    return reconcile.one_sided(digest(_R), digest(_G), ["level", "ix", "iy", "digest"])


@query("u07_differing_ranges", """WITH a AS (SELECT kind, dump_row, vert FROM failures WHERE dump_row % 13 <> 0), b AS (SELECT kind, dump_row, CASE WHEN shape < 4 THEN vert ELSE vert + 1 END AS vert FROM failures WHERE dump_row % 17 <> 0),
x AS (SELECT kind, dump_row FROM (SELECT kind, dump_row, a.vert AS va, b.vert AS vb FROM a FULL JOIN b USING (kind, dump_row)) t WHERE va IS DISTINCT FROM vb)
SELECT kind, min(dump_row) AS run_lo, max(dump_row) AS run_hi, count(*) AS n FROM (SELECT kind, dump_row, dump_row - row_number() OVER (PARTITION BY kind ORDER BY dump_row) AS g FROM x) y GROUP BY kind, g""")
def u07(spark, d):
    f = _failures(spark, d)
    b = f.where("dump_row % 17 <> 0").select("kind", "dump_row", F.when(F.col("shape") < 4, F.col("vert")).otherwise(F.col("vert") + 1).alias("vert"))
    return reconcile.differing_ranges(f.where("dump_row % 13 <> 0"), b, ["kind"], "dump_row", "vert").select("kind", "run_lo", "run_hi", "n")


@query("q02_vocabulary_check", f"""WITH r AS (SELECT DISTINCT level, vert FROM failures WHERE {_R} AND vert <> 4), g AS (SELECT DISTINCT level, vert FROM failures WHERE {_G})
SELECT level, CAST(count_if(r.vert IS NULL) AS BIGINT) AS unknown, CASE WHEN count_if(r.vert IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g LEFT JOIN r USING (level, vert) GROUP BY level""")
def q02(spark, d):
    f = _failures(spark, d)
    g, r = f.where(_G).select("level", "vert").distinct(), f.where(_R).where("vert <> 4").select("level", "vert", F.lit(True).alias("known")).distinct()
    unknown = F.count_if(F.col("known").isNull())
    return g.join(r, ["level", "vert"], "left").groupBy("level").agg(unknown.alias("unknown"), F.when(unknown == 0, "PASS").otherwise("FAIL").alias("status"))


@query("q06_field_diff", f"""WITH a AS (SELECT dump_row, 'code' AS field, CAST(code AS VARCHAR) AS v FROM failures WHERE {_R} UNION ALL SELECT dump_row, 'shape', CAST(shape AS VARCHAR) FROM failures WHERE {_R}),
b AS (SELECT dump_row, 'code' AS field, CAST(CASE WHEN onb = 1 THEN code ELSE code + 1 END AS VARCHAR) AS v FROM failures WHERE {_G} UNION ALL SELECT dump_row, 'shape', CAST(CASE WHEN vert > 9 THEN shape ELSE 0 END AS VARCHAR) FROM failures WHERE {_G})
SELECT dump_row, field, a.v AS a_value, b.v AS b_value, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND field = 'shape' THEN 'allowed' ELSE 'violation' END AS verdict FROM a FULL JOIN b USING (dump_row, field) WHERE a.v IS DISTINCT FROM b.v""")
def q06(spark, d):
    f = _failures(spark, d)
    b = f.where(_G).select("dump_row", F.when(F.col("onb") == 1, F.col("code")).otherwise(F.col("code") + 1).alias("code"), F.when(F.col("vert") > 9, F.col("shape")).otherwise(0).alias("shape"))
    return reconcile.field_differences(f.where(_R), b, ["dump_row"], ["code", "shape"], ["shape"])


@query("q08_absent_layer", "SELECT level, CASE WHEN n = 0 THEN 'NA' WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT grids.level, count(dump_row) AS n, count_if(d_src IS NULL AND vert > 20) AS bad FROM grids LEFT JOIN (SELECT * FROM failures WHERE level <> 6) f ON f.level = grids.level GROUP BY grids.level) t")
def q08(spark, d):
    found = _failures(spark, d).where("level <> 6").groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("d_src").isNull() & (F.col("vert") > 20)).alias("bad"))
    return view(spark, d, "grids").select("level").join(found, "level", "left").select("level", F.when(F.col("n").isNull(), "NA").when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"))


@query("q10_steps", """WITH s AS (SELECT way_id, CAST(round_even((lon - 115.5e0) * 4096e0, 0) AS BIGINT) AS x, lag(CAST(round_even((lon - 115.5e0) * 4096e0, 0) AS BIGINT)) OVER (PARTITION BY way_id ORDER BY pos) AS x0 FROM geo_points)
SELECT way_id, CAST(count_if(x NOT BETWEEN 0 AND 4096) AS BIGINT) AS outside, CAST(count_if(abs(x - coalesce(x0, x)) > 127 * 8) AS BIGINT) AS long_steps FROM s GROUP BY way_id""")
def q10(spark, d):
    x = F.rint((F.col("lon") - 115.5) * 4096.0).cast("long")
    s = view(spark, d, "geo_points").select("way_id", x.alias("x"), F.lag(x).over(Window.partitionBy("way_id").orderBy("pos")).alias("x0"))
    return s.groupBy("way_id").agg(F.count_if(~F.col("x").between(0, 4096)).alias("outside"), F.count_if(F.abs(F.col("x") - F.col("x0")) > 127 * 8).alias("long_steps"))


@query("q16_continuity_verdict", """WITH a AS (SELECT level, ix, count(*) AS na FROM failures WHERE code = 288 GROUP BY level, ix), b AS (SELECT level, ix, count(*) AS nb FROM failures WHERE code = 321 GROUP BY level, ix),
m AS (SELECT level, CAST(sum(coalesce(na, 0)) AS BIGINT) AS n, CAST(sum(greatest(coalesce(na, 0) - coalesce(nb, 0), 0)) AS BIGINT) AS unmatched FROM a FULL JOIN b USING (level, ix) GROUP BY level)
SELECT level, n, unmatched, CASE WHEN unmatched = 0 THEN 'pass' WHEN unmatched <= 10 THEN 'pass_with_residual' ELSE 'fail' END AS verdict FROM m WHERE n > 0""")
def q16(spark, d):
    f = _failures(spark, d)
    a, b = f.where("code = 288").withColumnRenamed("dump_row", "a_id"), f.where("code = 321").withColumnRenamed("dump_row", "b_id")
    pairs = reconcile.pair_once(a, b, ["level", "ix"], "a_id", "b_id")
    left = a.join(pairs.select("a_id", F.lit(True).alias("paired")), "a_id", "left").groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("paired").isNull()).alias("unmatched"))
    return left.withColumn("verdict", F.when(F.col("unmatched") == 0, "pass").when(F.col("unmatched") <= 10, "pass_with_residual").otherwise("fail"))


@query("j36_row_identity", f"""WITH a AS (SELECT dump_row, level, ix, iy, {_CAUSE} AS was FROM failures), c AS (SELECT DISTINCT level, ix, iy FROM failures WHERE onb = 1 AND vert > 15)
SELECT dump_row, was, CASE WHEN onb = 1 THEN 4 ELSE 2 END AS now FROM a JOIN failures f USING (dump_row) WHERE EXISTS (SELECT 1 FROM c WHERE c.level = a.level AND c.ix = a.ix AND c.iy = a.iy) AND was IS DISTINCT FROM CASE WHEN onb = 1 THEN 4 ELSE 2 END""")
def j36(spark, d):
    f = reconcile.classify(_failures(spark, d), RULES).withColumn("now", F.when(F.col("onb") == 1, 4).otherwise(2))
    changed = f.where("onb = 1 and vert > 15").select("level", "ix", "iy").distinct()
    return f.join(changed, ["level", "ix", "iy"], "left_semi").where(~F.col("cause").eqNullSafe(F.col("now"))).select("dump_row", F.col("cause").alias("was"), "now")


@query("c06_residual_census", f"SELECT cause, kind, count(*) AS n, CAST(count_if(onb = 1) AS BIGINT) AS on_boundary FROM (SELECT *, {_CAUSE} AS cause FROM failures) t GROUP BY cause, kind")
def c06(spark, d):
    return reconcile.classify(_failures(spark, d), RULES).groupBy("cause", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("onb") == 1).alias("on_boundary"))


@query("c07_hypotheses", """SELECT level, ix, iy, CASE WHEN none = n THEN 'removed' WHEN far >= 0.5e0 * n THEN 'wrong producer' WHEN edge = n THEN 'extract defect' ELSE 'open' END AS hypothesis
 FROM (SELECT level, ix, iy, count(*) AS n, count_if(d_src IS NULL) AS none, count_if(d_src > 6e1) AS far, count_if(onb = 1) AS edge FROM failures GROUP BY level, ix, iy) t""")
def c07(spark, d):
    m = _failures(spark, d).groupBy("level", "ix", "iy").agg(F.count("*").alias("n"), F.count_if(F.col("d_src").isNull()).alias("none"), F.count_if(F.col("d_src") > 60.0).alias("far"), F.count_if(F.col("onb") == 1).alias("edge"))
    verdict = F.when(F.col("none") == F.col("n"), "removed").when(F.col("far") >= 0.5 * F.col("n"), "wrong producer").when(F.col("edge") == F.col("n"), "extract defect").otherwise("open")
    return m.select("level", "ix", "iy", verdict.alias("hypothesis"))


@query("c08_row_verdicts", """WITH i AS (SELECT dump_row, 'same' AS v FROM failures WHERE vert = shape), t AS (SELECT dump_row, 'tie' AS v FROM failures WHERE ix = iy)
SELECT dump_row, coalesce(i.v, t.v, 'undecided') AS verdict, CASE WHEN i.v IS NOT NULL THEN 'identity' WHEN t.v IS NOT NULL THEN 'ties' ELSE 'none' END AS source FROM failures LEFT JOIN i USING (dump_row) LEFT JOIN t USING (dump_row)""")
def c08(spark, d):
    f = _failures(spark, d)
    same = f.where("vert = shape").select("dump_row", F.lit("same").alias("verdict"))
    ties = f.where("ix = iy").select("dump_row", F.lit("tie").alias("verdict"))
    return reconcile.first_of(f.select("dump_row"), ["dump_row"], [("identity", same), ("ties", ties)], "undecided")


_COMPONENTS = f"""{_GRAPH}, e AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM lk WHERE length <= 15e3 AND road_class <= 1 UNION ALL SELECT v, u FROM lk WHERE length <= 15e3 AND road_class <= 1) t),
reach AS (SELECT u AS node_id, u AS label FROM e UNION SELECT e.v, r.label FROM reach r JOIN e ON e.u = r.node_id WHERE r.label < e.v), comp AS (SELECT node_id, min(label) AS label FROM reach GROUP BY node_id)"""


@query("r06_cluster_links", f"""WITH RECURSIVE {_COMPONENTS}, m AS (SELECT way_id, seg, forward, coalesce(a.label, u) AS cu, coalesce(b.label, v) AS cv FROM lk LEFT JOIN comp a ON a.node_id = u LEFT JOIN comp b ON b.node_id = v)
SELECT cu = cv AS internal, count(*) AS n, count(DISTINCT (cu, cv)) AS n_pairs FROM m GROUP BY 1""")
def r06(spark, d):
    links = cut_lineage(_links(spark, d))
    clusters = graph.components(links.where("length <= 15000 and road_class <= 1"))
    m = graph.collapse(links, clusters)
    return m.groupBy((F.col("cu") == F.col("cv")).alias("internal")).agg(F.count("*").alias("n"), F.countDistinct("cu", "cv").alias("n_pairs"))


@query("l04_cluster_members", f"""WITH RECURSIVE {_COMPONENTS}, g AS (SELECT u AS node_id, count(*) AS degree FROM lk GROUP BY u)
SELECT label, node_id, k FROM (SELECT label, node_id, row_number() OVER (PARTITION BY label ORDER BY coalesce(degree, 0) DESC, node_id) AS k FROM comp LEFT JOIN g USING (node_id)) t WHERE k <= 6""")
def l04(spark, d):
    links = cut_lineage(_links(spark, d))
    clusters = graph.components(links.where("length <= 15000 and road_class <= 1"))
    return graph.representatives(clusters, links, 6)
