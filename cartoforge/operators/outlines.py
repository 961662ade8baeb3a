"""A product's vertices against the outlines and the insides of the rings that they should come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.grid import segment_chebyshev
from .spatial import buckets


def ring_edges(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ring, x1, y1, x2, y2 of every edge of rings (keys, ring, v: the first vertex not repeated)."""
    e = rings.select(*keys, "ring", F.explode(F.arrays_zip(F.concat(F.slice("v", -1, 1), F.slice("v", F.lit(1), F.size("v") - 1)).alias("p"), F.col("v").alias("q"))).alias("e"))
    return e.select(*keys, "ring", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def passed_buckets(segs: DataFrame, within: float, bucket: float) -> DataFrame:
    """segs (x1, y1, x2, y2, ...) in every bucket (bx, by) that they pass at most `within` away: for each column of x, the rows of
    the part there. A long edge makes rows by its length, not by the area of its box."""
    s = buckets(segs, F.least("x1", "x2") - within, F.greatest("x1", "x2") + within, bucket, "bx")
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / (F.col("x2") - F.col("x1"))))
    y_at = lambda x: F.when(F.col("x1") != F.col("x2"), F.col("y1") + (F.col("y2") - F.col("y1")) * share(x))
    a, b = y_at(F.col("bx") * bucket - within), y_at((F.col("bx") + 1) * bucket + within)
    s = s.withColumn("_a", F.coalesce(a, "y1")).withColumn("_b", F.coalesce(b, "y2"))
    return buckets(s, F.least("_a", "_b") - within, F.greatest("_a", "_b") + within, bucket, "by").drop("_a", "_b")


def outline_check(vertices: DataFrame, rings: DataFrame, keys: Sequence[str], edge: Column, tolerance: float, bucket: float) -> DataFrame:
    """vertices (keys, id, x, y, ...) with on_edge, distance, inside and ok, against rings (keys, ring, v) of the same keys.

    distance: Chebyshev, from the nearest outline; null beyond the tolerance. A vertex that `edge` marks, one on its cell's edge,
    is ok too if it lies inside a ring, even-odd: the corner of a cell that a ring covers lies on no outline. inside is worked out
    for those alone, so it is false elsewhere. Other vertices are ok on an outline only. id is unique for its keys; null keys meet
    nothing and no rings make every vertex wrong.

    Edges and vertices meet in buckets; a ring's inside is asked where its box holds the vertex, by bands of its own edges, so no
    ring is carried whole and none is compared with all vertices.
    """
    by, e = [*keys, "bx", "by"], ring_edges(rings, keys)
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    v = vertices.select(*keys, "id", F.col("x").alias("px"), F.col("y").alias("py"), edge.alias("on_edge")).withColumn("bx", at("px")).withColumn("by", at("py"))
    d = segment_chebyshev(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    near = v.join(passed_buckets(e, tolerance, bucket), by).select(*keys, "id", d.alias("d")).where(F.col("d") <= tolerance).groupBy(*keys, "id").agg(F.min("d").alias("distance"))
    open_ = v.where("on_edge").join(near, [*keys, "id"], "left_anti")
    box = R.box(F.col("v"))
    boxes = rings.select(*keys, "ring", *(c.alias(k) for k, c in box.items()))
    boxes = buckets(buckets(boxes, F.col("x_lo"), F.col("x_hi"), bucket, "bx"), F.col("y_lo"), F.col("y_hi"), bucket, "by")
    asked = open_.join(boxes, by).where("px between x_lo and x_hi and py between y_lo and y_hi").select(*keys, "id", "ring", "px", "py", F.col("by").alias("band"))
    bands = buckets(e, F.least("y1", "y2"), F.greatest("y1", "y2"), bucket, "band")
    across = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    odd = asked.join(bands, [*keys, "ring", "band"]).where(across).groupBy(*keys, "id", "ring").agg(F.count("*").alias("k")).where("k % 2 = 1")
    held = odd.select(*keys, "id").distinct().withColumn("_in", F.lit(True))
    out = vertices.withColumn("on_edge", edge).join(near, [*keys, "id"], "left").join(held, [*keys, "id"], "left")
    return out.withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in").withColumn("ok", F.col("distance").isNotNull() | F.col("inside"))


def outline_summary(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, on_edge, checked, failing, by_inside, worst of outline_check(): by_inside are ok by a ring's inside alone, worst is the
    largest distance that passed."""
    return checked.groupBy(*keys, "on_edge").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failing"), F.count_if("inside").alias("by_inside"), F.round(F.max("distance"), 6).alias("worst"))
