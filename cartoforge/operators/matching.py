"""Which way a line follows, and how two polygons of a cell lie to each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.grid import segment_distance
from ..sources.lineage import cut_lineage, drop_tables
from .spatial import buckets, worked_out


def densified(lines: DataFrame, key: str, spacing: float) -> DataFrame:
    """key, n, i, x, y: points along lines (key, pos, x, y), about `spacing` apart, all vertices among them; n of them, i from 0."""
    w = Window.partitionBy(key).orderBy("pos")
    s = lines.select(key, "pos", "x", "y", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"))
    k = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))) / spacing)).cast("int")
    t = F.col("_t") / F.col("_k")
    p = s.withColumn("_k", F.when(F.col("x0").isNull(), F.lit(1)).otherwise(k)).withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    at = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    p = p.select(key, "pos", "_t", at("x0", "x").alias("x"), at("y0", "y").alias("y"))
    order = Window.partitionBy(key).orderBy("pos", "_t")
    return p.select(key, F.count("*").over(Window.partitionBy(key)).alias("n"), (F.row_number().over(order) - 1).alias("i"), "x", "y")


def spread_samples(points: DataFrame, most: int) -> DataFrame:
    """Of densified() points, `most` of each line at even steps from its first to its last; all, if there are no more."""
    step = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    key, long = points.columns[0], points.where(F.col("n") > most)
    wanted = long.where("i = 0").select(key, "n", step.alias("j")).select(key, F.floor(F.col("j") * (F.col("n") - 1) / (most - 1)).cast("int").alias("i")).distinct()
    return points.where(F.col("n") <= most).unionByName(long.join(wanted, [key, "i"]).select(*points.columns))


def _reach(cloud: DataFrame, start: float, crowd: float = 8.0) -> float:
    """`start`, or less where points lie closer: so much that a point shares its bucket, twice as wide, with `crowd` others about."""
    reach = start
    for _ in range(8):
        at = lambda c: F.floor(F.col(c) / (2 * reach))  # noqa: B023, E731
        n = cloud.groupBy(at("wx").alias("bx"), at("wy").alias("by")).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if n is None or n <= 2 * crowd:
            break
        reach *= (crowd / n) ** 0.5
    return reach


def nearest(samples: DataFrame, key: str, cloud: DataFrame, start: float, grow: float = 4.0, limit: float | None = None) -> DataFrame:
    """key, i, d (squared distance), near: the way with the nearest point of each sample (key, i, x, y; a table that is there, as
    each round reads it), the smaller id at a tie. cloud: way_id, x, y. Samples with none within `limit` are left out.

    Samples look in the buckets around them, `start` wide or less, by how close the points lie; those that find nothing within
    that reach look again in wider ones. So every sample finds its way, whatever the distance, few samples ever meet a wide bucket,
    and the pairs looked at grow with the samples, not with samples times points.
    """
    left, none = samples, f"{key} {dict(samples.dtypes)[key]}, i int, d double, near {dict(cloud.dtypes)['way_id']}"
    w = cut_lineage(cloud.groupBy(F.col("x").alias("wx"), F.col("y").alias("wy")).agg(F.min("way_id").alias("near")))
    if not w.limit(1).count():
        return samples.sparkSession.createDataFrame([], none)
    reach, found = _reach(w, start if limit is None else min(start, limit)), []
    while left.limit(1).count():
        p = buckets(buckets(left, F.col("x") - reach, F.col("x") + reach, 2 * reach, "bx"), F.col("y") - reach, F.col("y") + reach, 2 * reach, "by")
        t = w.withColumn("bx", F.floor(F.col("wx") / (2 * reach)).cast("long")).withColumn("by", F.floor(F.col("wy") / (2 * reach)).cast("long"))
        d = (F.col("x") - F.col("wx")) * (F.col("x") - F.col("wx")) + (F.col("y") - F.col("wy")) * (F.col("y") - F.col("wy"))
        got = cut_lineage(p.join(t, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= reach * reach).groupBy(key, "i").agg(F.min(F.struct("d", "near")).alias("b")).select(key, "i", "b.d", "b.near"))
        found.append(got)
        if reach == limit:
            break
        rest = cut_lineage(left.join(got, [key, "i"], "left_anti"))
        if left is not samples:
            drop_tables(left)
        left, reach = rest, reach * grow if limit is None else min(reach * grow, limit)
    drop_tables(w, *([left] if left is not samples else []))
    out = found[0] if found else samples.sparkSession.createDataFrame([], none)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def nearest_way(samples: DataFrame, key: str, ways: DataFrame, start: float, grow: float = 4.0) -> DataFrame:
    """key, i, way_id: the way with the nearest point of each sample, as of nearest()."""
    return nearest(samples, key, ways, start, grow).select(key, "i", F.col("near").alias("way_id"))


def matched_ways(lines: DataFrame, ways: DataFrame, key: str, spacing: float, most: int = 40, top: int = 3) -> DataFrame:
    """key, way_id, votes, distance: the way that each line (key, pos, x, y) follows best. ways: way_id, pos, x, y.

    `most` points at most, spread evenly over the line's points `spacing` apart, vote for the way nearest to them. Of the `top`
    ways with most votes (the smaller id first) the one with the lowest median distance from all the line's points wins.
    """
    points = cut_lineage(densified(lines, key, spacing))
    cloud = cut_lineage(densified(ways, "way_id", spacing))
    votes = nearest_way(cut_lineage(spread_samples(points, most)), key, cloud, 2 * spacing).groupBy(key, "way_id").agg(F.count("*").alias("votes"))
    best = Window.partitionBy(key).orderBy(F.desc("votes"), "way_id")
    few = cut_lineage(votes.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= top).drop("_k"))
    w = Window.partitionBy("way_id").orderBy("pos")
    segs = ways.select("way_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.count("*").over(Window.partitionBy("way_id")).alias("m"))
    segs = segs.where("x2 is not null or m = 1").withColumn("x2", F.coalesce("x2", "x1")).withColumn("y2", F.coalesce("y2", "y1"))
    whole = segs.groupBy("way_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("segs"))
    d = F.array_min(F.transform("segs", lambda s: segment_distance(F.col("x"), F.col("y"), s["x1"], s["y1"], s["x2"], s["y2"])))
    per = few.join(whole, "way_id").join(points.select(key, "i", "x", "y"), key).select(key, "way_id", "votes", d.alias("d"))
    median = per.groupBy(key, "way_id", "votes").agg(F.percentile("d", F.lit(0.5)).alias("distance"))
    won = median.groupBy(key).agg(F.min(F.struct("distance", "way_id", "votes")).alias("b"))
    return won.select(key, "b.way_id", "b.votes", "b.distance")


def unmatched_ways(ways: DataFrame, links: DataFrame, limit: float, spacing: float, most: int = 24) -> DataFrame:
    """way_id, samples, unmatched of each way (way_id, pos, x, y): unmatched if the median distance of its `most` samples at most
    from the nearest of the other product's points (links: way_id, pos, x, y, `spacing` apart) is over `limit`.

    A sample looks no farther than twice the limit: the median of an even number is the mean of the two in the middle, so one
    that lies beyond makes it too large whatever it is. Every way is unmatched where there are no links.
    """
    reach, far = 2 * limit, 1e300
    s = cut_lineage(spread_samples(densified(ways, "way_id", spacing), most).select("way_id", "i", "x", "y"))
    met = nearest(s, "way_id", densified(links, "way_id", spacing).withColumn("way_id", F.lit(0)), spacing, limit=reach).select("way_id", "i", F.sqrt("d").alias("d"))
    median = F.percentile(F.coalesce("d", F.lit(far)), 0.5)
    return s.join(met, ["way_id", "i"], "left").groupBy("way_id").agg(F.count("*").alias("samples"), (median > limit).alias("unmatched"))


def disagreement(unmatched: DataFrame) -> DataFrame:
    """ways, unmatched, share of unmatched_ways(); share is null where there are none."""
    n = F.count_if("unmatched")
    return unmatched.agg(F.count("*").alias("ways"), n.alias("unmatched"), F.when(F.count("*") > 0, F.round(n / F.count("*"), 4)).alias("share"))


def gap(v: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a ring's boundary."""
    after = lambda i: F.element_at(v, F.when(i == F.size(v), F.lit(1)).otherwise(i + 1))
    return F.array_min(F.transform(R.places(v), lambda i: segment_distance(x, y, F.element_at(v, i)["x"], F.element_at(v, i)["y"], after(i)["x"], after(i)["y"])))


def _holds(rings: pa.Array, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Which points of a row lie inside the row's ring, as R.holds says."""
    sizes = rings.value_lengths().to_numpy()
    x, y = (c.to_numpy(zero_copy_only=False) for c in rings.flatten().flatten())
    start, out = np.cumsum(sizes) - sizes, np.zeros(px.shape, bool)
    with np.errstate(all="ignore"):
        for i in range(int(sizes.max(initial=0))):  # rows of fewer vertices stay on their last one, an edge that crosses nothing
            q, p = start + np.minimum(i, sizes - 1), start + np.where(i == 0, sizes, np.minimum(i, sizes)) - 1
            p = np.where(i < sizes, p, q)
            (px_, py_), (qx, qy) = ((x[k][:, None], y[k][:, None]) for k in (p, q))
            out ^= ((py_ > py) != (qy > py)) & (px < px_ + (py - py_) * (qx - px_) / (qy - py_))
    return out & (sizes >= 3)[:, None]


def _sampled(kept: list[str], grid: int):
    """Adds area to pairs without a relation: the points of a lattice over the smaller ring's box that lie in both rings."""

    def run(batches):
        k = np.arange(grid * grid)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                open_ = batch.column("relation").is_null()
                some = batch.filter(open_)
                area = np.zeros(batch.num_rows)
                if some.num_rows:
                    sx, sy, dx, dy = (some.column(c).to_numpy()[:, None] for c in ("s_x", "s_y", "s_dx", "s_dy"))
                    px, py = sx + (k % grid + 0.5) * dx, sy + (k // grid + 0.5) * dy
                    hits = (_holds(some.column("a_v"), px, py) & _holds(some.column("b_v"), px, py)).sum(1)
                    area[open_.to_numpy(zero_copy_only=False)] = hits * dx[:, 0] * dy[:, 0]
                area = pa.array(area, mask=~open_.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), area], [*kept, "area"])

    return run


def polygon_pairs(shapes: DataFrame, keys: list[str], bucket: float, tolerance: float = 1.0, grid: int = 24, share: float = 0.01) -> DataFrame:
    """keys, a, b, relation, area of pairs of shapes (keys, id, v: ring without its first vertex repeated) that share their keys.

    equal: the same ring up to its first vertex and its direction. contains, inside: every vertex of one lies in the other or
    within `tolerance` of its boundary, and none of the other's lies deeper than that in the first. overlaps: neither, a vertex
    of one lies deeper than that in the other, and the area they share, sampled on a grid x grid lattice over the smaller one's
    box, is at least tolerance squared and `share` of the smaller one. Other pairs are left out. area is the sampled one, null
    but for overlaps.

    Pairs come from the buckets that both boxes (grown by the tolerance) meet, each pair once, in that of their common corner.
    """
    b = R.box(F.col("v"))
    known = F.struct(*(c.alias(k) for k, c in b.items()), F.abs(R.area(F.col("v"))).alias("area"), F.sha2(R.canonical(F.col("v")).cast("string"), 256).alias("mark"))
    t = worked_out(shapes.select(*keys, "id", "v"), "of", known).select(*keys, "id", "v", "of.*")
    t = t.withColumn("x_lo", F.col("x_lo") - tolerance).withColumn("y_lo", F.col("y_lo") - tolerance)
    dealt = buckets(buckets(t, F.col("x_lo"), F.col("x_hi"), bucket, "bx"), F.col("y_lo"), F.col("y_hi"), bucket, "by")
    one = lambda p: dealt.select(*keys, "bx", "by", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "v", "x_lo", "x_hi", "y_lo", "y_hi", "area", "mark")))
    x, y = F.greatest("a_x_lo", "b_x_lo"), F.greatest("a_y_lo", "b_y_lo")
    meet = (F.col("a_id") < F.col("b_id")) & (x <= F.least("a_x_hi", "b_x_hi")) & (y <= F.least("a_y_hi", "b_y_hi")) & (F.floor(x / bucket) == F.col("bx")) & (F.floor(y / bucket) == F.col("by"))
    pairs = one("a").join(one("b"), [*keys, "bx", "by"]).where(meet)

    def within(p: str, q: str) -> Column:
        v = F.col(f"{q}_v")
        return F.forall(f"{p}_v", lambda c: R.holds(v, c["x"], c["y"]) | (gap(v, c["x"], c["y"]) <= tolerance))

    def deep(p: str, q: str) -> Column:
        v = F.col(f"{q}_v")
        return F.exists(f"{p}_v", lambda c: R.holds(v, c["x"], c["y"]) & (gap(v, c["x"], c["y"]) > tolerance))

    same = F.col("a_mark") == F.col("b_mark")
    sides = F.struct(same.alias("same"), within("a", "b").alias("a_in"), within("b", "a").alias("b_in"), deep("a", "b").alias("a_deep"), deep("b", "a").alias("b_deep"))
    pairs = worked_out(pairs, "sides", sides).select(*keys, "a_id", "b_id", "a_v", "b_v", "a_area", "b_area", "sides.*")
    small = F.when(F.col("a_area") <= F.col("b_area"), F.col("a_v")).otherwise(F.col("b_v"))
    sb = R.box(F.col("small"))
    known = F.when(F.col("same"), "equal").when(F.col("b_in") & ~F.col("a_deep"), "contains").when(F.col("a_in") & ~F.col("b_deep"), "inside")
    pairs = pairs.withColumn("relation", known).where("relation is not null or a_deep or b_deep").withColumn("small", small)
    pairs = cut_lineage(pairs).withColumn("s_x", sb["x_lo"]).withColumn("s_y", sb["y_lo"]).withColumn("s_dx", (sb["x_hi"] - sb["x_lo"]) / grid).withColumn("s_dy", (sb["y_hi"] - sb["y_lo"]) / grid)
    kept = pairs.select(*keys, "a_id", "b_id", "a_area", "b_area", "relation").schema.add("area", "double")
    pairs = pairs.select(*kept.names[:-1], "a_v", "b_v", "s_x", "s_y", "s_dx", "s_dy").mapInArrow(_sampled(kept.names[:-1], grid), kept)
    enough = F.col("area") >= F.greatest(F.lit(tolerance * tolerance), share * F.least("a_area", "b_area"))
    out = pairs.withColumn("relation", F.coalesce("relation", F.when(enough, "overlaps"))).where("relation is not null")
    return out.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "relation", F.when(F.col("relation") == "overlaps", F.col("area")).alias("area"))
