"""How many rings hold each point, without a row for every pair of a point and a ring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut_lineage
from .spatial import buckets

#: Rings that a task holds about, rings worked out at a time, and points of a row that are tested one by one.
_RINGS, _BLOCK, _FEW = 65_536, 8_192, 3


def _sorted_down(pos: np.ndarray) -> np.ndarray:
    """Every column of a few rows in order, by an exchange of neighbours in each of as many rounds."""
    for k in range(len(pos)):
        a, b = pos[k % 2 : len(pos) - 1 : 2], pos[k % 2 + 1 :: 2]
        low = np.minimum(a, b)
        np.maximum(a, b, out=b)
        a[:] = low
    return pos


def _row_counts(px, py, qx, qy, y: float, xs: np.ndarray) -> np.ndarray:
    """For the points (xs in order, y): how many rings hold each. Column k of the arrays has the edges p to q of ring k."""
    e = np.flatnonzero((py > y) != (qy > y))
    a, b, c, d = (v.ravel()[e] for v in (px, py, qx, qy))
    at = a + (y - b) * (c - a) / (d - b)
    if len(xs) <= _FEW:
        out = np.zeros(len(xs), np.int64)
        for i, x in enumerate(xs):
            right = np.zeros(px.shape, bool)
            right.ravel()[e] = x < at
            out[i] = np.count_nonzero(np.logical_xor.reduce(right))
        return out
    pos = np.zeros(px.shape, np.int16 if len(xs) < 32_768 else np.int32)
    pos.ravel()[e] = np.searchsorted(xs, at)  # how many points lie left of the crossing
    pos = _sorted_down(pos)[len(pos) % 2 :]  # crossings are even in number, others are 0: the points between two of a pair are inside
    step = np.bincount(pos[0::2].ravel(), minlength=len(xs) + 1) - np.bincount(pos[1::2].ravel(), minlength=len(xs) + 1)
    return np.cumsum(step)[:-1]


def _firsts(ids: np.ndarray, px, py, qx, qy, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first of the rings (columns, in order of ids) that holds each point; every point lies in one."""
    out, todo, k, n = np.zeros(len(x), np.int64), np.arange(len(x)), 0, 16
    with np.errstate(all="ignore"):
        while len(todo):
            left, s = [], slice(k, k + n)
            for t in np.array_split(todo, len(todo) * n // 1_000_000 + 1):
                u, w, inside = x[t][:, None], y[t][:, None], np.zeros((len(t), len(ids[s])), bool)
                for a, b, c, d in zip(px[:, s], py[:, s], qx[:, s], qy[:, s]):
                    inside ^= ((b > w) != (d > w)) & (u < a + (w - b) * (c - a) / (d - b))
                hit = inside.any(1)
                out[t[hit]] = ids[s][inside[hit].argmax(1)]
                left.append(t[~hit])
            todo, k, n = np.concatenate(left), k + n, min(2 * n, 1024)
    return out


def _held(points: pa.Table, rings: pa.Table) -> pa.Table:
    """id, rings, first of the points that some of the rings hold."""
    rings = rings.sort_by("ring")
    v = rings.column("v").combine_chunks()
    sizes = v.value_lengths().to_numpy()
    vx, vy = (c.to_numpy(zero_copy_only=False) for c in v.flatten().flatten())
    start = np.cumsum(sizes) - sizes
    x, y, ids = (points.column(c).to_numpy() for c in ("x", "y", "id"))
    order = np.lexsort((x, y))
    x, y, ids = x[order], y[order], ids[order]
    rows = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.zeros(0, int)
    ends, count = np.append(rows[1:], len(y)), np.zeros(len(y), np.int64)
    for m in np.unique(sizes):
        same = np.flatnonzero(sizes == m)
        for k in range(0, len(same), _BLOCK):
            at = start[same[k : k + _BLOCK]] + np.arange(m)[:, None]
            qx, qy = vx[at], vy[at]
            px, py = np.roll(qx, 1, 0), np.roll(qy, 1, 0)
            for r in range(*np.searchsorted(y[rows], (qy.min(), qy.max()))):  # no edge starts above the row, or ends below it
                s = slice(rows[r], ends[r])
                count[s] += _row_counts(px, py, qx, qy, y[rows[r]], x[s])
    inside = np.flatnonzero(count)
    most = int(sizes.max(initial=0))
    q = start + np.minimum(np.arange(most)[:, None], sizes - 1)  # rings of fewer vertices stay on their last one
    p = np.concatenate([(start + sizes - 1)[None], q[:-1]]) if most else q
    first = _firsts(rings.column("ring").to_numpy(), vx[p], vy[p], vx[q], vy[q], x[inside], y[inside])
    return pa.table({"id": pa.array(ids[inside], pa.int64()), "rings": pa.array(count[inside], pa.int64()), "first": pa.array(first, pa.int64())})


def rings_at_points(points: DataFrame, rings: DataFrame, band: float, most: int = _RINGS) -> DataFrame:
    """id, rings, first: how many rings of its kind hold a point (even-odd), and the smallest of them; points in none are left out.

    points: id, kind, x, y. rings: ring, kind, v (vertices x, y; the first not repeated). Both meet by kind and band of y, in parts
    of about `most` rings. There the rings' edges cross each row of points that share their y in order, and the points between two
    crossings are counted by sums of steps, so no row stands for a pair of a point and a ring.
    """
    side = F.transform("v", lambda p: p["y"])
    kept = cut_lineage(rings.where("kind is not null and size(v) >= 3").select("ring", "kind", "v"))
    dealt = buckets(kept, F.array_min(side), F.array_max(side), band, "band")
    largest = dealt.groupBy("kind", "band").count().agg(F.max("count")).first()[0] or 0
    parts = -(-largest // most) or 1
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("ring"), F.lit(parts)).cast("int"))
    p = points.where("kind is not null and x is not null and y is not null").withColumn("band", F.floor(F.col("y") / band).cast("long"))
    p = p.select("id", "kind", "band", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    keys = ["kind", "band", "part"]
    held = p.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda a, b: _held(a, b), "id long, rings long, first long")
    return held.groupBy("id").agg(F.sum("rings").alias("rings"), F.min("first").alias("first"))
