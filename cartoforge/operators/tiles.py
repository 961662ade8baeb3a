"""Geometry to cells: admission, splitting, sharing, caps."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GRID, Grid, cell, with_levels
from ..sources.lineage import cut_lineage, drop_tables

#: Parts of segments that a task works out at a time, about.
_PARTS = 262_144


def way_geometry(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, points (pos, node_id, lat, lon in order) of ways with two or more located nodes; one equi-join on node_id."""
    placed = refs.join(nodes.where("lat is not null and lon is not null").select("node_id", "lat", "lon"), "node_id")
    return placed.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "lat", "lon"))).alias("points")).where(F.size("points") >= 2)


def segments(points: DataFrame) -> DataFrame:
    """way_id, pos, and both ends of every segment of ordered points (way_id, pos, lat, lon)."""
    w = Window.partitionBy("way_id").orderBy("pos")
    return points.select("way_id", "pos", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null")


def _cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines from a to b cross whole numbers: (line, parameter), a row a crossing."""
    lo, hi = np.floor(np.minimum(a, b)) + 1, np.ceil(np.maximum(a, b)) - 1
    n = np.maximum(hi - lo + 1, 0).astype(np.int64)
    line = np.repeat(np.arange(len(a)), n)
    k = lo[line] + (np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n))
    return line, (k - a[line]) / (b[line] - a[line])


def _chains(owner: np.ndarray, u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Chains inside a grid of n x n of ordered segments (owner, ends in cells): owner, ordinal, ix, iy, n_parts, first (segment)."""
    (lu, tu), (lv, tv), each = _cuts(u1, u2), _cuts(v1, v2), np.arange(len(u1))
    seg, t = np.concatenate([each, each, lu, lv]), np.concatenate([np.zeros(len(u1)), np.ones(len(u1)), tu, tv])
    order = np.lexsort((t, seg))
    seg, t = seg[order], t[order]
    whole = np.flatnonzero((seg[1:] == seg[:-1]) & (t[1:] != t[:-1]))
    seg, mid = seg[whole], (t[whole] + t[whole + 1]) / 2
    ix, iy = (np.floor(a[seg] + (b[seg] - a[seg]) * mid).astype(np.int64) for a, b in ((u1, u2), (v1, v2)))
    way = owner[seg]
    new = np.ones(len(seg), bool)
    new[1:] = (way[1:] != way[:-1]) | (ix[1:] != ix[:-1]) | (iy[1:] != iy[:-1])
    at = np.flatnonzero(new)
    parts = np.diff(np.append(at, len(seg)))
    kept = (ix[at] >= 0) & (ix[at] < n) & (iy[at] >= 0) & (iy[at] < n)
    at, parts = at[kept], parts[kept]
    way = way[at]
    return {"owner": way, "ordinal": np.arange(len(at)) - np.searchsorted(way, way), "ix": ix[at], "iy": iy[at], "n_parts": parts, "first": seg[at]}


def split_by_cell(segs: DataFrame, grids: DataFrame, g: Grid = GRID) -> DataFrame:
    """Chains of ways inside cells: level, way_id, ordinal, ix, iy, n_parts, first_pos.

    Segments are cut at the grid's lines; parts of a way that follow one another in the same cell are a chain (gaps and
    islands). Chains outside the grid are dropped and take no ordinal. A way's segments come to one task in order, so its parts,
    which are many times as many, are neither shuffled nor sorted again; they are worked out for some segments' ways at a time.
    grids (level, n) is a small table.
    """
    ways = segs.where("lat is not null and lon is not null and lat2 is not null and lon2 is not null").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon", "lat2", "lon2"))).alias("segs"))
    ways = ways.crossJoin(F.broadcast(grids.agg(F.collect_list(F.struct(F.col("level").cast("int").alias("level"), F.col("n").cast("long").alias("n"))).alias("grids"))))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            way, lists, grids = batch.column("way_id").to_numpy(), batch.column("segs"), batch.column("grids")[0].as_py()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            pos, *places = (c.to_numpy() for c in lists.flatten().flatten())
            owner = np.repeat(np.arange(len(way)), np.diff(ends))
            for grid in grids:
                n = grid["n"]
                v1, u1, v2, u2 = ((c - o) / span * n for c, o, span in zip(places, (g.lat0, g.lon0) * 2, (g.lat_span, g.lon_span) * 2))
                room = np.concatenate([[0], np.cumsum(np.abs(u2 - u1) + np.abs(v2 - v1) + 3)])[ends] // _PARTS
                for a, z in itertools.pairwise([0, *(np.flatnonzero(np.diff(room[1:])) + 1), len(way)]):
                    s = slice(ends[a], ends[z])
                    got = _chains(owner[s], u1[s], v1[s], u2[s], v2[s], n)
                    out = {"level": np.full(len(got["ix"]), grid["level"], np.int32), "way_id": way[got["owner"]], **{c: got[c] for c in ("ordinal", "ix", "iy", "n_parts")}, "first_pos": pos[s][got["first"]]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in out.items()})

    return ways.mapInArrow(run, "level int, way_id long, ordinal long, ix long, iy long, n_parts long, first_pos int")


def islands(points: DataFrame, parts: int) -> DataFrame:
    """way_id, run, first_pos, last_pos, n: the runs of a way's points (way_id, pos, cell) that follow one another in a cell.

    Repeated rows count once; a point without a cell is a run of its own. A way's points come to one of `parts` tasks once and
    are cut there in arrays: they pass no window, and runs, nearly as many as points, no aggregate.
    """
    ways = points.repartition(parts, "way_id").groupBy("way_id").agg(F.sort_array(F.collect_set(F.struct("pos", "cell"))).alias("points"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            way, lists = batch.column("way_id").to_numpy(), batch.column("points")
            owner = np.repeat(np.arange(len(way)), lists.value_lengths().to_numpy())
            pos, cell = lists.flatten().flatten()
            pos, known, cell = pos.to_numpy(), cell.is_valid().to_numpy(zero_copy_only=False), cell.fill_null(0).to_numpy()
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]) | ~known[1:] | ~known[:-1]
            at = np.flatnonzero(fresh)
            ends, of = np.append(at[1:], len(owner)), owner[at]
            out = {"way_id": way[of], "run": np.arange(len(at)) - np.searchsorted(of, of) + 1, "first_pos": pos[at], "last_pos": pos[ends - 1], "n": ends - at}
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in out.items()})

    return ways.mapInArrow(run, "way_id long, run long, first_pos int, last_pos int, n long")


def link_ids(chains: DataFrame) -> DataFrame:
    """level, way_id, ordinal, link_id of chains (level, way_id, ordinal): 1-based ids in that order. Ordinals are dense, so only
    the counts of ways are sorted, in ranges that start after the sums of those before (one a range, a small table)."""
    counts = cut_lineage(chains.groupBy("level", "way_id").agg(F.count("*").alias("n")))  # range partitioning reads its input twice
    parts = cut_lineage(counts.repartitionByRange("level", "way_id").withColumn("part", F.spark_partition_id()))
    drop_tables(counts)
    sizes = parts.groupBy("part").agg(F.sum("n").alias("k"))
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    to = F.sum("n").over(Window.partitionBy("part").orderBy("level", "way_id"))
    starts = parts.withColumn("start", to - F.col("n")).join(F.broadcast(before), "part")
    return starts.select("level", "way_id", (F.col("before") + F.col("start")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal")).select("level", "way_id", "ordinal", (F.col("start") + F.col("ordinal") + 1).cast("long").alias("link_id"))


def edge_cells(segs: DataFrame, n: int, grow: float = 1e-6, g: Grid = GRID) -> DataFrame:
    """Cells that the edges of shapes touch: way_id, ix, iy. A segment is grown by `grow` cells."""
    u1, u2 = ((F.col(c) - g.lon0) / g.lon_span * n for c in ("lon", "lon2"))
    v1, v2 = ((F.col(c) - g.lat0) / g.lat_span * n for c in ("lat", "lat2"))
    s = segs.select("way_id", u1.alias("u1"), u2.alias("u2"), v1.alias("v1"), v2.alias("v2"))
    s = s.withColumn("ix", F.explode(F.sequence(F.floor(F.least("u1", "u2") - grow).cast("long"), F.floor(F.greatest("u1", "u2") + grow).cast("long"))))
    steep = F.col("u1") != F.col("u2")
    y = lambda x: F.col("v1") + (F.col("v2") - F.col("v1")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("u1")) / (F.col("u2") - F.col("u1"))))
    ya, yb = F.when(steep, y(F.col("ix") - grow)).otherwise(F.col("v1")), F.when(steep, y(F.col("ix") + 1 + grow)).otherwise(F.col("v2"))
    lo, hi = F.floor(F.least(ya, yb) - grow).cast("long"), F.floor(F.greatest(ya, yb) + grow).cast("long")
    return s.withColumn("iy", F.explode(F.sequence(lo, hi))).where(f"ix between 0 and {n - 1} and iy between 0 and {n - 1}").select("way_id", "ix", "iy").distinct()


def _spread(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, k): every whole number k from low to high of each line that lies in 0..n - 1."""
    low, high = np.maximum(low, 0).astype(np.int64), np.minimum(high, n - 1).astype(np.int64)
    k = np.maximum(high - low + 1, 0)
    line = np.repeat(np.arange(len(low)), k)
    return line, low[line] + (np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k))


def _covered(owner: np.ndarray, u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray, n: int, grow: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys (owner * n + iy) * n + ix of the cells that edges of rings touch, and of the others whose centre line lies inside."""
    s, ix = _spread(np.floor(np.minimum(u1, u2) - grow), np.floor(np.maximum(u1, u2) + grow), n)
    a, b, c, e = u1[s], v1[s], u2[s], v2[s]
    with np.errstate(all="ignore"):
        y = lambda x: b + (e - b) * np.clip((x - a) / (c - a), 0.0, 1.0)
        ya, yb = np.where(a != c, y(ix - grow), b), np.where(a != c, y(ix + 1 + grow), e)
    t, iy = _spread(np.floor(np.minimum(ya, yb) - grow), np.floor(np.maximum(ya, yb) + grow), n)
    edges = np.unique((owner[s][t] * n + iy) * n + ix[t])
    s, iy = _spread(np.ceil(np.minimum(v1, v2) - 0.5), np.ceil(np.maximum(v1, v2) - 0.5) - 1, n)
    x = u1[s] + (u2[s] - u1[s]) * ((iy + 0.5 - v1[s]) / (v2[s] - v1[s]))
    row = owner[s] * n + iy
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    odd = (np.arange(len(row)) - np.searchsorted(row, row)) % 2 == 0
    at = np.flatnonzero(odd[:-1] & (row[1:] == row[:-1]))
    t, ix = _spread(np.ceil(x[at] - 0.5), np.ceil(x[at + 1] - 0.5) - 1, n)
    inside = np.unique(row[at][t] * n + ix)
    return edges, inside[~np.isin(inside, edges, assume_unique=True)]


def ring_cells(rings: DataFrame, n: int, g: Grid = GRID, homes: DataFrame | None = None, grow: float = 1e-6, edges: bool = True) -> DataFrame:
    """way_id, ix, iy, interior: cells that closed rings (segments way_id, lat, lon, lat2, lon2) touch (if `edges`; as of
    edge_cells), and the others whose centre line lies inside, by even-odd scan lines; not those of homes (way_id, ix, iy).

    Each edge meets the centre lines of the rows it spans; the crossings of a row are paired in order and the cells between whose
    centres lie inside are listed. A ring's segments come to one task, so its cells, which are many times as many, are neither
    shuffled nor sorted again; they are worked out for some rings at a time.
    """
    ways = rings.where("lat is not null and lon is not null and lat2 is not null and lon2 is not null").groupBy("way_id").agg(F.collect_list(F.struct("lat", "lon", "lat2", "lon2")).alias("segs"))
    if homes is None:
        ways = ways.withColumn("home", F.lit(-1).cast("long"))
    else:
        ways = ways.join(homes.where(f"ix between 0 and {n - 1} and iy between 0 and {n - 1}").groupBy("way_id").agg(F.max(F.col("iy") * n + F.col("ix")).cast("long").alias("home")), "way_id", "left")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            way, lists = batch.column("way_id").to_numpy(), batch.column("segs")
            home = batch.column("home").fill_null(-1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            v1, u1, v2, u2 = ((c.to_numpy() - o) / span * n for c, o, span in zip(lists.flatten().flatten(), (g.lat0, g.lon0) * 2, (g.lat_span, g.lon_span) * 2))
            owner = np.repeat(np.arange(len(way)), np.diff(ends))
            room = np.concatenate([[0], np.cumsum(np.abs(u2 - u1) + np.abs(v2 - v1) + 3)])[ends] // _PARTS
            for a, z in itertools.pairwise([0, *(np.flatnonzero(np.diff(room[1:])) + 1), len(way)]):
                s = slice(ends[a], ends[z])
                for interior, key in enumerate(_covered(owner[s], u1[s], v1[s], u2[s], v2[s], n, grow)):
                    if interior or edges:
                        key = key[key % (n * n) != home[key // (n * n)]]
                        out = {"way_id": way[key // (n * n)], "ix": key % n, "iy": key // n % n, "interior": np.full(len(key), bool(interior))}
                        yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in out.items()})

    return ways.mapInArrow(run, "way_id long, ix long, iy long, interior boolean")


def interior_cells(rings: DataFrame, n: int, g: Grid = GRID) -> DataFrame:
    """Cells whose row centre line lies inside closed rings: way_id, ix, iy; not those of the edges."""
    return ring_cells(rings, n, g, edges=False).select("way_id", "ix", "iy")


def closed(points: DataFrame, least: int = 3) -> DataFrame:
    """Segments of the rings that ways of `least` or more points make when closed by their first point."""
    w = Window.partitionBy("way_id").orderBy("pos")
    whole = Window.partitionBy("way_id")
    p = points.select("*", F.count("*").over(whole).alias("k"), F.min(F.struct("pos", "lat", "lon")).over(whole).alias("first"))
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.col(f"first.{c}"))
    return p.where(f"k >= {least}").select("way_id", "pos", "lat", "lon", nxt("lat").alias("lat2"), nxt("lon").alias("lon2"))


def share_shapes(rings: DataFrame, homes: DataFrame, existing: DataFrame, n: int, g: Grid = GRID) -> DataFrame:
    """Shapes borrowed by cells that they touch or cover besides their home cell: way_id, ix, iy, interior.

    homes: way_id, ix, iy. Only cells of `existing` (ix, iy) borrow.
    """
    there = existing.where(f"ix between 0 and {n - 1} and iy between 0 and {n - 1}").select("ix", "iy").distinct()
    return ring_cells(rings, n, g, homes).join(F.broadcast(there), ["ix", "iy"], "left_semi").select("way_id", "ix", "iy", "interior")


def capped(rows: DataFrame, keys: list[str], order: list, cap: Column) -> DataFrame:
    """The first rows of each key in the given order, as many as cap (null: all)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(cap.isNull() | (F.col("_k") <= cap)).drop("_k")


def trimmed(rows: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The longest best-first prefix of each key whose summed size fits the budget, with `kept`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("kept", F.sum(size).over(w) <= budget)


def tile_census(nodes: DataFrame, ways: DataFrame, points: DataFrame, grids: DataFrame) -> DataFrame:
    """Roads, shapes and names that have a vertex in each level's cells: level, ix, iy, roads, shapes, names."""
    p = with_levels(points.join(ways.select("way_id", F.col("highway").isNotNull().alias("road")), "way_id"), grids)
    p = p.select("level", "way_id", "road", cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").select("level", "way_id", "road", "c.ix", "c.iy").distinct()
    named = with_levels(nodes.where("name is not null"), grids).select("level", cell(F.col("lat"), F.col("lon"), F.col("n")).alias("c")).where("c is not null").groupBy("level", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.count("*").alias("names"))
    held = p.groupBy("level", "ix", "iy").agg(F.count_if("road").alias("roads"), F.count_if(~F.col("road")).alias("shapes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return held.join(named, ["level", "ix", "iy"], "full_outer").select("level", "ix", "iy", zero("roads"), zero("shapes"), zero("names"))


def balanced_ranges(weights: DataFrame, keys: list[str], order: list[str], weight: str, n: int) -> DataFrame:
    """Cells of each key dealt to at most n contiguous ranges of like weight, by prefix sums: rows with `part` from 1.

    weights has a row for each cell, so a window holds no more rows than a level has cells.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weights.withColumn("part", F.ceil(F.sum(weight).over(run) * n / F.sum(weight).over(Window.partitionBy(*keys))).cast("long"))


def cover_rings(interior: DataFrame, units: int, margin: int) -> DataFrame:
    """Cells (way_id, ix, iy) inside a shape with the rectangle that covers them: the cell, grown by a margin on each side."""
    at = lambda c, k: F.col(c) * units + k
    return interior.select("way_id", "ix", "iy", at("ix", -margin).alias("x_lo"), at("ix", units + margin).alias("x_hi"), at("iy", -margin).alias("y_lo"), at("iy", units + margin).alias("y_hi"))


def merge_borrowed(homes: DataFrame, touched: DataFrame) -> DataFrame:
    """Shapes of every cell in canonical order: its own, then those borrowed from others by their home's row and column.

    homes: way_id, hx, hy. touched: way_id, ix, iy. Returns ix, iy, way_id, borrowed, place (1-based).
    """
    own = homes.select(F.col("hx").alias("ix"), F.col("hy").alias("iy"), "way_id", F.lit(False).alias("borrowed"), "hx", "hy")
    lent = touched.join(homes, "way_id").where("ix <> hx or iy <> hy").select("ix", "iy", "way_id", F.lit(True).alias("borrowed"), "hx", "hy")
    w = Window.partitionBy("ix", "iy").orderBy("borrowed", "hy", "hx", "way_id")
    return own.unionByName(lent).select("ix", "iy", "way_id", "borrowed", F.row_number().over(w).cast("long").alias("place"))


def retiled(points: DataFrame, parts: int, g: Grid = GRID) -> DataFrame:
    """points (lat, lon, n: cells a side) with their cell (cx, cy) and its sub-cell (sx, sy) of parts x parts."""
    x, y = (F.col("lon") - g.lon0) / g.lon_span * F.col("n"), (F.col("lat") - g.lat0) / g.lat_span * F.col("n")
    sub = lambda v: F.floor((v - F.floor(v)) * parts)
    return points.withColumn("cx", F.floor(x)).withColumn("cy", F.floor(y)).withColumn("sx", sub(x)).withColumn("sy", sub(y))


def divide(items: DataFrame, size: Column, budget: int) -> DataFrame:
    """Cells (level, cx, cy) with their size and division: 1 within budget, 2 (2 x 2) if every quarter then is, else 4 (4 x 4).

    items: level, cx, cy, sx, sy (of 4 x 4). Sizes add up; one partial sum a quarter is shuffled.
    """
    quarter = items.groupBy("level", "cx", "cy", F.floor(F.col("sx") / 2).alias("hx"), F.floor(F.col("sy") / 2).alias("hy")).agg(F.sum(size).alias("k"))
    c = quarter.groupBy("level", "cx", "cy").agg(F.sum("k").alias("size"), F.max("k").alias("largest"))
    return c.select("level", "cx", "cy", "size", F.when(F.col("size") <= budget, 1).when(F.col("largest") <= budget, 2).otherwise(4).alias("division"))
