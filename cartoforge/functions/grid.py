"""Cells, lattices and the sphere, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M, EARTH_KM = 6371000.0, 6371.0088


@dataclass(frozen=True)
class Grid:
    """Origin and span of the box that the cells of a level divide."""

    lat0: float = -32.5
    lon0: float = 115.5
    lat_span: float = 1.0
    lon_span: float = 1.0
    lattice: int = 4096


GRID = Grid()


def lon_delta(lon: Column, lon0: float, span: float) -> Column:
    """lon - lon0 brought into [0, span] by whole turns where that is possible; the far end stays itself."""
    d = lon - F.lit(lon0)
    return F.when((d >= 0) & (d <= span), d).otherwise(d - 360.0 * F.floor(d / 360.0))


def cell(lat: Column, lon: Column, n: Column, g: Grid = GRID) -> Column:
    """STRUCT<ix, iy> of a point, null outside; cells are half-open."""
    ix = F.floor(lon_delta(lon, g.lon0, g.lon_span) / g.lon_span * n).cast("long")
    iy = F.floor((lat - g.lat0) / g.lat_span * n).cast("long")
    return F.when((ix >= 0) & (ix < n) & (iy >= 0) & (iy < n), F.struct(ix.alias("ix"), iy.alias("iy")))


def cell_bounds(ix: Column, iy: Column, n: Column, g: Grid = GRID) -> dict[str, Column]:
    wrap = lambda x: F.when(x > 180, x - 360).otherwise(x)
    return {
        "lat_lo": g.lat0 + iy * (g.lat_span / n), "lat_hi": g.lat0 + (iy + 1) * (g.lat_span / n),
        "lon_lo": wrap(g.lon0 + ix * (g.lon_span / n)), "lon_hi": wrap(g.lon0 + (ix + 1) * (g.lon_span / n)),
    }


def quantise(lat: Column, lon: Column, ix: Column, iy: Column, n: Column, units: int = 4096, g: Grid = GRID) -> tuple[Column, Column]:
    """Cell-local lattice x, y; halves go to the even neighbour; clamped into [0, units]."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(units), F.rint(v * units).cast("long")))
    return at(lon_delta(lon, g.lon0, g.lon_span) / g.lon_span * n - ix), at((lat - g.lat0) / g.lat_span * n - iy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    r = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * r / 2), 2) + F.cos(lat1 * r) * F.cos(lat2 * r) * F.pow(F.sin((lon2 - lon1) * r / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle initial bearing, whole degrees 0..359, cut off."""
    r = math.pi / 180
    y = F.sin((lon2 - lon1) * r) * F.cos(lat2 * r)
    x = F.cos(lat1 * r) * F.sin(lat2 * r) - F.sin(lat1 * r) * F.cos(lat2 * r) * F.cos((lon2 - lon1) * r)
    return F.floor(F.pmod(F.atan2(y, x) / r + 360.0, F.lit(360.0))).cast("long")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def pow2_range(largest: Column, least: int = 1024) -> Column:
    """Smallest power of two not below largest, from `least` on."""
    return F.greatest(F.lit(least).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(largest, F.lit(1)).cast("double")))).cast("long"))


def histogram_bucket(value: Column, edges: list[float]) -> Column:
    """Label of the fixed-edge bucket, lower edge inside."""
    out = F.lit(f"{edges[-1]:g}+")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when(value < hi, f"{lo:g}-{hi:g}").otherwise(out)
    return F.when(value < edges[0], f"<{edges[0]:g}").otherwise(out)


def with_levels(df: DataFrame, grids: DataFrame) -> DataFrame:
    """A row for each level; the dimension has one row a level and is broadcast."""
    return df.crossJoin(F.broadcast(grids))


def shoelace(xs: Column, ys: Column) -> Column:
    """Twice the signed area of a ring given by arrays of equal length."""
    n = F.size(xs)
    term = lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + term(i))


def flat_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing on a flat earth in degrees, 0 where the points are the same."""
    r = math.pi / 180
    dy, dx = lat2 - lat1, (lon2 - lon1) * F.cos((lat1 + lat2) / 2 * r)
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.when(dx < 0, 360.0).otherwise(0.0) + F.atan2(dx, dy) / r)


def frame_local(g: Column, units: int) -> tuple[Column, Column]:
    """Frame index and place inside the frame of a global lattice coordinate."""
    f = F.floor(g / units).cast("long")
    return f, g - f * units


def frame_global(frame: Column, local: Column, units: int) -> Column:
    return frame * units + local


def segment_chebyshev(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Chebyshev distance of a point from its foot on a segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2))).otherwise(0.0)
    return F.greatest(F.abs(px - (x1 + t * dx)), F.abs(py - (y1 + t * dy)))


def box_metres(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of latitude and of longitude, as for the extent of a box."""
    return F.lit(110574.0), 111320.0 * F.cos(lat * (math.pi / 180))


def ellipsoid_metres(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of latitude and of longitude on the WGS84 ellipsoid (the usual series)."""
    c = lambda k: F.cos(k * lat * (math.pi / 180))
    return 111132.92 - 559.82 * c(2) + 1.175 * c(4) - 0.0023 * c(6), 111412.84 * c(1) - 93.5 * c(3) + 0.118 * c(5)
