"""Rings as arrays of STRUCT<x, y>, first vertex not repeated: boxes, equality, clean-up, clipping, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(v: Column, i: Column) -> Column:
    return F.element_at(v, F.when(i == 1, F.size(v)).otherwise(i - 1))


def _after(v: Column, i: Column) -> Column:
    return F.element_at(v, F.when(i == F.size(v), F.lit(1)).otherwise(i + 1))


def places(v: Column) -> Column:
    """1..size of an array that isn't empty."""
    return F.sequence(F.lit(1), F.size(v))


def box(v: Column) -> dict[str, Column]:
    side = lambda k: F.transform(v, lambda p: p[k])
    return {"x_lo": F.array_min(side("x")), "x_hi": F.array_max(side("x")), "y_lo": F.array_min(side("y")), "y_hi": F.array_max(side("y"))}


def area(v: Column) -> Column:
    """Signed area by the shoelace formula; 0 for fewer than three vertices."""
    twice = F.aggregate(places(v), F.lit(0.0), lambda a, i: a + (F.element_at(v, i)["x"] * _after(v, i)["y"] - _after(v, i)["x"] * F.element_at(v, i)["y"]).cast("double"))
    return F.when(F.size(v) >= 3, twice / 2).otherwise(0.0)


def canonical(v: Column) -> Column:
    """The least of all rotations in both directions: equal for rings that are equal up to rotation and direction."""
    turns = lambda w: F.transform(places(w), lambda i: F.concat(F.slice(w, i, F.size(w)), F.slice(w, F.lit(1), i - 1)))
    return F.array_min(F.concat(turns(v), let(F.reverse(v), turns)))


def cleaned(v: Column, spikes: int = 2) -> Column:
    """v without repeated neighbours and without spikes (a vertex between equal neighbours), `spikes` times over; empty if no
    area is left."""
    differ = lambda a, b: (a["x"] != b["x"]) | (a["y"] != b["y"])

    def once(w: Column, test) -> Column:
        return F.when(F.size(w) > 1, F.filter(w, lambda p, i: test(w, p, i + 1))).otherwise(w)

    no_repeat = lambda w: once(w, lambda a, p, i: differ(p, _before(a, i)))
    no_spike = lambda w: once(w, lambda a, p, i: differ(_before(a, i), _after(a, i)))
    out = let(v, no_repeat)
    for _ in range(spikes):
        out = let(let(out, no_spike), no_repeat)
    return let(out, lambda w: F.when((F.size(w) >= 3) & (area(w) != 0), w).otherwise(F.slice(w, F.lit(1), F.lit(0))))


def clip_half(v: Column, axis: str, upper: bool, bound: Column) -> Column:
    """The part of a ring with axis <= bound (upper) or >= bound."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] <= bound if upper else p[axis] >= bound

    def cross(p: Column, q: Column) -> Column:
        at = p[other] + (bound - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        return F.struct(*((bound.cast("double") if k == axis else at).alias(k) for k in ("x", "y")))

    def step(i: Column) -> Column:
        p, q = _before(v, i), F.element_at(v, i)
        return F.when(inside(q), F.when(inside(p), F.array(q)).otherwise(F.array(cross(p, q), q))).otherwise(F.when(inside(p), F.array(cross(p, q))).otherwise(F.slice(F.array(q), F.lit(1), F.lit(0))))

    return F.when(F.size(v) > 0, F.flatten(F.transform(places(v), step))).otherwise(v)


def clip(v: Column, x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column) -> Column:
    """The ring's part in a rectangle, one ring with bridges along the edges; empty if fewer than three vertices are left."""
    for axis, upper, bound in (("x", False, x_lo), ("x", True, x_hi), ("y", False, y_lo), ("y", True, y_hi)):
        at = (axis, upper, bound)
        v = let(v, lambda w: clip_half(w, *at))
    return let(v, lambda w: F.when(F.size(w) >= 3, w).otherwise(F.slice(w, F.lit(1), F.lit(0))))


def holds(v: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside the ring, even-odd."""

    def crosses(i: Column) -> Column:
        p, q = _before(v, i), F.element_at(v, i)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.when(F.size(v) >= 3, F.aggregate(F.transform(places(v), crosses), F.lit(0), lambda a, b: a + b) % 2 == 1).otherwise(False)


def edges_of(v: Column, x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column) -> Column:
    """Letters of the rectangle's edges that all vertices lie on, as text; empty if there is none."""

    def letter(name: str, axis: str, bound: Column) -> Column:
        return F.when(F.forall(v, lambda p: p[axis] == bound), name).otherwise("")

    return F.concat(letter("E", "x", x_hi), letter("N", "y", y_hi), letter("S", "y", y_lo), letter("W", "x", x_lo))
