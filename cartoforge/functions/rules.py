"""Rules given as data, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "isnan": lambda c, v: c.isNull(), "notnan": lambda c, v: c.isNotNull(),
}


def predicate(where: Sequence[Sequence], columns: Sequence[str]) -> Column:
    """AND of [column, operator, value] tests; unknown columns and operators are refused before any row is read."""
    out = F.lit(True)
    for name, op, *value in where:
        if name not in columns:
            raise ValueError(f"unknown column {name!r}")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        out = out & F.coalesce(OPERATORS[op](F.col(name), value[0] if value else None), F.lit(False))
    return out


def first_match(rules: Sequence[dict], columns: Sequence[str], default: object = None, key: str = "cause") -> Column:
    """The value of the first rule whose tests hold; default (null: omit) if none does."""
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(predicate(rule["where"], columns), F.lit(rule[key])).otherwise(out)
    return out


def level_filter(level: Column, highway: Column, place: Column, background: Column, roads: dict[int, list[str]], places: dict[int, list[str]], kinds: dict[int, list[str]]) -> Column:
    """Whether a feature is shown at a level: its highway tag decides alone, else its place, else its background kind."""

    def allowed(value: Column, table: dict[int, list[str]]) -> Column:
        out = F.lit(False)
        for k, values in table.items():
            out = F.when(level == k, value.isin(values)).otherwise(out)
        return out

    return F.when(highway.isNotNull(), allowed(highway, roads)).when(place.isNotNull(), allowed(place, places)).otherwise(F.coalesce(allowed(background, kinds), F.lit(False)))
