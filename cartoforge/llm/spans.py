"""Spans of regular expressions inside texts, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Put around every match; where a text has it, it is read as another character of the same length that no pattern matches.
MARK, STAND_IN = "\x01", "�"
#: Parts of a text (an even number) that are gone through in one go.
BLOCK = 256
EMPTY = "array<struct<kind:string,start:int,end:int,value:string>>"


def readable(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, STAND_IN)


def spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] = lambda m: m) -> Column:
    """Leftmost non-overlapping matches of pattern for which keep(match) holds: kind, start, end (code points), value(match).

    text must have gone through readable(). Marks are set around all matches and the text is split at them, so matches are the
    parts at odd places and their starts are the lengths of what stands before.
    """
    parts = F.split(F.regexp_replace(text, F.lit(f"(?:{pattern})"), F.lit(f"{MARK}$0{MARK}")), MARK)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(EMPTY).alias("got"))

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        use = acc["i"] % 2 == 1
        if keep is not None:
            use = use & keep(part)
        one = F.array(F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), (acc["at"] + size).alias("end"), value(part).alias("value")))
        return F.struct((acc["at"] + size).alias("at"), (acc["i"] + 1).alias("i"), F.when(use, F.concat(acc["got"], one)).otherwise(acc["got"]).alias("got"))

    def in_blocks(all_parts: Column) -> Column:
        """The same over blocks of parts, each moved by what stands before it: a list never grows long by single steps."""
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_parts) - 1, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(all_parts, i + 1, F.lit(BLOCK)), begin, step))
        return let(blocks, lambda found: let(F.aggregate(F.transform(found, lambda x: x["at"]), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), lambda before: F.flatten(F.transform(found, lambda x, i: F.transform(x["got"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + F.get(before, i)).alias("start"), (s["end"] + F.get(before, i)).alias("end"), s["value"].alias("value")))))))

    return let(parts, lambda p: F.when(F.size(p) <= BLOCK, F.aggregate(p, begin, step, lambda acc: acc["got"])).otherwise(in_blocks(p)))


def listed(found: Column, kinds: tuple[str, ...], start_first: bool) -> Column:
    """kind:start:end of spans, comma-joined, in the order of start and then kind, or the other way round."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])

    def key(s: Column) -> Column:
        text = F.concat_ws(":", s["kind"], s["start"], s["end"])
        first, second = (s["start"].cast("long"), place(s)) if start_first else (place(s), s["start"].cast("long"))
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), text.alias("t"))

    return F.array_join(F.transform(F.sort_array(F.transform(found, key)), lambda k: k["t"]), ",")


def replaced(text: Column, found: Column, by: Callable[[Column], Column]) -> Column:
    """text with each span of found (sorted by start here; overlapping ones are merged) replaced by by(span)."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, before).otherwise(acc["out"]).alias("out"))

    order = F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    return F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))
