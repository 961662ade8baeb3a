"""Keyed comparisons and classification of two tables or of diagnostic rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..sources.lineage import cut_lineage, drop_tables
from .spatial import nearest_point


def null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def both_sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys that compare null-safely: a key of nulls on both sides is one row."""
    other = b.withColumnsRenamed({k: f"_of_b_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(other[f"_of_b_{k}"]) for k in keys))
    joined = a.withColumn("_in_a", F.lit(True)).join(other, on, "full_outer")
    rest = [c for c in (*a.columns, *b.columns) if c not in keys]
    return joined.select(*(F.when(F.col("_in_a"), F.col(k)).otherwise(F.col(f"_of_b_{k}")).alias(k) for k in keys), *rest)


def flag_lookup(rows: DataFrame, side: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """rows with the flag of their key in side, 0 if it isn't there; keys compare null-safely, and a repeated key gives the least."""
    one = side.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(flag).alias("_flag"))
    on = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(one[f"_{k}"]) for k in keys))
    return rows.join(one, on, "left").select(*rows.columns, F.coalesce("_flag", F.lit(0)).alias(flag))


def exactly_once(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that side doesn't cover exactly once: keys, problem (missing, foreign, duplicate)."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("_r"))
    b = side.groupBy(*keys).agg(F.count("*").alias("_s"))
    both = both_sides(a, b, keys)
    problem = F.when(F.col("_r").isNull(), "foreign").when(F.col("_s").isNull(), "missing").when(F.col("_s") > 1, "duplicate")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def group_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of diagnostic rows: keys, n, least and most vert, least and most distance (null where none)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("vert").alias("min_vert"), F.max("vert").alias("max_vert"), F.min("d_src").alias("min_d"), F.max("d_src").alias("max_d"))


def classify(rows: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """rows with `cause`, of the first rule of their kind that holds; null if none."""
    return rows.withColumn("cause", first_match(rules, rows.columns))


def partition_proof(classified: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, total, assigned, unassigned for every kind of the manifest, those without rows too."""
    counts = classified.groupBy("kind").agg(F.count("*").alias("total"), F.count("cause").alias("assigned"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return kinds.join(counts, "kind", "left").select("kind", zero("total").alias("total"), zero("assigned").alias("assigned"), (zero("total") - zero("assigned")).alias("unassigned"))


def compare_counts(r: DataFrame, g: DataFrame, key: str, n: str, low: float, high: float) -> DataFrame:
    """Status of g's counts against r's over the union of keys: in_range, out_of_range; where r has none, g must have none."""
    both = both_sides(r.select(key, F.col(n).alias("r")), g.select(key, F.col(n).alias("g")), [key]).select(key, F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("g", F.lit(0)).alias("g"))
    good = F.when(F.col("r") == 0, F.col("g") == 0).otherwise((F.col("g") >= low * F.col("r")) & (F.col("g") <= high * F.col("r")))
    return both.select(key, "r", "g", F.when(good, "in_range").otherwise("out_of_range").alias("status"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose number differs between a and b: keys, n_a, n_b."""
    x, y = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((a, "n_a"), (b, "n_b")))
    both = both_sides(x, y, keys).select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def islands(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Runs of consecutive whole numbers `at` within keys: keys, run_lo, run_hi, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    return rows.select(*keys, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(at).alias("run_lo"), F.max(at).alias("run_hi"), F.count("*").alias("n")).drop("_g")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their 1-based place in the order within keys. Few keys with many rows each are no single task's work: ranges of
    (keys, order) are numbered each on its own and start after the counts of the ranges before."""
    once = cut_lineage(rows)  # range partitioning reads its input twice: once for a sample of it
    parts = cut_lineage(once.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    drop_tables(once)
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")).drop("_size")
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    placed = parts.withColumn("_here", here)
    before = before.withColumnsRenamed({k: f"_of_{k}" for k in keys}).withColumnRenamed("_part", "_of_part")
    on = reduce(lambda x, y: x & y, (placed[k].eqNullSafe(before[f"_of_{k}"]) for k in keys), placed["_part"] == before["_of_part"])
    return placed.join(before, on).select(*rows.columns, (F.col("_before") + F.col("_here")).cast("long").alias(name))


def pair_once(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """Pairs of equal keys, each row of either side used once, in the order of ids: keys, a_id, b_id."""
    x = numbered(a.select(*keys, a_id), keys, [a_id], "_k")
    y = numbered(b.select(*keys, b_id), keys, [b_id], "_k")
    return x.join(y, [*keys, "_k"]).select(*keys, a_id, b_id)


def modal(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each key, the least of equals: keys, value, n, total. Counts come before the window."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.select("*", F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("n"), value)).alias("_k"))
    return ranked.where("_k = 1").drop("_k")


def modal_rule(fit: DataFrame, held: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """held with `predicted`, the commonest value that fit has for the key; null for keys that fit doesn't have."""
    return held.join(modal(fit, keys, value).select(*keys, F.col(value).alias("predicted")), list(keys), "left")


def one_sided(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either table beyond those that the other has, repeats included: side, columns."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).select(F.lit("a").alias("side"), *columns).unionByName(y.exceptAll(x).select(F.lit("b").alias("side"), *columns))


def reconcile_evidence(direct: DataFrame, counter: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdicts of two sources of evidence (keys, cause each): agreed, conflict, conflict-open (no counterfactual), counterfactual-only."""
    both = both_sides(direct.select(*keys, F.col("cause").alias("direct")), counter.select(*keys, F.col("cause").alias("counter")), keys)
    verdict = F.when(F.col("counter").isNull(), "conflict-open").when(F.col("direct").isNull(), "counterfactual-only").when(F.col("direct") == F.col("counter"), "agreed").otherwise("conflict")
    return both.select(*keys, "direct", "counter", verdict.alias("verdict"))


def interval_proof(parts: DataFrame, keys: Sequence[str], start: str, size: str) -> DataFrame:
    """Whether intervals follow one another: keys, n, gaps, overlaps, bytes (sum of sizes), span (from the first to the last end)."""
    w = Window.partitionBy(*keys).orderBy(start, size)
    nxt = parts.select(*keys, F.col(start).alias("_a"), F.col(size).alias("_n"), F.lead(start).over(w).alias("_next"))
    end = F.col("_a") + F.col("_n")
    return nxt.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_next") > end).alias("gaps"), F.count_if(F.col("_next") < end).alias("overlaps"), F.sum("_n").alias("bytes"), (F.max(end) - F.min("_a")).alias("span"))


def tie_classes(hits: DataFrame, keys: Sequence[str], blob: str, verdict: str, name: str) -> DataFrame:
    """T0 (one blob), T1 (several blobs, one verdict) or T2 (several verdicts) for each hit set, and its lowest name."""
    g = hits.groupBy(*keys).agg(F.countDistinct(blob).alias("blobs"), F.countDistinct(verdict).alias("verdicts"), F.min(name).alias("lowest"))
    return g.select(*keys, F.when(F.col("blobs") <= 1, "T0").when(F.col("verdicts") <= 1, "T1").otherwise("T2").alias("tie"), "lowest")


def hash_sample(rows: DataFrame, stratum: Sequence[str], key: Column, k: int) -> DataFrame:
    """The k rows of each stratum with the lowest SHA-256 of key, with `digest` and `holdout` (its last hex digit is odd)."""
    w = Window.partitionBy(*stratum).orderBy("digest")
    kept = rows.withColumn("digest", F.sha2(key, 256)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
    return kept.withColumn("holdout", F.right("digest", F.lit(1)).isin(*"13579bdf"))


def order_divergence(rows: DataFrame, keys: Sequence[str], a: list, b: list) -> DataFrame:
    """How far two orders of the rows of a key agree: keys, n, moved (rows at another place), first_moved."""
    w = Window.partitionBy(*keys)
    both = rows.withColumn("a", F.row_number().over(w.orderBy(*a))).withColumn("b", F.row_number().over(w.orderBy(*b)))
    moved = F.col("a") != F.col("b")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(moved).alias("moved"), F.min(F.when(moved, F.col("a"))).alias("first_moved"))


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """The value at place round(share * (n - 1)) of each key's sorted values, with n, least, most and mean.

    Values are counted before the window, so that it holds distinct values and not rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    here = F.col("upto") > F.rint((F.col("n") - 1) * share)
    agg = [F.sum("k").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("mean"), F.min(F.when(here, F.col(value))).alias("at_share")]
    return c.groupBy(*keys).agg(*agg)


def key_order(a: DataFrame, b: DataFrame, scope: Sequence[str], key: str, at: str) -> DataFrame:
    """Keys of two tables within a scope: scope, key, side (a only, b only, both), same_place among the shared ones."""
    both = both_sides(a.select(*scope, key, F.col(at).alias("a_at")), b.select(*scope, key, F.col(at).alias("b_at")), [*scope, key])
    side = F.when(F.col("b_at").isNull(), "a only").when(F.col("a_at").isNull(), "b only").otherwise("both")
    w = Window.partitionBy(*scope, "side")
    placed = both.withColumn("side", side).withColumn("pa", F.row_number().over(w.orderBy("a_at", key))).withColumn("pb", F.row_number().over(w.orderBy("b_at", key)))
    return placed.select(*scope, key, "side", F.when(F.col("side") == "both", F.col("pa") == F.col("pb")).alias("same_place"))


def differing_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Longest runs of consecutive places at which two sequences differ, or only one is there: keys, run_lo, run_hi, n."""
    both = both_sides(a.select(*keys, at, F.col(value).alias("va"), F.lit(True).alias("in_a")), b.select(*keys, at, F.col(value).alias("vb"), F.lit(True).alias("in_b")), [*keys, at])
    return islands(both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("va").eqNullSafe(F.col("vb"))).select(*keys, at), keys, at)


def field_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Field-wise differences of two keyed tables: keys, field, a_value, b_value, verdict (allowed or violation).

    A key that only one side has is a violation in every field.
    """
    long = lambda t, name: t.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))))
    both = both_sides(long(a, "a_value").withColumn("in_a", F.lit(True)), long(b, "b_value").withColumn("in_b", F.lit(True)), [*keys, "field"])
    differ = both.where(~F.col("a_value").eqNullSafe(F.col("b_value")) | F.col("in_a").isNull() | F.col("in_b").isNull())
    fine = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("field").isin(list(allowed))
    return differ.select(*keys, "field", "a_value", "b_value", F.when(fine, "allowed").otherwise("violation").alias("verdict"))


def transitions(rows: DataFrame, was: str, now: str, ablated: dict[str, str]) -> DataFrame:
    """Changes of class with what explains them: the one removal that brings the old class back, `none`, or `joint`: was, now, cause, n.

    ablated: name of a removal -> the column of the class without it.
    """
    back = F.array_compact(F.array(*(F.when(F.col(c) == F.col(was), F.lit(name)) for name, c in ablated.items())))
    cause = F.when(F.size(back) == 0, "none").when(F.size(back) == 1, F.get(back, F.lit(0))).otherwise("joint")
    return rows.where(F.col(was) != F.col(now)).groupBy(F.col(was).alias("was"), F.col(now).alias("now"), cause.alias("cause")).agg(F.count("*").alias("n"))


def monotonic(rows: DataFrame, keys: Sequence[str], order: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """Breaks of each candidate column's growth along the given order of each key: keys, candidate, n_breaks, is_monotonic."""
    w = Window.partitionBy(*keys).orderBy(*order)
    broken = rows.select(*keys, *((F.col(c) < F.lag(c).over(w)).alias(f"broken_{c}") for c in candidates))
    counts = broken.groupBy(*keys).agg(*(F.count_if(F.col(f"broken_{c}")).alias(c) for c in candidates))
    long = counts.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).alias("n_breaks")) for c in candidates))))
    return long.withColumn("is_monotonic", F.col("n_breaks") == 0)


def first_of(rows: DataFrame, keys: Sequence[str], verdicts: Sequence[tuple[str, DataFrame]], rest: str) -> DataFrame:
    """rows with `verdict` and its `source`, of the first table (keys, verdict) that has the key; rest if none does."""
    out, found = rows, []
    for i, (name, table) in enumerate(verdicts):
        out = out.join(table.select(*keys, F.col("verdict").alias(f"v{i}")), list(keys), "left")
        found.append((name, F.col(f"v{i}")))
    source = F.coalesce(*(F.when(v.isNotNull(), name) for name, v in found), F.lit("none"))
    return out.select(*rows.columns, F.coalesce(*(v for _, v in found), F.lit(rest)).alias("verdict"), source.alias("source"))


def dispositions(rows: DataFrame, keys: Sequence[str], reference: str, most: int) -> DataFrame:
    """Groups of rows with n and evidence: their `most` least references, comma-joined."""
    w = Window.partitionBy(*keys).orderBy(reference)
    numbered = rows.select(*keys, reference, F.row_number().over(w).alias("k"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.col(reference)))), lambda r: r.cast("string")), ",")
    return numbered.groupBy(*keys).agg(F.count("*").alias("n"), listed.alias("evidence"))


def scoped_flag(rows: DataFrame, side: DataFrame, keys: Sequence[str], flag: str, scope: Column) -> DataFrame:
    """rows with the flag of their key where scope holds (0 if side lacks the key), -1 elsewhere."""
    return flag_lookup(rows, side, keys, flag).withColumn(flag, F.when(scope, F.col(flag)).otherwise(F.lit(-1)))


def outside_parent(children: DataFrame, parents: DataFrame, index: str) -> DataFrame:
    """parent, n children, outside: those whose index isn't in their parent's [first, first + n). A parent that isn't there has
    all of its children outside."""
    p = parents.select("parent", "first", F.col("n").alias("size"))
    t = children.join(p, "parent", "left")
    inside = F.coalesce((F.col(index) >= F.col("first")) & (F.col(index) < F.col("first") + F.col("size")), F.lit(False))
    return t.groupBy("parent").agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"))


def mirror_census(east: DataFrame, west: DataFrame, last: int) -> DataFrame:
    """level, n, outer_edge, mirrored, missing: end points on east edges (level, ix, iy, vert) with an equal one on the west edge
    of the next cell. Those at the last column have no next cell and are counted apart."""
    w = west.select("level", (F.col("ix") - 1).alias("ix"), "iy", "vert", F.lit(True).alias("there")).distinct()
    t = east.distinct().join(w, ["level", "ix", "iy", "vert"], "left")
    inner, there = F.col("ix") < last, F.coalesce("there", F.lit(False))
    return t.groupBy("level").agg(F.count("*").alias("n"), F.count_if(~inner).alias("outer_edge"), F.count_if(inner & there).alias("mirrored"), F.count_if(inner & ~there).alias("missing"))


def score_orders(rows: DataFrame, group: Sequence[str], truth: Sequence[str], orders: dict[str, Sequence[str]], split: Column) -> DataFrame:
    """rule, split, n, hits: how many rows have the same place in their group by a rule's order as by the true one."""
    place = lambda by: F.row_number().over(Window.partitionBy(*group).orderBy(*by))
    t = rows.select(split.alias("split"), place(truth).alias("k"), *(place(by).alias(f"_{n}") for n, by in orders.items()))
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_{n}").alias("p")) for n in orders)))
    return t.select("split", "k", each).groupBy("rule", "split").agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("p")).alias("hits"))


def score_rules(rows: DataFrame, rules: dict[str, Column], truth: Column, split: Column) -> DataFrame:
    """rule, split, n, share of rows where a rule says what is true."""
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.when(r == truth, 1.0).otherwise(0.0).alias("right")) for n, r in rules.items())))
    return rows.select(split.alias("split"), each).groupBy("rule", "split").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("share"))


def still_present(rows: DataFrame, other: DataFrame, keys: Sequence[str], vertex: str) -> DataFrame:
    """level, n, same_shape, same_vertex: rows whose key, and whose key and vertex, other holds too."""
    shape = other.select(*keys).distinct().withColumn("s", F.lit(True))
    exact = other.select(*keys, vertex).distinct().withColumn("v", F.lit(True))
    t = rows.join(shape, list(keys), "left").join(exact, [*keys, vertex], "left")
    return t.groupBy("level").agg(F.count("*").alias("n"), F.count("s").alias("same_shape"), F.count("v").alias("same_vertex"))


def products_of(rows: DataFrame, source: Column, derive) -> DataFrame:
    """What derive(rows) holds that it wouldn't without the rows of a source."""
    return derive(rows).exceptAll(derive(rows.where(~source)))


def compare_paths(a: DataFrame, b: DataFrame, path: Sequence[str], size: str) -> DataFrame:
    """path, delta of sizes, status (same, resized, changed, added, removed) of two products, by one pass over their union."""
    side = lambda df, k: df.select(*path, F.col(size).alias("size"), F.lit(k).alias("k"))
    own = lambda k, c: F.sum(F.when(F.col("k") == k, c).otherwise(0))
    t = side(a, 1).unionByName(side(b, -1)).groupBy(*path).agg(own(1, F.lit(1)).alias("na"), own(-1, F.lit(1)).alias("nb"), own(1, F.col("size")).alias("sa"), own(-1, F.col("size")).alias("sb"))
    status = F.when(F.col("na") == 0, "added").when(F.col("nb") == 0, "removed").when((F.col("na") == F.col("nb")) & (F.col("sa") == F.col("sb")), "same").when(F.col("na") == F.col("nb"), "resized").otherwise("changed")
    return t.select(*path, (F.col("sb") - F.col("sa")).alias("delta"), status.alias("status"))


def round_trip(product: DataFrame, sources: DataFrame, keys: Sequence[str], within: float, explained: Column) -> DataFrame:
    """Does every record of a product (keys, id, x, y) have a source record (keys, x, y) at most `within` away on either axis? By
    keys: checked, failing, explained (without a source, but declared so by an expression on the product), and worst, the largest
    distance of those that have one. Records and sources meet in buckets; one source may serve several records."""
    key = F.concat_ws(":", *keys)
    p = product.withColumn("_row", F.xxhash64(*keys, "id"))
    met = nearest_point(p.select(F.col("_row").alias("id"), key.alias("kind"), "x", "y"), sources.select(key.alias("kind"), "x", "y"), within).withColumnRenamed("id", "_row")
    told = p.withColumn("_told", F.coalesce(explained, F.lit(False))).join(met, "_row", "left")
    none = F.col("distance").isNull()
    return told.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(none & ~F.col("_told")).alias("failing"), F.count_if(none & F.col("_told")).alias("explained"), F.round(F.max("distance"), 4).alias("worst"))
