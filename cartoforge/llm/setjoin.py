"""Jaccard similarity join on word n-gram sets: universe partition, pigeonhole, one-deletion neighbourhoods, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, components, drop, mix, slices, word_hashes, written

#: Segments beyond what the pigeonhole needs, so that the smallest ones can go without a signature.
SLACK = 1.3
#: Cost of checking a candidate pair, in signature rows.
PAIR_COST = 4.0
#: Members that each turn checks the others of a signature's group against, and turns until what is left is checked by pairs.
HUBS, HUB_TURNS = 4, 2
#: Pairs a candidate set up to which the last turn takes them from the signatures without a look at the rarest shingles.
PAIRS = 4
#: Sets whose signatures a task remembers having given.
SEEN = 1_000_000
#: 256 parities of a set's hashes: two sets' parities differ in at most as many places as the sets differ in elements. Pairs that
#: pass are compared by WIDE parities before whole sets are fetched.
SKETCH, WIDE = ("p0", "p1", "p2", "p3"), 4096


@dataclass(frozen=True)
class Band:
    """Set sizes low..high. m segments; of their signatures the `keep` of the largest segments are emitted, and with
    `deletions` also those of every segment less one element."""

    low: int
    high: int
    m: int
    keep: int
    deletions: bool


def _poisson(lam: float, k: int) -> float:
    return math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) if lam > 0 else float(k == 0)


def allocate(low: int, high: int, most_apart: int, docs: float) -> Band:
    """The cheaper allocation for a band where linked sets differ in at most most_apart elements.

    Exact segments (budget 1 each): one of most_apart + 1 segments is the same in both; there are SLACK times as many, and the
    smallest ones get budget 0. Neighbourhood segments (budget 2 each): half as many, twice as long, one of them differs in one
    element at most. Cost: signature rows of a set, and PAIR_COST for each unrelated set that shares an empty segment with it
    by chance, taking a tenth of all sets as the band's.
    """
    need = most_apart + 1
    if not most_apart:  # only equal sets could link, and those are one set
        return Band(low, high, 1, 0, False)
    m1, m2 = math.ceil(SLACK * need), (need + 1) // 2
    size = (low + high) / 2
    empty = m1 * math.exp(-size / m1)
    kept_empty = sum((k - (m1 - need)) * _poisson(empty, k) for k in range(m1 - need + 1, min(m1, 200) + 1))
    exact = need + PAIR_COST * docs / 10 * kept_empty**2 / m1
    near = size + m2 + PAIR_COST * docs / 10 * m2 * (math.exp(-size / m2) * (1 + size / m2)) ** 2
    return Band(low, high, m1, need, False) if exact <= near else Band(low, high, m2, m2, True)


def bands(num: int, den: int, docs: float, largest: int) -> list[Band]:
    """Bands of sizes in the ratio (num/den)**2, so that a set's partners lie in its own band or the next ones."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * den // num * den // num)
        # |A xor B| <= (den-num)/(den+num) * (|A|+|B|), where |B| <= high and |A| <= high*den/num
        apart = (den - num) * (high + high * den // num) // (den + num)
        out.append(allocate(low, high, apart, docs))
        low = high + 1
    return out


def flat_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, flattened; the text each belongs to; sizes. Sorted by text, then hash."""
    w, of = word_hashes(texts)
    golden = np.uint64(0x9E3779B97F4A7C15)
    h, d = w[:0], of[:0]
    if len(w) >= width:
        h = w[: len(w) - width + 1]
        for k in range(1, width):
            h = mix(h * golden + w[k : len(w) - width + 1 + k])
        whole = of[: len(h)] == of[width - 1 :]
        h, d = h[whole], of[: len(h)][whole]
    count = np.bincount(of, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < width))
    first = np.cumsum(count) - count
    g = count[few].astype(np.uint64) + np.uint64(1)
    for k in range(width - 1):
        more = count[few] > k
        g[more] = mix(g[more] * golden + w[first[few[more]] + k])
    h, d = np.concatenate([h, g]), np.concatenate([d, few])
    if not len(h):
        return h, d, np.zeros(len(texts), np.int64)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, d, np.bincount(d, minlength=len(texts)).astype(np.int64)


def _signatures(h: np.ndarray, d: np.ndarray, n: np.ndarray, band: np.ndarray, plan: list[Band]) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of every text with band >= 0, for the segments of that band."""
    use = band[d] >= 0
    h, d = h[use], d[use]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = np.array([b.m for b in plan], np.int64)
    keep = np.array([b.keep for b in plan], np.int64)
    near = np.array([b.deletions for b in plan])
    have = np.where(band >= 0, m[band], 0)
    base = np.concatenate(([0], np.cumsum(have)))
    seg = base[d] + (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % m[band[d]].astype(np.uint64)).astype(np.int64)
    weight = mix(h + np.uint64(0x2545F4914F6CDD1D))
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, seg, weight)
    size = np.bincount(seg, minlength=base[-1])
    of = np.repeat(np.arange(len(n)), have)
    place = np.arange(base[-1]) - base[of]
    salt = mix((band[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
    sig = mix(total + salt + size.astype(np.uint64))
    order = np.lexsort((sig, -size, of))  # largest segments first: the same order for everyone, as it depends on the segment alone
    chosen = order[place < keep[band[of]]]  # place is the rank too: each text has places 0..m-1
    out_d, out_s = [of[chosen]], [sig[chosen]]
    if (cut := near[band[d]]).any():
        less = mix(total[seg[cut]] - weight[cut] + salt[seg[cut]] + (size[seg[cut]] - 1).astype(np.uint64))
        out_d.append(d[cut])
        out_s.append(less)
    return np.concatenate(out_d), np.concatenate(out_s)


def _marks(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, by which equal sets are known."""
    marks = np.zeros((2, len(n)), np.uint64)
    np.add.at(marks[0], d, mix(h ^ np.uint64(0xD6E8FEB86659FD93)))
    np.add.at(marks[1], d, mix(h + np.uint64(0xA0761D6478BD642F)))
    return marks.view(np.int64)


def _parities(h: np.ndarray, d: np.ndarray, n: int, bits: int, salt: int) -> np.ndarray:
    """`bits` parities of each of n sets, as rows of 64-bit numbers."""
    place = (mix(h ^ np.uint64(salt)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = np.bincount(d * bits + place, minlength=bits * n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, bits // 64)


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.alone()
        for b in slices(batches):
            h, d, n = flat_sets(b.column(1).to_pylist(), width)
            sketch = _parities(h, d, len(n), 256, 0x9FB21C651E98DF25)
            marks = _marks(h, d, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *map(pa.array, marks), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4))], ["doc_id", "n_shingles", "mark1", "mark2", *SKETCH])

    return run


def _signature_rows(width: int, plan: list[Band], num: int, den: int):
    """(sig, mark1, mark2) of every set; a set that the task has had is left out while it is remembered."""
    lows = np.array([b.low for b in plan], np.int64)
    highs = np.array([b.high for b in plan], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.alone()
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            h, d, n = flat_sets(b.column(0).to_pylist(), width)
            marks = _marks(h, d, n)
            fresh = np.zeros(len(n), bool)
            if len(seen) > SEEN:
                seen.clear()
            for i, m in enumerate(zip(*marks.tolist())):
                if n[i] and m not in seen:
                    seen.add(m)
                    fresh[i] = True
            own = np.where(fresh, np.searchsorted(lows, n, "right") - 1, -1)
            got = [_signatures(h, d, n, own, plan)]
            other = own - 1  # smaller partners have at least num/den of this size
            while ((some := (other >= 0) & (highs[other] * den >= num * n))).any():
                got.append(_signatures(h, d, n, np.where(some, other, -1), plan))
                other = np.where(some, other - 1, -1)
            for od, os in got:
                yield pa.RecordBatch.from_arrays([pa.array(os.view(np.int64)), *(pa.array(m[od]) for m in marks)], ["sig", "mark1", "mark2"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.alone()
        for b in slices(batches, 128):
            h, d, n = flat_sets(b.column(1).to_pylist(), width)
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            wide = _parities(h, d, len(n), WIDE, 0x5851F42D4C957F2D).reshape(-1)
            wides = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (WIDE // 64)), pa.array(wide))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), wides, pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["rid", "n", "wide", "set"])

    return run


def _held_by(sets: DataFrame) -> DataFrame:
    """element, df: elements of sets (rid, set) that several sets hold, and how many."""
    return sets.select(F.explode("set").alias("element")).groupBy("element").agg(F.count("*").alias("df")).where("df > 1")


def _rarest(sets: DataFrame, num: int, den: int, held_by: DataFrame | None = None) -> DataFrame:
    """Of each set (rid, set) its rarest elements, as far as one of them must be shared with every linked set: element, rid.
    held_by: _held_by(sets), best written, so that the shuffle which counts is gone before elements are dealt out with their sets.

    With elements ordered by the number of sets that hold them, two linked sets share one among the first
    n - ceil(num/den * n) + 1 of each: what many unlike sets share, as of a template, comes last and makes no pairs.
    """
    held = sets.select("rid", F.explode("set").alias("element")).join(held_by or _held_by(sets), "element")
    # elements of one set only come first in the order, and match nothing: only their number counts
    by_set = held.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("common")).join(sets.select("rid", F.size("set").alias("n")), "rid")
    left = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("common"))
    return by_set.where(left > 0).select("rid", F.explode(F.slice("common", F.lit(1), left.cast("int"))).alias("e")).select("e.element", "rid")


def _meetings(one: DataFrame) -> DataFrame:
    """Values of sig in one (sig, component) that several components hold, and the pairs of different components of each."""
    parts = one.groupBy("sig", "component").agg(F.count("*").alias("k"))
    by_sig = parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    return by_sig.where("parts > 1").select("sig", ((F.col("k") * F.col("k") - F.col("k2")) / 2).alias("pairs"))


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, pairs_per_element: float = 4.0) -> DataFrame:
    """Groups documents whose sets of `width`-word shingles have Jaccard similarity of num/den or more, transitively.

    docs: doc_id, text; other columns are ignored. Returns a row for each row of docs: doc_id, n_shingles, component_id (the
    smallest doc_id reachable, its own included).

    1. Each text's set is hashed to 64-bit shingles. Sets are put in size bands; a band's universe is cut into segments, and a
       set emits signatures of segments (cost-based: exact ones or one-deletion neighbourhoods) of its own band and of lower
       bands where partners may be. By the pigeonhole principle two linked sets share a signature.
    2. Equal sets collapse to their smallest doc_id, so a group of exact copies costs one set; a task emits the signatures of
       a repeated set once.
    3. Sharing a signature makes candidates. First all members of a signature's group are checked against one of them, links
       make components, and only groups that still hold several components go on: further hubs (HUBS of them a turn, by hash,
       so that a group of near copies falls together even where many of its pairs miss the threshold), and at last pairs of
       different components. Are those more than PAIRS a candidate set, as where a template gives many unlike sets a segment,
       which makes pairs with the square of its sets, the members left open meet by their rarest shingles instead (prefix
       filter); only where those would meet more often, signatures give the pairs, up to pairs_per_element for each shingle of
       all candidate sets. Candidates that sizes or
       parities (SKETCH) prove unlike go; every other one is checked exactly on the whole sets, so no link between components is
       lost, and a large group of near copies needs about one check for each member.

    Nulls and texts without words have empty sets (n_shingles 0) and are linked with nothing. Rows that share a doc_id are one
    node. A row whose doc_id is null never gives a group its name. An empty table gives an empty result.
    Shingles count as equal if their 64-bit hashes are, sets if two such sums of theirs are.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = bands(num, den, float(max(texts.count(), 1)), 1 << 40)
    spent: list[DataFrame] = []
    scanned = written(texts.mapInArrow(_scan(width), f"doc_id long, n_shingles long, mark1 long, mark2 long, {' long, '.join(SKETCH)} long"), "shingles")
    of = F.struct("n_shingles", *SKETCH)
    marks = scanned.where("n_shingles > 0").groupBy("mark1", "mark2").agg(F.min("doc_id").alias("rid"), *(F.min(c).alias(c) for c in ("n_shingles", *SKETCH)))
    marks = written(marks.where("rid is not null").select("mark1", "mark2", "rid", of.alias("of")), "sets")
    sigs = texts.select("text").mapInArrow(_signature_rows(width, plan, num, den), "sig long, mark1 long, mark2 long")
    ends = (f(m).alias(f"{f.__name__}_{m}") for m in ("mark1", "mark2") for f in (F.min, F.max))
    shared = sigs.groupBy("sig").agg(*ends).where("min_mark1 < max_mark1 or min_mark2 < max_mark2").select("sig")
    shared = written(shared, "shared-signatures")  # signatures are given anew rather than kept: a hot one is summed up by task here, and split by the join there
    pairs_of = written(sigs.join(shared, "sig"), "signatures")
    members = written(pairs_of.join(marks, ["mark1", "mark2"]).select("sig", "rid", "of").distinct(), "members")
    inside = members.select("rid").distinct()
    sets = texts.join(inside.withColumnRenamed("rid", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(width), "rid long, n long, wide array<long>, set array<long>")
    sets = written(sets, "candidate-sets")
    drop(pairs_of, shared)

    def may_link(x: str, y: str) -> Column:
        """False only for pairs that sizes or parities prove to be unlike."""
        apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in SKETCH))
        n, k = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        return ((den + num) * apart <= (den - num) * (n + k)) & (den * F.least(n, k) >= num * F.greatest(n, k))

    def check(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that WIDE parities leave in question, with their verdict."""
        seen = pairs.join(sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b").join(sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a")
        apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        seen = written(seen.where((den + num) * apart <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), "in-question")
        spent.append(seen)
        sized = seen.join(sets.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a")
        both = F.size(F.array_intersect("sa", "sb"))
        return sized.select("a", "b", (den * both >= num * (F.size("sa") + F.size("sb") - both)).alias("linked"))

    tested: DataFrame | None = None
    groups = None
    known = inside.select("rid", F.col("rid").alias("component"))
    within = sets.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("shingles")).first()
    spent += [members, sets]
    for turn in range(HUB_TURNS + 1):
        now = members.join(known, "rid", "left").select("sig", "rid", "of", F.coalesce("component", "rid").alias("component"))
        parts = now.groupBy("sig", "component").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("rid", F.pmod("sig", F.lit(HUBS)), F.lit(turn)).alias("h"), "rid", "of")).alias("hub"))
        still = parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.min(F.struct("hub", "component")).alias("hub")).where("parts > 1")
        still = written(still.select("sig", ((F.col("k") * F.col("k") - F.col("k2")) / 2).alias("pairs"), F.col("hub.hub.rid").alias("hub"), F.col("hub.hub.of").alias("hub_of"), F.col("hub.component").alias("part")), "open")
        spent.append(still)
        cost = still.agg(F.sum("pairs").alias("pairs"), F.count("*").alias("n")).first()
        if not cost["n"]:
            break
        most = pairs_per_element * within["shingles"]
        last = turn == HUB_TURNS or (turn > 0 and cost["pairs"] <= PAIRS * within["sets"])
        if last:
            one = now.join(still.select("sig"), "sig")
            if cost["pairs"] > min(most, PAIRS * within["sets"]):  # the same pairs in question, met by their rarest elements
                left = written(one.select("rid", "component", "of").distinct(), "left-open")
                # all sets take part until their elements are chosen: picking those left open first would shuffle whole sets
                held_by = written(_held_by(sets), "element-counts")
                rare = written(_rarest(sets, num, den, held_by).withColumnRenamed("element", "sig").join(left, "rid"), "rarest")
                drop(held_by)
                met = written(_meetings(rare), "meetings")
                spent += [left, rare, met]
                if cost["pairs"] > most or met.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] < cost["pairs"]:
                    one = rare.join(met.select("sig"), "sig")
            pairs = one.alias("x").join(one.alias("y"), F.expr("x.sig = y.sig and x.component < y.component") & may_link("x.of", "y.of")).select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"))
        else:
            pairs = now.join(still.drop("pairs"), "sig").where((F.col("component") != F.col("part")) & may_link("of", "hub_of")).select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b"))
        pairs = pairs.distinct()
        new = written(check(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")), "checked")
        spent.append(new)
        tested = new if tested is None else tested.unionByName(new)
        groups = components(tested.where("linked"))
        known = groups.withColumnRenamed("id", "rid")
        if last:
            break
    drop(*spent)
    named = marks.select("mark1", "mark2", "rid", F.lit(None).cast("long").alias("component")) if groups is None else marks.join(groups.withColumnRenamed("id", "rid"), "rid", "left")
    named = named.select("mark1", "mark2", F.coalesce("component", "rid").alias("component_id"))
    out = scanned.select("doc_id", "n_shingles", "mark1", "mark2").join(named, ["mark1", "mark2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
