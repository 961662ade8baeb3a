"""Quality rules: text statistics by DataFrame functions, and a decision list learnt from labelled ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, native_words, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "other", "distinct", "single", "per_line")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(words: Column, window: int) -> Column:
    """Words inside windows of so many words that occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda k, by: F.coalesce(F.get(s, k)["h"] == F.get(s, k + by)["h"], F.lit(False))
            at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, -1) | same(k, 1), F.get(s, k)["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        def step(acc: Column, i: Column) -> Column:
            return F.struct((i + window).alias("end"), (acc["n"] + i + window - F.greatest(i, acc["end"])).alias("n"))

        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        count = F.aggregate(let(ordered, places), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(count)

    grams = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))
    many = lambda w: F.when(F.size(w) >= window, let(let(F.transform(w, lambda x: F.xxhash64(x)), grams), covered)).otherwise(0)
    return many(words)


def statistics(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, base statistics and the FEATURES made of them; null texts count as empty."""
    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("words", native_words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    s = t.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"), _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        counted.alias("lines"), _repeated(F.col("words"), 8).cast("long").alias("n_repeat_words"), _count(F.col("text"), UPPER).alias("n_upper"), _count(F.col("text"), LOWER).alias("n_lower"), _count(F.col("text"), "0123456789").alias("n_digits"),
        _count(F.col("text"), "!?~^=+_@/\\").alias("n_marks"), _count(F.col("text"), ".,;:'\"()-").alias("n_stops"), F.size(F.array_distinct("words")).alias("n_distinct"), F.size(F.filter("words", lambda w: F.length(w) == 1)).alias("n_single"),
    )
    n, c = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    made = {
        "mean_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / c, "dup_lines": F.col("lines.again") / F.greatest(F.col("lines.n"), F.lit(1)), "repeats": F.col("n_repeat_words") / n, "upper": F.col("n_upper") / c,
        "digits": F.col("n_digits") / c, "marks": F.col("n_marks") / c, "other": (c - F.col("n_upper") - F.col("n_lower") - F.col("n_digits") - F.col("n_stops")) / c, "distinct": F.col("n_distinct") / n, "single": F.col("n_single") / n,
        "per_line": n / F.greatest(F.col("lines.n"), F.lit(1)),
    }
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.again").cast("long").alias("n_dup_lines"), "n_repeat_words", *(e.cast("double").alias(k) for k, e in made.items()))


@dataclass
class Rule:
    """A conjunction of (feature, is_at_least, threshold); what it covers is rejected."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, up, at in self.tests:
            v = x[:, FEATURES.index(name)]
            out &= v >= at if up else v <= at
        return out

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(n) >= F.lit(at) if up else F.col(n) <= F.lit(at) for n, up, at in self.tests))


def learn(x: np.ndarray, bad: np.ndarray, most_tests: int = 3, precision: float = 0.8, seed: int = 3) -> list[Rule]:
    """Sequential covering: a rule is grown on two thirds of the rows by information gain, pruned from its end on the others,
    kept while it is precise on both, and what it covers is taken away."""
    r = np.random.default_rng(seed)
    grow_part = r.random(len(x)) < 2 / 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while (left & bad & grow_part).sum() >= 3:
        g, p = left & grow_part, left & ~grow_part
        rule, cover = Rule(), g.copy()
        while len(rule.tests) < most_tests:
            pos, neg = (cover & bad).sum(), (cover & ~bad).sum()
            if not neg:
                break
            was, best = np.log2(pos / (pos + neg)), (0.0, None)
            for k, name in enumerate(FEATURES):
                v = x[cover, k]
                y = bad[cover]
                order = np.argsort(v, kind="stable")
                sv, cp = v[order], np.concatenate(([0], np.cumsum(y[order])))
                cuts = np.flatnonzero(sv[1:] > sv[:-1]) + 1
                for up in (True, False):
                    a = (pos - cp[cuts]) if up else cp[cuts]
                    b = (len(sv) - cuts - a) if up else cuts - a
                    gain = a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1)) - was)
                    if len(gain) and gain.max() > best[0] + 1e-9:
                        c = cuts[int(gain.argmax())]
                        best = (float(gain.max()), (name, up, float((sv[c - 1] + sv[c]) / 2)))
            if best[1] is None:
                break
            rule.tests.append(best[1])
            cover &= rule.mask(x)
        value = lambda t: (lambda m: ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum()))(Rule(t).mask(x) & p)
        if not rule.tests:
            break
        rule.tests = rule.tests[: max(range(1, len(rule.tests) + 1), key=lambda k: (value(rule.tests[:k]), -k))]
        mine = rule.mask(x) & left
        if not (mine & bad).sum() or any((m & bad).sum() < precision * m.sum() for m in (mine & g, mine & p)):
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def train(stats: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> list[Rule]:
    """The decision list for rows of labels (doc_id, quality); of them, the most_rows with the lowest hashes are used."""
    order = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(most_rows)
    rows = stats.join(F.broadcast(order), "doc_id").groupBy("doc_id", "quality").agg(*(F.min(f).alias(f) for f in FEATURES)).collect()  # most_rows at most
    rows.sort(key=tuple)
    if not rows:
        return []
    a = np.array([[float(v) for v in r] for r in rows])
    return learn(a[:, 2:], a[:, 1] == 0)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs: statistics, base_failed, kept, and rule (the number of the first rule that rejects it, or null).

    The statistics are made once and written; the rules, learnt from bounded labelled rows of them, become one ordered chain of
    Spark conditions. Without labels there are no rules. Null and empty texts have no words and fail the base.
    """
    stats = written(statistics(docs), "text-statistics")
    rules = train(stats, labels)
    chain = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        chain = F.when(rules[k].column(), F.lit(k + 1)).otherwise(chain)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", chain).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
