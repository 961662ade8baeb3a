"""Benchmark decontamination: a hash set of normalised test n-grams against all windows of the training words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spare

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of the benchmark's windows up to which their hash set is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def bench_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _windows(words: Column, hashes: Column, n: int) -> Column:
    """(position, length, hash) of all windows of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(F.slice(hashes, i + 1, n)).alias("hash")))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Windows of all items with the items they come from: n, hash, words, items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), bench_words(F.col("text").cast("string")).alias("words")).where("size(words) > 0")
    n = F.least(F.size("words"), F.lit(window))
    starts = words.select("item_id", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    cut = starts.select("item_id", "n", F.slice("words", F.col("at") + 1, F.col("n")).alias("cut"))
    return cut.groupBy("n", "cut").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select("n", F.xxhash64(F.transform("cut", lambda w: F.xxhash64(w))).alias("hash"), "cut", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Rows of docs with hits: doc_id, mark (hash of the text), spans (first word, number of words), items (sorted).

    The windows of the benchmark are few next to the training words: measured first, they are broadcast if they are small and
    joined by a shuffle of hashes otherwise. A hash hit is verified word by word. Nulls and texts without words have no windows;
    repeated rows give one row here.
    """
    known = benchmark_windows(benchmark, window)
    size = F.sum(F.length(F.array_join("cut", " ")) + F.lit(50) + 20 * F.size("items"))
    by_length = {r["n"]: r["b"] for r in known.groupBy("n").agg(size.alias("b")).collect()}  # window rows at most
    small = sum(by_length.values()) <= BROADCAST_BYTES
    words = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), bench_words(F.col("text")).alias("words"))
    if not by_length:
        return words.limit(0).select("doc_id", "mark", F.array().cast("array<struct<pos:int,n:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    hashed = words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    grams = F.concat(*(_windows(F.col("words"), F.col("hashes"), n) for n in sorted(by_length)))
    if small:
        seen = hashed.select("doc_id", "mark", "words", F.explode(grams).alias("w")).select("doc_id", "mark", "words", "w.pos", "w.n", "w.hash")
        hits = seen.join(F.broadcast(known), ["n", "hash"]).where(F.slice("words", F.col("pos") + 1, F.col("n")) == F.col("cut"))
    else:  # only hashes and places are shuffled; the words of a text meet its hits afterwards
        seen = hashed.select("doc_id", "mark", F.explode(grams).alias("w")).select("doc_id", "mark", "w.pos", "w.n", "w.hash")
        found = seen.join(known, ["n", "hash"]).groupBy(F.col("doc_id").alias("in_id"), F.col("mark").alias("in_mark")).agg(F.collect_set(F.struct("pos", "n", "cut", "items")).alias("found"))
        met = words.distinct().join(found, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("mark") == F.col("in_mark")))
        hits = met.select("doc_id", "mark", "words", F.explode("found").alias("f")).select("doc_id", "mark", "words", "f.*").where(F.slice("words", F.col("pos") + 1, F.col("n")) == F.col("cut"))
    return hits.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated."""
    hits = contamination(docs, benchmark, window)
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), covered.cast("long").alias("n_hit"), "items")
    text = F.col("text").cast("string")
    all_docs = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.size(bench_words(text)).cast("long").alias("n_words"))
    out = all_docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns stay, whatever their names.

    Repeated rows go or stay together; null and empty texts stay; an empty benchmark or table changes nothing.
    """
    hit_id, hit_mark = spare(docs, "hit_id", "hit_mark")
    hits = contamination(docs, benchmark, window).select(F.col("doc_id").alias(hit_id), F.col("mark").alias(hit_mark))
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hit_mark)), "left_anti")
