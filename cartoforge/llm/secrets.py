"""Secret scans: candidates by pattern, told apart by how many texts and owners hold them across the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, written
from .spans import listed, readable, replaced, spans

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Strings of 24 or more characters with a digit and letters of both cases, as keys and tokens of many services are.
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"


def candidates(text: Column) -> Column:
    t = readable(text)
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return F.concat(
        spans(t, "assign", ASSIGN, long_value, lambda m: F.regexp_extract(m, ASSIGN, 2)),
        spans(t, "access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 18),
        spans(t, "hex", "[0-9a-f]{16,}"),
        spans(t, "opaque", OPAQUE, mixed),
    )


def scan(docs: DataFrame, few_owners: int = 2) -> DataFrame:
    """Every row of docs with its spans: doc_id, row, spans (kind, start, end, texts, owners, live).

    docs: doc_id (a repository's file), text, and source (its owner) if there; other columns are ignored. The hash of each
    candidate's value is counted over the whole corpus: distinct texts (copies of one text count once) and distinct owners that
    hold it. It is a widely copied example if more than few_owners owners hold it, at least one owner for every two texts, and
    no fewer than the square root of the owners in the corpus; or if it is a number without letters. Others are live-looking,
    in however many documents of an owner, or in a mirror or two, they stand. Spans of
    kind opaque are returned only where they are live-looking and lie in no other span; those of the base kinds always.
    Counts are pre-aggregated, a value is counted once for each text and owner, and a value held by a third of all rows only
    meets in partial sums; the join back is one that Spark can split. Null texts have no spans; null owners count as one.
    """
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", owner.alias("owner"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    found = base.select("doc_id", "row", F.coalesce("owner", F.lit("")).alias("owner"), F.xxhash64("text").alias("mark"), F.transform(candidates(F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), ((s["kind"] == "hex") & ~s["value"].rlike("[a-f]")).alias("number"))).alias("found"))
    found = written(found, "secret-candidates")
    one = found.select("row", "owner", "mark", F.explode("found").alias("s")).select("row", "owner", "mark", "s.*")
    n_owners = found.select("owner").distinct().count()
    held = one.select("hash", "owner", "mark").distinct()
    holders = held.groupBy("hash").agg(F.countDistinct("mark").alias("texts"), F.countDistinct("owner").alias("owners"))
    copied = (F.col("owners") > few_owners) & (F.col("owners") * 2 >= F.col("texts")) & (F.col("owners") >= math.sqrt(n_owners))
    told = one.join(holders, "hash").withColumn("live", ~copied & ~F.col("number"))
    by_row = told.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "texts", "owners", "live")).alias("all"))
    inside = lambda s, x: (x["kind"] != "opaque") & (x["start"] < s["end"]) & (s["start"] < x["end"])
    kept = F.filter("all", lambda s: (s["kind"] != "opaque") | (s["live"] & ~F.exists("all", lambda x: inside(s, x))))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,texts:bigint,owners:bigint,live:boolean>>")
    return found.select("doc_id", "row").join(by_row.select("row", kept.alias("spans")), "row", "left").select("doc_id", "row", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base, KINDS, True), 256).alias("base_sha256"),
        listed(F.col("spans"), KINDS, True).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, few_owners: int = 2) -> DataFrame:
    """docs with every live-looking secret replaced by [SECRET:kind]; all rows and columns stay, n_chars follows the text.

    Rows are told apart by doc_id and the hash of the text, so repeated rows are redacted alike. Null and empty texts stay as
    they are; columns of any other name are untouched; an empty table stays empty.
    """
    hit_id, hit_mark, hit, redacted = spare(docs, "hit_id", "hit_mark", "hit", "redacted")
    mark = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.select(F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "text", *(["source"] if "source" in docs.columns else []))
    live = scan(keyed, few_owners).select(F.col("doc_id.doc_id").alias(hit_id), F.col("doc_id.mark").alias(hit_mark), F.filter("spans", lambda s: s["live"]).alias(hit)).where(F.size(hit) > 0)
    live = live.groupBy(hit_id, hit_mark).agg(F.min(hit).alias(hit))
    out = docs.join(live, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (mark == F.col(hit_mark)), "left")
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col(hit), lambda s: F.concat(F.lit("[SECRET:"), s["kind"], F.lit("]"))))
    out, new = out.withColumn(redacted, text), {"text": F.col(redacted)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(hit).isNull(), F.col("n_chars")).otherwise(F.length(redacted)).cast(docs.schema["n_chars"].dataType)
    return out.select(*((new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns))
