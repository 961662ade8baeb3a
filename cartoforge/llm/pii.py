"""Personal data: formal patterns, and terms that the corpus shows to give protected entities away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop, native_words, written
from .spans import listed, readable, replaced, spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
#: Possessive and anchored at the start of a run (or where the last match ended): the same matches, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def entities(text: Column) -> Column:
    """Base spans of a text that went through readable()."""
    return F.concat(
        spans(text, "email", EMAIL, value=F.lower),
        spans(text, "ip", IP, lambda m: m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")),
        spans(text, "card", CARD, _luhn, _digits),
        spans(text, "phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15), _digits),
    )


def _near(text: Column, s: Column, reach: int) -> Column:
    """Words that stand whole within `reach` characters of a span."""
    left = F.greatest(s["start"] - reach, F.lit(0))
    shift = lambda found, by: F.transform(found, lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + by).alias("start"), (w["end"] + by).alias("end")))
    before = F.filter(shift(spans(F.substr(text, left + 1, s["start"] - left), "w", WORD), left), lambda w: ((w["start"] > left) | (left == 0)) & (w["end"] < s["start"]))
    after = F.filter(shift(spans(F.substr(text, s["end"] + 1, F.lit(reach)), "w", WORD), s["end"]), lambda w: (w["start"] > s["end"]) & (w["end"] < F.least(s["end"] + reach, F.length(text))))
    return F.concat(before, after)


def scan(docs: DataFrame, reach: int = 80, disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """Every row of docs with its spans: doc_id, spans (kind, start, end).

    docs: doc_id, text; other columns are ignored. Protected entities are the matches of the base kinds, terms all words of the
    documents that hold one. With D documents, e's information content is IC(e) = log2(D / df(e)), and
    PMI(t, e) = log2(df(t, e) * D / (df(t) * df(e))) says how much of it term t reveals, co-occurrence being counted by document.
    A term that stands in documents where e has `support` or more different surroundings (the words within `reach` characters
    of it: copies of a passage count once) and that reveals a share of `disclosure` or more of IC(e) becomes a span of kind term
    wherever it stands in a document that holds e, save where it overlaps a base span. df(t) counts all documents of the corpus.

    Entities with fewer surroundings go first; a pair with df(t) > D^(1 - disclosure) * df(e)^disclosure cannot tell, as
    df(t, e) <= df(e), and goes before it is counted. The other pairs of a document's entities and terms meet by row, so work
    grows with the documents, whatever entity is frequent. Only three counts reach the driver.
    Null texts are empty; repeated rows are scanned each on its own; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", readable(F.col("text")).alias("text"))
    base = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).select("doc_id", "row", "text", entities(F.col("text")).alias("found"))
    passage = lambda s: F.xxhash64(F.array_distinct(F.transform(_near(F.col("text"), s, reach), lambda w: w["term"])))
    full = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["kind"], s["value"]).alias("entity"), passage(s).alias("passage")))
    words = F.transform(spans(F.col("text"), "w", WORD, value=F.lower), lambda w: F.struct(w["value"].alias("term"), w["start"].alias("start"), w["end"].alias("end")))
    found = written(base.select("doc_id", "row", full.alias("found"), F.when(F.size("found") > 0, words).alias("words")), "pii")
    out = found.select("doc_id", "row", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    # of a row's surroundings of one entity `support` are enough to know whether there are that many
    some = F.slice(F.sort_array(F.collect_set("passage")), 1, support)
    held = found.select("row", F.explode("found").alias("s")).select("row", "s.entity", "s.passage").groupBy("row", "entity").agg(some.alias("passages")).select("row", "entity", F.posexplode("passages").alias("place", "passage"))
    first = F.count_if(F.col("place") == 0)
    total = found.count()
    known = held.groupBy("entity").agg(first.alias("df_e"), F.count_distinct("passage").alias("passages"))
    known = written(known.where((F.col("passages") >= support) & (F.col("df_e") < total)).select("entity", "df_e"), "pii-entities")
    most = known.agg(F.max("df_e")).first()[0]
    if most is None:
        drop(known)
        return out.select("doc_id", F.col("base").alias("spans"))
    bound = lambda df_e: F.pow(F.lit(float(total)), F.lit(1 - disclosure)) * F.pow(df_e, F.lit(disclosure)) * 1.000001
    held = written(held.join(known, "entity"), "pii-held")
    open_ = found.join(held.select("row").distinct(), "row", "left_semi")
    term = open_.select("row", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    df_t = texts.select(F.explode(F.array_distinct(F.transform(native_words(F.col("text")), F.lower))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")).where(F.col("df_t") <= bound(F.lit(float(most))))
    pairs = term.join(df_t, "term").join(held, "row").where(F.col("df_t") <= bound(F.col("df_e"))).select("row", "entity", "place", "passage", "term", "df_t", "df_e")
    pairs = written(pairs, "pii-pairs")
    counts = pairs.groupBy("entity", "term").agg(first.alias("df_te"), F.count_distinct("passage").alias("passages"), F.max("df_t").alias("df_t"), F.max("df_e").alias("df_e"))
    pmi = F.log2(F.col("df_te") * F.lit(float(total)) / (F.col("df_t") * F.col("df_e")))
    telling = counts.where((F.col("passages") >= support) & (pmi >= disclosure * F.log2(F.lit(float(total)) / F.col("df_e")))).select("entity", "term")
    told = written(pairs.where("place = 0").join(telling, ["entity", "term"], "left_semi").select("row", "term").distinct(), "pii-told")
    drop(known, held, pairs)
    places = _places(found, told).groupBy("row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("told"))
    free = F.filter(F.coalesce("told", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return out.join(places, "row", "left").select("doc_id", F.concat("base", F.sort_array(free)).alias("spans"))


def _places(found: DataFrame, told: DataFrame) -> DataFrame:
    """(row, start, end) of every word of found's rows that told (row, term) names."""
    some = found.join(told.select("row").distinct(), "row", "left_semi")
    return some.select("row", F.explode("words").alias("w")).select("row", "w.*").join(told, ["row", "term"]).select("row", "start", "end")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base, KINDS, False), 256).alias("base_sha256"), listed(F.col("spans"), KINDS, False).alias("spans"), count("term").alias("n_term"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with entities generalised to their kind and telling terms removed."""
    return replaced(text, found, lambda s: F.when(s["kind"] == "term", F.lit("[...]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
