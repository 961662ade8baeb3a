"""Registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, ctw, decontam, licenses, neardup, negatives, packing, pii, quality, rules, secrets, setjoin
from .common import table


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    open_docs = docs.where("not held_out")
    labels = table(spark, sf_dir, "labels").where(fold(4) != 2)
    return quality.score(docs, quality.train(open_docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(5) == 1))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_tree(table(spark, sf_dir, "conversations").select(*more.columns).union(more)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.token_links(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0, repeats=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scans": op3_license_scans,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_secret_scans": op5_secret_scans,
    "op6_packing": op6_packing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}

def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""

_TEMPLATES = [(k, licenses.bigrams(x)) for k, xs in licenses.TEMPLATES.items() for x in xs]
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LICENSE_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', [{_texts(g)}])" for k, g in _TEMPLATES)}) v(license, g)),
d AS (SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_concat(lines, list_filter(string_split_regex(x, '\n[\x20\t\r]*\n'), lambda p: contains(p, chr(10)) AND length(p) < length(x)), [x]) ELSE lines END) AS text FROM d),
w AS (SELECT row_number() OVER () AS unit, doc_id, list_filter(string_split_regex({_LOW}, '{_GAPS}'), lambda w: w <> '') AS w FROM u),
b AS (SELECT unit, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT unit, doc_id, license, 2e0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM b JOIN t ON len(g) * 85 <= len(b) * 115 AND len(b) * 85 <= len(g) * 115),
h AS (SELECT unit, doc_id, license, dice FROM m WHERE dice * 100 >= 85 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, license) = 1),
o AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS top FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n, 0) AS n_matches, coalesce(licenses, '') AS licenses, (SELECT min(license) FROM h WHERE h.doc_id = d.doc_id AND h.dice = o.top) AS best_license, round(top, 6) AS best_dice FROM d LEFT JOIN o USING (doc_id)"""


def _kind_sql(kind: str, pattern: str, keep: str, value: str = "m[i]") -> str:
    """Matches of a pattern with their places, from what stands between them."""
    p = pattern.replace("'", "''")
    cut = f"SELECT doc_id, source, text, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g FROM t"
    at = "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"SELECT doc_id, source, text, '{kind}' AS kind, {at} AS a, {at} + length(m[i]) AS z, {value} AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({cut}) x) y WHERE {keep}"


_ASSIGN_VALUE = "regexp_extract(m[i], '" + secrets.ASSIGN.replace("'", "''") + "', 2)"
_OPAQUE_KEEP = "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')"
_PLACE = "CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 ELSE 4 END"
_LISTED = f"string_agg(kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(z AS VARCHAR), ',' ORDER BY a, {_PLACE}, z)"
_SECRET_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, translate(coalesce(text, ''), chr(1), chr(65533)) AS t FROM documents),
f AS ({_kind_sql('assign', secrets.ASSIGN, f'length({_ASSIGN_VALUE}) >= 12', _ASSIGN_VALUE)} UNION ALL {_kind_sql('access', 'AKIA[A-Z0-9]+', 'length(m[i]) >= 18')}
 UNION ALL {_kind_sql('hex', '[0-9a-f]{16,}', 'true')} UNION ALL {_kind_sql('opaque', '[A-Za-z0-9+/_-]{24,}', _OPAQUE_KEEP)}),
h AS (SELECT value, count(DISTINCT text) AS texts, count(DISTINCT source) AS owners FROM f GROUP BY value),
s AS (SELECT f.*, NOT (owners > 2 AND owners * 2 >= texts AND owners >= sqrt((SELECT count(DISTINCT source) FROM t))) AND NOT (kind = 'hex' AND NOT regexp_matches(f.value, '[a-f]')) AS live FROM f JOIN h USING (value)),
k AS (SELECT * FROM s WHERE kind <> 'opaque' OR (live AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind <> 'opaque' AND o.a < s.z AND s.a < o.z))),
g AS (SELECT doc_id, CAST(count_if(kind = 'assign') AS BIGINT) AS n_assign, CAST(count_if(kind = 'access') AS BIGINT) AS n_access, CAST(count_if(kind = 'hex') AS BIGINT) AS n_hex, {_LISTED} FILTER (WHERE kind <> 'opaque') AS base, {_LISTED} AS spans,
 CAST(count_if(live) AS BIGINT) AS n_live, CAST(count_if(NOT live) AS BIGINT) AS n_copied FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN g USING (doc_id)"""

_BENCH_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_NEAR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op12_embedding_near_dedup": _NEAR_SQL,
    "op13_hard_negative_mining": _NEGATIVES_SQL,
    "op1_ngram_jaccard_join": _JACCARD_SQL,
    "op3_license_scans": _LICENSE_SQL,
    "op5_secret_scans": _SECRET_SQL,
    "op10_benchmark_decontamination": f"""
WITH b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS cut
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, w[i : i + n - 1] AS cut FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.cut = bw.cut),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)""",
}
