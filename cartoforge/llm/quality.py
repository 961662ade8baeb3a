"""Quality classifier learnt from trusted positives and unlabelled text: non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, slices, text_bytes

_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
N_FEATURES = len(_PUNCT) + 20


def features(text: str | None) -> np.ndarray:
    """Shares and shapes of the whole text; all in about 0..1."""
    b = text_bytes(text)
    words = b.split()
    n = len(words)
    out = np.zeros(N_FEATURES)
    if not n:
        out[-1] = 1.0
        return out
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    solid = max(1, len(b) - hist[32] - hist[9:14].sum())
    out[: len(_PUNCT)] = np.minimum(hist[_PUNCT] / n, 4.0)
    lines = b.split(b"\n")
    distinct, pairs = len(set(words)), len(set(zip(words, words[1:])))
    trios = len(set(zip(words, words[1:], words[2:])))
    full = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = [w[-1] for w in words]
    out[len(_PUNCT) :] = [
        hist[65:91].sum() / solid, hist[97:123].sum() / solid, hist[48:58].sum() / solid, hist[128:].sum() / solid, np.log1p(n) / 10, lengths.mean() / 10,
        min(lengths.std() / 10, 2), lengths.max() / 100 if lengths.max() < 200 else 2.0, distinct / n, distinct / n**0.8, pairs / max(1, n - 1), trios / max(1, n - 2),
        len(set(full)) / max(1, len(full)), min(len(full) / n, 1.0), sum(map(bytes.isalpha, words)) / n, sum(map(bytes.isupper, words)) / n,
        sum(e in b".,;:!?" for e in ends) / n, (lengths == 1).sum() / n, (lengths > 20).sum() / n, 0.0,
    ]
    return out


@dataclass
class Model:
    """A small network over centred features; cut is the logit that an estimated share `prior` of unlabelled texts passes."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    cut: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; 0.7 where the logit is at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.logit(x) - self.cut + np.log(0.7 / 0.3), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500, batch: int = 1024, seed: int = 7) -> Model:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the sigmoid loss.

    Where the second term falls below zero, a step is taken against it (Kiryo et al. 2017).
    """
    r = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((a - mean) / scale, -6, 6) for a in (positive, unlabelled))
    d = both.shape[1]
    w = [r.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        p, u = zp[r.integers(0, len(zp), batch)], zu[r.integers(0, len(zu), batch)]
        x = np.concatenate([p, u])
        h = np.maximum(x @ w[0] + w[1], 0)
        g = h @ w[2] + w[3][0]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of label -1; 1 - s is that of label +1
        sp, su, slope = s[:batch], s[batch:], s * (1 - s)
        gap = su.mean() - prior * sp.mean()
        dg = np.zeros_like(g)
        if gap >= 0:
            dg[:batch] = (-prior - prior) * slope[:batch] / batch
            dg[batch:] = slope[batch:] / batch
        else:
            dg[:batch] = prior * slope[:batch] / batch
            dg[batch:] = -slope[batch:] / batch
        dh = np.outer(dg, w[2]) * (h > 0)
        grads = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ dg + 1e-4 * w[2], np.array([dg.sum()])]
        for k, gr in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * gr
            m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
            w[k] = w[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), 0.0, prior)
    model.cut = _cut(model.logit(unlabelled), model.logit(positive), prior)
    return model


def _cut(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The middle of the widest gap of unlabelled logits whose share above is near the prior, below all but few positives."""
    u = np.sort(unlabelled)
    at = int((1 - prior) * len(u))
    lo, hi = max(0, int(at * 0.5)), min(len(u) - 1, int(at * 1.15) + 1)
    if hi - lo < 2:
        return float(u[min(at, len(u) - 1)])
    hi = max(lo + 2, min(hi, int(np.searchsorted(u, np.quantile(positive, 0.01)))))
    hi = min(hi, len(u) - 1)
    k = lo + int(np.argmax(np.diff(u[lo : hi + 1])))
    return float((u[k] + u[k + 1]) / 2)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Cache.alone()
    for b in slices(batches):
        x = [features(t).tolist() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "trusted", "x"])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 6000, most_unlabelled: int = 12000) -> Model | None:
    """Fits on a bounded sample: of labels (doc_id, quality) the most_positive rows of quality 1 with the lowest hashes, and
    the most_unlabelled rows of docs with the lowest hashes, whose labels aren't looked at. The class prior is estimated from
    all rows of labels; rows that share a doc_id count once. None if there are no positives, or no rows."""
    rated = labels.where("quality is not null and doc_id is not null").agg(F.avg("quality").alias("prior")).first()
    if not rated["prior"]:
        return None
    order = lambda d: d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    positive = order(labels.where("quality = 1")).limit(most_positive).withColumn("trusted", F.lit(True))
    other = order(docs.where("doc_id is not null")).limit(most_unlabelled).withColumn("trusted", F.lit(False))
    chosen = F.broadcast(positive.union(other))  # at most most_positive + most_unlabelled ids
    got = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.col("text").cast("string"), "trusted").mapInArrow(_rows, "doc_id long, trusted boolean, x array<double>")
    rows = got.groupBy("doc_id", "trusted").agg(F.min("x").alias("x")).collect()  # one row an id: most_positive + most_unlabelled at most
    rows.sort(key=lambda r: (r["trusted"], r["doc_id"], r["x"]))
    p, u = (np.array([r["x"] for r in rows if r["trusted"] == t]).reshape(-1, N_FEATURES) for t in (True, False))
    if not len(p) or not len(u):
        return None
    return fit(p, u, min(max(float(rated["prior"]), 0.01), 0.99))


def score(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row of docs (all columns) with two more, called by names: score and predicted (1 if score >= 0.7).

    Only the text is looked at; a null one counts as empty, a very long one is taken whole. Repeated rows are scored alike; an
    empty table gives no rows. Without a model (no positives) every score is 0.5. A column of docs that already has one of the
    names raises an error: nothing is overwritten.
    """
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.alone()
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            s = held.value.score(np.array([features(t) for t in texts])) if held.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.7).astype(np.int32))], [*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)
