"""The pipeline, stage by stage, against plain Python where the stage has such a version."""

import os
import sys

import duckdb

import corpus_pipeline
from cartoforge.llm import common, packing, quality

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    kept = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    columns = docs.columns
    before = kept["documents"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "quality_classifier":
            assert 0.6 < len(now) / len(before) < 1
        if name == "ngram_jaccard_join":
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()} for i, t in before.items() for w in [brute.words(brute.low(t or ""))]}
            alike = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
            ids = sorted(before)
            up = {i: i for i in ids}

            def root(i):
                while up[i] != i:
                    i = up[i]
                return i

            for n, i in enumerate(ids):
                for j in ids[n + 1 :]:
                    if 0.75 < len(sets[i]) / max(1, len(sets[j])) < 1.34 and alike(sets[i], sets[j]):
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
            assert set(now) == {i for i in ids if root(i) == i}
        if name == "benchmark_decontamination":
            assert set(now) == {i for i, v in brute.bench(before.items(), items).items() if not v[4]}
        if name == "secret_scans":
            assert set(now) == set(before) and all(now[i] == t for i, t in before.items() if not brute.secrets(t))
        before = now


def test_features_of_awkward_texts():
    for t in (None, "", " \n", "\x00", "é", "a" * 100_000):
        assert quality.features(t).shape == (quality.N_FEATURES,)


def test_python_stages_read_small_batches(spark, sf_dir):
    """A stage's caller writes with the session's batches, 10,000 rows by default; whole texts and tokens must not meet Python in those."""
    docs, name = spark.read.parquet(f"{sf_dir}/documents.parquet"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.pack):
            spark.conf.unset(name)
            stage(spark, docs, sf_dir)
            assert int(spark.conf.get(name)) <= 1024
        spark.conf.set(name, "100")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.unset(name)


def test_training_empties_what_other_operators_remember():
    left = common.Cache()
    left["piece"] = b"ids"
    known = packing._Pieces(packing.VOCABULARY)
    ids = known.ids(["a text"])
    assert not list(quality._rows(iter([]))) and not left and not known and "coder" not in vars(known)
    assert known.ids(["a text"]) == ids
