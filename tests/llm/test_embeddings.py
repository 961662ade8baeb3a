"""Near duplicates and hard negatives among vectors, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from cartoforge.llm import neardup, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(n=1500, dims=64, seed=3):
    """Random vectors, a dense group of a third of them, pairs at many angles, copies."""
    rng = np.random.default_rng(seed)
    base = unit(rng.standard_normal((n, dims)))
    third = n // 3
    base[:third] = unit(base[0] + 0.1 * unit(rng.standard_normal((third, dims))) * rng.random((third, 1)))
    twins = unit(base[third : third + 200] + np.linspace(0.05, 0.4, 200)[:, None] * unit(rng.standard_normal((200, dims))))
    return np.concatenate([base, twins, base[-50:], np.repeat(base[-1:], 40, 0)]).astype(np.float32)


def all_pairs(x, cosine=0.95):
    u = unit(x.astype(np.float64))
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(linked, root[None], len(x)).min(1))
        if (low == root).all():
            return linked.sum(1), root
        root = low


@pytest.mark.parametrize("probe", [4.0, 8.0])
def test_links_and_components(spark, probe):
    x = planted()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r for r in neardup.near_vectors(df, probe=probe).collect()}
    n, root = all_pairs(x)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * n.sum() and all(got[i].n_links <= n[i] for i in got)
    if probe == 8.0:  # the square root of 64 dimensions: no link is missed
        assert [got[i].n_links for i in range(len(x))] == n.tolist()
        assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_dense_group_is_counted_not_paired(spark):
    """Three tasks of a dense group: its pairs come from shells, so few trips are made."""
    x = planted(3000)[:1000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neardup.near_vectors(df).collect()
    assert {r.n_links for r in got} == {999} and {r.component_id for r in got} == {0}
    index = neardup.train(unit(x.astype(np.float64)), 100, 0.95)
    assert len(index.centres) < 5


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 7)
    monkeypatch.setattr(neardup, "QUERIES", 11)
    x = planted(300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_vectors(df, probe=9.0).collect())
    n, root = all_pairs(x)
    assert got == [(i, n[i], root[i]) for i in range(len(x))]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 0.0, 0.0], "a"), (5, [float("nan"), 1.0, 0.0], "a"), (6, [None, 1.0, 0.0], "a")]
    rows += [(7, [1e-40, 0.0, 0.0], "a"), (8, [0.0, 3e38, 3e38], "a"), (8, [0.0, 1.0, 1.0], "a"), (None, [1.0, 0.0, 0.0], "a"), (9, [float("inf"), 0.0, 0.0], "a"), (10, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_vectors(df).collect()), key=str)
    own = [(i, 0, i, True) for i in (3, 4, 5, 6, 9, 10)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (7, 2, 1, False), (8, 1, 8, True), (8, 1, 8, True), (None, 0, None, False), *own], key=str)
    assert neardup.near_vectors(df.where("false")).collect() == []


def test_code_distance_never_exceeds(spark):
    """A member's distance by table lookup, less its error, is at most the real one."""
    x = unit(np.random.default_rng(1).standard_normal((500, 20)))
    index = neardup.train(x, 20, 0.95)
    run, _ = neardup._encode(index, 1.0)
    batch = pa.record_batch({"rep": pa.array(range(500)), "copies": pa.array([1] * 500), "embedding": pa.array(x.tolist())})
    t = pa.Table.from_batches(list(run(iter([batch]))))
    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(500, -1).astype(np.int64)
    decoded = index.centres[t.column("cell").to_numpy()] + index.decoded(codes)
    wide = np.pad(x, ((0, 0), (0, decoded.shape[1] - 20)))
    assert (np.linalg.norm(wide[0] - decoded, axis=1) - t.column("error").to_numpy() <= np.linalg.norm(wide[0] - wide, axis=1) + 1e-9).all()


def mined(rows, every=10, k=3, most=4, low=30, high=90):
    ok = {(i, lab, tuple(np.float32(e).tolist())) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)}
    ok = [(i, lab, np.floor(256 * np.array(e, np.float64)).astype(object)) for i, lab, e in ok]
    out = []
    for i, lab, q in ok:
        if i % every:
            continue
        score = lambda r: int(sum(int(a) * int(b) for a, b in zip(q, r[2])))
        own = sorted((-score(r), r[0]) for r in ok if r[0] != i and r[1] == lab)[:k]
        for s, p in own:
            s = -s
            far = sorted((-score(r), r[0]) for r in ok if r[1] != lab and low * s <= 100 * score(r) <= high * s)[:most]
            out += [(i, p, n + 1, f, s, -m) for n, (m, f) in enumerate(far)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "MOST", 64)
    monkeypatch.setattr(negatives, "LEAST", 16)
    rng = np.random.default_rng(5)
    x = np.round(unit(rng.standard_normal((400, 8))), 1)  # many ties
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(400 + i, [0.0] * 8, 1) for i in range(5)] + [(410, (-x[0]).tolist(), 0), (411, None, 1), (412, x[1].tolist(), None), (None, x[2].tolist(), 1), (413, [None] * 8, 1), (414, [float("nan")] * 8, 2), (415, [float("inf")] * 8, 2)]
    rows += [rows[10], rows[10], rows[20]]  # repeated rows are one
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, row string")
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0, 3, 4)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert negatives.hard_negatives(df.where("false"), F.col("label"), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e7, -3.0], 0), (1, [9e6, 1.0], 0), (2, [5e6, 2.0], 1), (3, [4.9e6, 2e6], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0, 3, 4)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_threshold_stops_early():
    """On lists with one leading row the threshold falls below the kth score long before all rows are met."""
    rows = np.floor(np.random.default_rng(2).random((5000, 4)) * 20)
    rows[1234] = 1000
    lists = negatives.Lists(np.arange(5000), np.zeros(5000, int), rows)
    met = []
    scored = negatives.whole_scores
    negatives.whole_scores = lambda r, a: met.append(len(r)) or scored(r, a)
    try:
        ((at, score),) = lists.search(np.array([3.0, 2.0, 1.0, 1.0]), np.ones(5000, bool), [-(2**63)], [2**63 - 1], 1)
    finally:
        negatives.whole_scores = scored
    assert at.tolist() == [1234] and score.tolist() == [7000] and sum(met) < 100


def test_query_takes_every_row_as_its_own(spark, tmp_path):
    """The contract counts rows: a repeated negative is there twice, a repeated anchor is its copy's positive."""
    from cartoforge.llm import queries

    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.25, 0.0], 3), (5, [0.5, 0.0], 1)]
    get = lambda at: sorted(map(tuple, queries.op13_hard_negative_mining(spark, str(at)).collect()))
    for name, more in (("a", []), ("b", [(0, [1.0, 0.0], 1)])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(rows + more, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    # vec_id 0 is divisible by 7: its label becomes 2
    assert get(tmp_path / "a") == [(0, 2, 1, 3, 32768, 16384)] * 2
    assert get(tmp_path / "b") == sorted([(0, 0, 1, 5, 65536, 32768)] * 2 + [(0, 2, 1, 3, 32768, 16384)] * 4)
