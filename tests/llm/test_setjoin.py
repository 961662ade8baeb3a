import random

import pytest

from cartoforge.llm import common, setjoin
from cartoforge.llm.setjoin import allocate, bands, near_groups


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {(i, len(sets[i]), root(i)) for i in ids}


def texts(seed, n=200):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [r.choices(vocab, k=r.choice([1, 2, 3, 5, 8, 12, 20, 33, 47, 80, 150])) for _ in range(n // 3)]
    while len(out) < n:
        w = list(r.choice(out))
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(w) + 1)
            w[k : k + r.choice([0, 1])] = r.choices(vocab, k=r.choice([0, 1]))
        out.append(w or ["x"])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,width,num,pairs", [(1, 3, 90, 4.0), (2, 5, 80, 0.0), (3, 2, 50, 0.0), (4, 3, 90, 0.0)])
def test_same_groups_as_brute_force(spark, seed, width, num, pairs):
    rows = texts(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "ONE two"), (904, "one TWO"), (905, "É a b c"), (906, "é a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", __import__("pyspark").sql.functions.lit(1)).repartition(5)
    got = {tuple(r) for r in near_groups(df, width, num, 100, pairs_per_element=pairs).collect()}
    assert got == brute(rows, width, num, 100)


def test_large_group_of_near_copies(spark):
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 60 + 3] + [f"z{i}"] + base[i % 60 + 3 :])) for i in range(150)]
    assert {r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()} == {0}


def test_empty_table_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string, sigs string"
    assert near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f", None), (5, "a b c d e f", None), (None, "a b c d e f", None), (7, None, None)]
    got = sorted(map(tuple, near_groups(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7)], key=str)


def test_plan_covers_all_sizes():
    plan = bands(80, 100, 1e6, 10_000)
    assert all(b.high + 1 == c.low for b, c in zip(plan, plan[1:])) and plan[0].low == 1
    assert any(b.deletions for b in plan) and any(not b.deletions and b.keep for b in plan)
    assert allocate(40, 50, 12, 1e6).keep <= 13


def test_one_template_in_unlike_texts_makes_few_pairs(spark):
    from pyspark.sql import functions as F

    from cartoforge.llm.setjoin import _rarest

    r = random.Random(5)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"u{r.randrange(10**9)}" for _ in range(60)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, pairs_per_element=0.0).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    sets = [(i, [hash(x) for x in zip(t.split(), t.split()[1:], t.split()[2:])]) for i, t in rows]
    rare = _rarest(spark.createDataFrame(sets, "rid long, set array<long>"), 90, 100)
    assert rare.groupBy("element").count().agg(F.max("count")).first()[0] == 2


def test_template_pairs_are_given_up_before_they_are_many(spark, monkeypatch):
    made = {}
    keep = setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: made.setdefault(name, keep(df, name)) if name in ("rarest", "meetings") else keep(df, name))
    monkeypatch.setattr(setjoin, "drop", lambda *tables: None)
    r = random.Random(6)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"u{r.randrange(10**9)}" for _ in range(30)])) for i in range(40)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    got = {d.doc_id: d.component_id for d in setjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert made["rarest"].count() > 0 and made["meetings"].count() == 0  # unlike texts meet by a template's signatures only


def test_word_hashes_know_words():
    texts = [None, "", " \n", "One two\tONE\x0btwo", "\x00 \x1f a\x00  b Ää", "ab ba aab " + "x" * 5_000 + " " + "x" * 4_999 + " end", " tail ", "the " * 3_000]
    for block in (1, 7, 1 << 20):
        hashes, owner = common.word_hashes(texts, block)
        want = [(w, i) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
        assert owner.tolist() == [i for _, i in want]
        known = dict(zip(hashes.tolist(), (w for w, _ in want)))
        assert [known[h] for h in hashes.tolist()] == [w for w, _ in want] and len(known) == len({w for w, _ in want})
    assert [len(x) for x in common.word_hashes([])] == [0, 0]


def test_sets_of_short_and_long_texts():
    texts = ["a b", "A  B", "b a", "a b c", "a b c d", None, "a", "a b c a b c", "c a b"]
    h, d, n = setjoin.flat_sets(texts, 3)
    assert n.tolist() == [1, 1, 1, 1, 2, 0, 1, 3, 1]
    sets = [set(h[d == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] != sets[2] and sets[3] < sets[4] and sets[3] < sets[7] and sets[8] < sets[7]


def test_rarest_elements_shuffle_no_whole_sets(spark, monkeypatch):
    """Elements are dealt out from where their sets lie, after they were counted: no whole set is shuffled to pick those left open."""
    plans, keep = {}, setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    r = random.Random(6)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"u{r.randrange(10**9)}" for _ in range(30)])) for i in range(40)]
    assert setjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> component_id").count() == 0
    assert "element-counts" in plans and "LeftSemi" not in plans["rarest"]
