"""Token alignment against a plain version that looks at every token and document."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest

from cartoforge.llm import align

ODD = ["", None, "a", " a", "a ", "  a  b ", "a\n\n b", "a ▁b", "==" * 700, "ñ①½ \x00 <s> <|endoftext|> a\x1cb \x1c c", "   ", "a\tb c\td", "\n", "😀 😀😀 " + "あ" * 300, "x" * 4000, "don't  we'll\r\n 12345 6", "a b  c  d", "'s 's"]


def plain(texts):
    coder = align._aligner(align.VOCABULARY, align.MODEL)
    found = []
    for t in texts:
        a = coder.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = coder.b.encode(t) if t else []
        said_a, said_b = [coder.bytes_a[i] for i in a], [coder.bytes_b[i] for i in b]
        if not t or b"".join(said_a) != (" " + t).encode() or b"".join(said_b) != (" " + t).encode():
            found.append((0, 0, 0, 0, 0, "", Counter()))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (said_a, said_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in both]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(both, e)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        over = sum(1 for e, k in zip(ends_a, map(len, said_a)) for f, m in zip(ends_b, map(len, said_b)) if max(e - k, f - m) < min(e, f)) if len(a) < 300 else len(a) + len(b) - len(both)
        found.append((len(a), len(b), len(both), over, sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), links))
    docs = Counter(k for f in found for k in f[6])
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    return [(*f[:6], sum(n for (x, y), n in f[6].items() if docs[x, y] == most[x]), sum(n * docs[k] for k, n in f[6].items())) for f in found]


@pytest.mark.parametrize("chunk", [40, align.CHUNK])
def test_against_plain(spark, sf_dir, chunk):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ODD[:5] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'other' AS n_a", "0 AS chunk").repartition(3)
    got = {r.doc_id: r for r in align.token_links(df, chunk_pairs=chunk).collect()}
    names = [*align.COUNTS, "groups_sha256", "n_best", "count_sum"]
    for i, want in enumerate(plain(texts)):
        assert tuple(got[i][c] for c in names) == want, texts[i]
    assert len(got) == len(texts)


def test_empty_table(spark):
    assert align.token_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_products():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((40, 30), (30, 50)))
    sparse = lambda m: align.csr(*np.nonzero(m), len(m), m[np.nonzero(m)])
    was, align.EXPANDED = align.EXPANDED, 17
    try:
        got = align.product(sparse(a), sparse(b))
    finally:
        align.EXPANDED = was
    dense = np.zeros((40, 50), int)
    dense[got.rows, got.indices] = got.data
    assert (dense == a @ b).all() and (got.data > 0).all()
    t = align.transposed(sparse(a), 30)
    back = np.zeros((30, 40), int)
    back[t.rows, t.indices] = t.data
    assert (back == a.T).all()


def test_cache_is_emptied_and_rebuilt(monkeypatch):
    coder = align.Aligner(align.VOCABULARY, align.MODEL)
    monkeypatch.setattr(align.Aligner, "MOST", 3)
    first = [coder.texts(["one two three four five", "two"]) for _ in range(3)]
    assert all(f[1] == first[0][1] and (f[3] == first[0][3]).all() for f in first)
