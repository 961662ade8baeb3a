"""Aligns the tokens of two tokenizers over the same bytes: token-byte incidence matrices in CSR and their row products."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, apart, drop, slices, written

#: Vocabulary of the tokenizers library (A) and model of the sentencepiece library (B): paths, or names of public ones.
VOCABULARY, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Products that a block of rows expands to at a time.
EXPANDED = 4_000_000
#: Id pairs of documents after which a chunk of documents is closed.
CHUNK = 2_000_000
#: Keys of a chunk that a row holds.
PIECE = 100_000


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has the columns indices[indptr[i]:indptr[i + 1]], ascending, and their data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def csr(row: np.ndarray, col: np.ndarray, n_rows: int, data: np.ndarray | None = None) -> Csr:
    """A matrix from its cells in any order; cells given more than once are added up."""
    width = int(col.max()) + 1 if len(col) else 1
    key = row.astype(np.int64) * width + col
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    data = np.ones(len(key), np.int64) if data is None else data[order]
    sums = np.add.reduceat(data, first) if len(first) else data[:0]
    cells = key[first]
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(cells // width, minlength=n_rows)))), cells % width, sums)


def tiling(lengths: np.ndarray) -> Csr:
    """Incidence of tokens and bytes, where each token covers the `lengths` bytes after the one before."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64))


def transposed(m: Csr, n_cols: int) -> Csr:
    return csr(m.indices, m.rows, n_cols, m.data)


def product(a: Csr, b: Csr) -> Csr:
    """a times b by Gustavson's rows: row i of the product adds up the rows of b that row i of a names, times a's cells.

    Rows are worked on in blocks that expand to EXPANDED cells, so memory is bounded by that and by the longest single row.
    """
    length = np.diff(b.indptr)[a.indices]
    ends = np.concatenate(([0], np.cumsum(length)))[a.indptr]  # cells that the rows so far expand to
    parts, i, n = [], 0, len(a.indptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + EXPANDED, "right")) - 1)
        cut = slice(a.indptr[i], a.indptr[j])
        more, of = length[cut], np.repeat(np.arange(i, j), np.diff(a.indptr[i : j + 1]))
        inside = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        at = np.repeat(b.indptr[a.indices[cut]], more) + inside
        parts.append(csr(np.repeat(of - i, more), b.indices[at], j - i, np.repeat(a.data[cut], more) * b.data[at]))
        i = j
    starts = np.concatenate(([0], np.cumsum([len(p.indices) for p in parts]))).astype(np.int64)
    indptr = np.concatenate([np.zeros(1, np.int64), *(p.indptr[1:] + s for p, s in zip(parts, starts))])
    join = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
    return Csr(indptr, join(p.indices for p in parts), join(p.data for p in parts))


class Aligned(NamedTuple):
    """Of some stretches of bytes: the group of each token of A and of B, overlap links of each stretch, and its id pairs, as a
    matrix of rows (stretch, id of A; `row` is stretch * n_ids + id) by ids of B, whose cells count linked occurrences."""

    group_a: np.ndarray
    group_b: np.ndarray
    n_overlaps: np.ndarray
    row: np.ndarray
    pairs: Csr


def align(a: np.ndarray, of_a: np.ndarray, bytes_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, bytes_b: np.ndarray, n: int, n_ids: int) -> Aligned:
    """Aligns n stretches. a, b: token ids; of_a, of_b: the stretch of each; bytes_a, bytes_b: bytes that each covers.

    A times the transpose of B over bytes gives the overlap links with the bytes that two tokens share. A group ends where the
    last partner of a token comes before the first partner of the next one. Ids by groups times groups by ids gives, of each id
    pair, how many occurrence pairs share a group, so a large group costs its different ids only.
    """
    over = product(tiling(bytes_a), transposed(tiling(bytes_b), int(bytes_a.sum())))
    first, last = over.indices[over.indptr[:-1]], over.indices[over.indptr[1:] - 1]
    group_a = np.cumsum(np.concatenate(([0], first[1:] > last[:-1]))) if len(a) else np.zeros(0, np.int64)
    group_b = np.zeros(len(b), np.int64)
    group_b[over.indices] = group_a[over.rows]
    row, at = np.unique(of_a * n_ids + a, return_inverse=True)
    groups = int(group_a[-1]) + 1 if len(a) else 0
    pairs = product(csr(at, group_a, len(row)), csr(group_b, b, groups))
    return Aligned(group_a, group_b, np.bincount(of_a[over.rows], minlength=n), row, pairs)


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_level() -> dict[str, int]:
    """Characters of a byte-level vocabulary and the bytes they stand for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner(Cache):
    """Units of text to their alignment, by their number; units are remembered until there are MOST of them.

    A unit is what stands between single spaces that have no other white space beside them. Both tokenizers start a token at
    such a space: A's pattern cuts there, and no piece of B has a space after another character. So units are aligned once.
    """

    MOST, AT_ONCE, JOINED = 400_000, 20_000, 64
    #: White space but " " and "\n".
    RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")

    def __init__(self, vocabulary: str, model: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(vocabulary))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=_path(model))
        byte = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)  # then a text is one unit
        self.len_a, self.len_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        # names of A's ids before "," and "|", then of B's before "," and ";"
        self.names = [b"%d%s" % (i, sep) for n, ends in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;")) for sep in (ends[:1], ends[1:]) for i in range(n)]
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, overlap links, links; -1 where bytes don't agree
        self.ends = np.zeros(1, np.int64)
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.said: list[bytes] = []

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.whole:
            return [text]
        odd = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in self.RARE)
        return self.cut(text) if odd else text.split(" ")

    def tokens_of_a(self, units: list[str], want: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids and the unit of each. Units are encoded some together where that leaves their spaces single, and told apart by bytes."""
        lone = np.array([self.whole or u[0].isspace() or u[-1].isspace() for u in units])
        order = np.argsort(lone, kind="stable")
        units, n = [units[i] for i in order.tolist()], len(units) - int(lone.sum())
        texts = [" " + " ".join(units[k : min(k + self.JOINED, n)]) for k in range(0, n, self.JOINED)] + [" " + u for u in units[n:]]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)), np.int64)
        starts = np.cumsum(self.len_a[ids]) - self.len_a[ids]
        ends = np.cumsum([len(want[i]) for i in order.tolist()])
        of = order[np.searchsorted(ends, starts, "right")]
        back = np.argsort(of, kind="stable")
        return ids[back], of[back]

    def learn(self, new: list[str]) -> None:
        want = [b" " + u.encode("utf-8", "surrogatepass") for u in new]
        a, of_a = self.tokens_of_a(new, want)
        got_b = self.b.encode(new, num_threads=1)
        b, of_b = np.fromiter(chain.from_iterable(got_b), np.int64), np.repeat(np.arange(len(new)), np.fromiter(map(len, got_b), np.int64, len(new)))
        good = np.ones(len(new), bool)
        for ids, whose, length, tokens in ((a, of_a, self.len_a, self.bytes_a), (b, of_b, self.len_b, self.bytes_b)):
            good &= np.bincount(whose, length[ids], len(new)) == np.fromiter(map(len, want), np.int64, len(new))
            if b"".join(map(tokens.__getitem__, ids.tolist())) != b"".join(want):
                for i in range(len(new)):
                    lo, hi = np.searchsorted(whose, (i, i + 1))
                    good[i] &= b"".join(tokens[k] for k in ids[lo:hi].tolist()) == want[i]
        a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        got = align(a, of_a, self.len_a[a], b, of_b, self.len_b[b], len(new), n_a)
        unit, id_a = np.divmod(got.row[got.pairs.rows], n_a)
        per = [np.bincount(x, minlength=len(new)) for x in (of_a, of_b, of_a[np.diff(got.group_a, prepend=-1) > 0])]
        links = np.bincount(unit, got.pairs.data, len(new)).astype(np.int64)
        counts = np.stack([*per, got.n_overlaps, links], axis=1)
        counts[~good] = -1
        end = lambda group: np.diff(group, append=-1) != 0
        code = np.concatenate([a + n_a * end(got.group_a), 2 * n_a + b + n_b * end(got.group_b)])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([got.group_a, got.group_b])))
        words = list(map(self.names.__getitem__, code[order].tolist()))
        ends = np.cumsum(per[0] + per[1])
        said = [b"".join(words[s:e])[:-1] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        start = len(self.said)
        self.counts = np.concatenate([self.counts, counts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(unit, minlength=len(new)))])
        self.keys, self.times = np.concatenate([self.keys, id_a * n_b + got.pairs.indices]), np.concatenate([self.times, got.pairs.data])
        self.said += said
        self.update(zip(new, range(start, start + len(new))))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: counts (a row), digest of its groups. Then the id pairs that each holds linked: text, key, times."""
        cut = [self.units(t) for t in texts]
        if len(self) > self.MOST:
            self.forget()
        new = list(set().union(*cut).difference(self))
        for k in range(0, len(new), self.AT_ONCE):
            self.learn(new[k : k + self.AT_ONCE])
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = list(map(self.__getitem__, chain.from_iterable(cut)))
        said = list(map(self.said.__getitem__, numbers))
        ends = np.cumsum(many).tolist()
        text, unit = np.repeat(np.arange(len(cut)), many), np.array(numbers, np.int64)
        bad = np.bincount(text, self.counts[unit, 0] < 0, len(cut)) > 0
        keep = ~bad[text]
        text, unit = text[keep], unit[keep]
        counts = np.stack([np.bincount(text, self.counts[unit, k], len(cut)).astype(np.int64) for k in range(5)], axis=1)
        digests = ["" if off or s == e else hashlib.sha256(b";".join(said[s:e])).hexdigest() for off, s, e in zip(bad.tolist(), [0, *ends[:-1]], ends)]
        both, seen = np.unique(text * len(self.said) + unit, return_counts=True)
        text, unit = np.divmod(both, max(1, len(self.said)))
        more = np.diff(self.ends)[unit]
        at = np.repeat(self.ends[unit], more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        pairs = csr(np.repeat(text, more), self.keys[at], len(cut), self.times[at] * np.repeat(seen, more))
        return counts, digests, pairs.rows, pairs.indices, pairs.data


@cache
def _aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
    + [("base", pa.int64()), ("keys", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
_COLUMNS = "chunk long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, places array<int>, times array<long>, base long, keys array<long>, docs array<long>"


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, kind))


def _align(vocabulary: str, model: str, chunk_pairs: int):
    """Rows of documents, then rows of the chunk that they form: its different keys, with the number of its documents that hold
    each. Documents name keys by their places in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        Cache.alone(aligner)
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            keys, place = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
            docs, done = np.bincount(place, minlength=len(keys)), 0
            for ids, counts, digests, many, mine, times in held:
                n, none = len(ids), lambda kind, k: pa.nulls(k, kind)
                places = place[done : done + len(mine)].astype(np.int32)
                done += len(mine)
                cols = [pa.array(np.full(n, chunk)), ids, *map(pa.array, counts.T.copy()), pa.array(digests, pa.string()), _lists(places, many, pa.int32()), _lists(times, many, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(none(f.type, n) for f in list(_SCHEMA)[-3:])], schema=_SCHEMA)
            for k in range(0, len(keys), PIECE):
                part = slice(k, k + PIECE)
                few = np.array([len(keys[part])])
                cols = [pa.array([chunk]), *(pa.nulls(1, f.type) for f in list(_SCHEMA)[1:-3]), pa.array([k]), _lists(keys[part], few, pa.int64()), _lists(docs[part], few, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

        for b in slices(batches, 256):
            counts, digests, text, keys, times = aligner.texts(b.column(1).to_pylist())
            held.append((b.column(0), counts, digests, np.bincount(text, minlength=b.num_rows), keys, times))
            size += len(keys)
            if size >= chunk_pairs:
                yield from closed()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield from closed()

    return run


def _sum(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk, from what each of the chunk's keys is worth."""
    place = values.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = values.column("count").to_numpy(), values.column("best").to_numpy(zero_copy_only=False)
    sums: list[list[np.ndarray]] = [[], []]
    for b in docs.to_batches():
        at, times = (b.column(b.schema.get_field_index(c)) for c in ("places", "times"))
        n = at.value_lengths().to_numpy()
        of, at, times = np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(), times.flatten().to_numpy()
        for out, worth in zip(sums, (best, count)):
            total = np.zeros(len(n), np.int64)
            np.add.at(total, of, times * worth[at])
            out.append(total)
    kept = docs.select(["doc_id", *COUNTS, "groups_sha256"])
    for name, parts in zip(("n_best", "count_sum"), sums):
        kept = kept.append_column(name, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
    return kept


def token_links(docs: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL, chunk_pairs: int = CHUNK) -> DataFrame:
    """Aligns the tokens of each text of docs (doc_id, text) by two tokenizers: doc_id, n_a, n_b, n_groups, n_overlaps, n_links,
    groups_sha256, n_best, count_sum. Other columns are ignored.

    Tokens of A (byte-level BPE of a space and the text) and of B (sentencepiece, which adds that space) cover the same bytes.
    Offsets where tokens of both end cut them into groups; tokens that share a byte have an overlap link (n_overlaps), those
    that share a group a link (n_links). An id pair counts in how many documents of all it is linked: n_best adds up the links
    whose count is their A id's highest, ties included, count_sum the counts of all links. groups_sha256 is of the groups
    `a1,a2|b1;a3|b2,b3`.

    A null or empty text, and one whose bytes the tokens don't give back (U+2581 reads as a space), has no tokens: zeros and ''.
    Repeated rows are documents of their own. An empty table gives an empty result. Long texts cost their different units; a
    group is never expanded to occurrence pairs, only to pairs of different ids.

    Documents are read once. Each task closes a chunk at about chunk_pairs id pairs of its documents and writes its different
    keys once; only these are counted over the corpus and bring their counts back to the chunk.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = written(ids.mapInArrow(_align(vocabulary, model, chunk_pairs), _COLUMNS), "aligned")
    n_b = len(_aligner(vocabulary, model).bytes_b)
    of_chunks = aligned.where("keys is not null")
    counted = of_chunks.select(F.inline(F.arrays_zip("keys", "docs"))).groupBy(F.col("keys").alias("key")).agg(F.sum("docs").alias("count"))
    by_id = Window.partitionBy(F.floor(F.col("key") / n_b))  # at most as many rows as B has ids
    worth = written(counted.withColumn("best", F.col("count") == F.max("count").over(by_id)), "key-counts")
    values = of_chunks.select("chunk", "base", F.posexplode("keys").alias("pos", "key")).join(worth, "key").select("chunk", (F.col("base") + F.col("pos")).alias("place"), "count", "best")
    kept = aligned.where("keys is null").drop("base", "keys", "docs")
    out = kept.groupBy("chunk").cogroup(apart(values).groupBy("chunk")).applyInArrow(_sum, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long")
    found = written(out, "token-links")
    drop(aligned, worth)
    return found
