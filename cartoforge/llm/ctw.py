"""Language-model scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, drop, slices, text_bytes, word_hashes, written

#: What ends a text: a byte that UTF-8 never uses. It is coded as the bytes are, so the scores of all texts add up to 1.
END = b"\xff"
#: Bytes of context, the last bytes of it by which the tree is parted, and the bytes of text whose distinct grams and tokens
#: meet their scores as one group.
DEPTH, TOP, CHUNK = 5, 2, 32 << 20
_ONE = np.uint64(1)


def _grams_of(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams ending at each byte of the parts (number of the text, the DEPTH bytes before, bytes), and the text each is of."""
    a = np.frombuffer(b"".join(before + part for _, before, part in parts), np.uint8)
    n = np.fromiter((len(part) for _, _, part in parts), np.int64, len(parts))
    g = np.zeros(max(0, len(a) - DEPTH), np.uint64)
    for k in range(DEPTH + 1):
        np.left_shift(g, np.uint64(8), out=g)
        np.bitwise_or(g, a[k : len(a) - DEPTH + k], out=g)
    inside = np.ones(len(g), bool)
    inside[(np.cumsum(n + DEPTH)[:-1, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return g[inside], np.repeat(np.fromiter((i for i, _, _ in parts), np.int64, len(parts)), n)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH + 1)-byte strings ending at each byte, as numbers, and the text each is of; a text starts after zero bytes and
    ends with END."""
    return _grams_of([(i, b"\0" * DEPTH, text_bytes(t) + END) for i, t in enumerate(texts)])


def gram_blocks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() in blocks of at most `most` bytes: a longer text is cut, and each cut goes on after the bytes before it."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        raw = text_bytes(t) + END
        for at in range(0, len(raw), most):
            part = raw[at : at + most]
            if parts and size + len(part) > most:
                yield _grams_of(parts)
                parts, size = [], 0
            parts.append((i, raw[max(0, at - DEPTH) : at].rjust(DEPTH, b"\0"), part))
            size += len(part)
    if parts:
        yield _grams_of(parts)


def node_keys(g: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """Number of the node where bit `bit` (7..0) of the last byte is decided after `depth` bytes of context.

    Context, then the bits of the byte decided so far behind a leading 1, then the depth: contexts of 5 bytes fit.
    """
    context = (g >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    decided = ((g & np.uint64(0xFF)) | np.uint64(0x100)) >> np.uint64(bit + 1)
    return (((context << np.uint64(8)) | decided) << np.uint64(3)) | np.uint64(depth)


def parent_keys(node: np.ndarray) -> np.ndarray:
    """Keys of the nodes with one byte less context (its first); all nodes lie at one depth > 0."""
    depth = int(node[0] & np.uint64(7)) if len(node) else 1
    context = (node >> np.uint64(11)) & np.uint64((1 << 8 * (depth - 1)) - 1)
    return (context << np.uint64(11)) | (node & np.uint64(2040)) | np.uint64(depth - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of a task's texts, merged as they grow."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        u, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        held.clear()
        k, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
        return k, np.bincount(at, np.concatenate([sums, n]), len(k)).astype(np.int64)

    size = 0
    for b in slices(batches):
        g, _ = grams(b.column(0).to_pylist())
        held.append(g)
        size += len(g)
        if size >= 8_000_000:
            keys, sums = merge()
            size = 0
            if len(keys) > 3_000_000:  # hand on what there is, so that memory stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["gram", "n"])
                keys, sums = keys[:0], sums[:0]
    keys, sums = merge()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["gram", "n"])


#: lgamma(k + 0.5) and lgamma(k + 1) of small counts.
_HALF, _WHOLE = (np.array([lgamma(k + x) for k in range(4096)]) for x in (0.5, 1.0))


def _log_gamma(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    out[large] = [lgamma(k + more) for k in n[large].tolist()]
    return out


class Level(NamedTuple):
    """Nodes of one depth and bit, sorted, with their estimate of a 1, their weighted log probability and weight of their own."""

    node: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    own: np.ndarray

    @property
    def p(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def _level(node: np.ndarray, at: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray | None) -> Level:
    """Sums of counts and of children's weighted log probabilities by node, mixed half and half with the node's own."""
    a, b = (np.bincount(at, n, len(node)).astype(np.int64) for n in (n0, n1))
    kt = _log_gamma(a, _HALF, 0.5) + _log_gamma(b, _HALF, 0.5) - 2 * lgamma(0.5) - _log_gamma(a + b, _WHOLE, 1.0)
    if kids is None:
        return Level(node, a, b, kt, np.ones(len(node)))
    weighted = log(0.5) + np.logaddexp(kt, np.bincount(at, kids, len(node)))
    return Level(node, a, b, weighted, np.exp(log(0.5) + kt - weighted))


def _above(below: Level) -> Level:
    node, at = np.unique(parent_keys(below.node), return_inverse=True)
    return _level(node, at, below.n0, below.n1, below.weighted)


def _subtree(g: np.ndarray, n: np.ndarray, bit: int) -> list[Level]:
    """Levels TOP to DEPTH of the nodes of a bit over all grams with some last TOP bytes of context."""
    node, at = np.unique(node_keys(g, DEPTH, bit), return_inverse=True)
    one = ((g >> np.uint64(bit)) & _ONE).astype(bool)
    levels = [_level(node, at, n * ~one, n * one, None)]
    while len(levels) <= DEPTH - TOP:
        levels.insert(0, _above(levels[0]))
    return levels


def _arrays(grams_: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return grams_.column("gram").to_numpy().view(np.uint64), grams_.column("n").to_numpy()


def _level_table(levels: list[Level]) -> pa.Table:
    whole = [np.concatenate(x) for x in zip(*levels)]
    return pa.table([pa.array(whole[0].view(np.int64)), *map(pa.array, whole[1:])], names=Level._fields)


_LEVELS = "node long, n0 long, n1 long, weighted double, own double"


def _tops(grams_: pa.Table) -> pa.Table:
    g, n = _arrays(grams_)
    return _level_table([_subtree(g, n, bit)[0] for bit in range(8)])


def _all_levels(grams_: pa.Table) -> pa.Table:
    g, n = _arrays(grams_)
    return _level_table([level for bit in range(8) for level in _subtree(g, n, bit)])


def by_top(counted: DataFrame, most: int = 50_000):
    """counted (gram, ...) grouped by the hash of the last TOP bytes of context, below which subtrees are independent; so many
    groups that each has about `most` grams."""
    top = F.xxhash64(F.expr(f"shiftright(gram, 8) & {(1 << 8 * TOP) - 1}L"))
    return counted.withColumn("top", F.pmod(top, F.lit(counted.count() // most + 1))).groupBy("top")


def roots(counted: DataFrame) -> list[Level]:
    """The levels above TOP of the tree over counts of grams, all bits together. A level d has at most 256^d contexts of 255
    nodes, by the alphabet: they are whole, and few, at any size of corpus."""
    tops = by_top(counted).applyInArrow(_tops, _LEVELS)
    parent = f"((shiftright(node, 11) & {(1 << 8 * (TOP - 1)) - 1}L) * 2048L) + (node & 2040L) + {TOP - 1}L"
    got = tops.groupBy(F.expr(parent).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("kids")).orderBy("node").toArrow()
    node, n0, n1, kids = (got.column(c).to_numpy() for c in ("node", "n0", "n1", "kids"))
    levels = [_level(node.view(np.uint64), np.arange(len(node)), n0, n1, kids)]
    while len(levels) < TOP:
        levels.insert(0, _above(levels[0]))
    return levels


def train(texts: DataFrame) -> DataFrame:
    """The weighted tree of a column `text`: node, p (estimate of a 1), own (weight of the node's own estimate).

    Counts cover all texts, and every context that was seen is kept, so the tree grows with the corpus. A node's
    Krichevsky-Trofimov block probability is mixed half and half with the product of its children's weighted probabilities,
    from the deepest level up: own = P_kt / (P_kt + product).
    """
    counted = written(texts.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    nodes = by_top(counted).applyInArrow(_all_levels, _LEVELS)
    nodes = nodes.unionByName(texts.sparkSession.createDataFrame(_level_table(roots(counted))))
    return nodes.select("node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).cast("float").alias("p"), F.col("own").cast("float").alias("own"))


def gram_scores(counted: DataFrame) -> DataFrame:
    """log2 probability of each distinct gram's last byte after the bytes before, learnt from counts (gram, n): gram, log2.

    Grams with n = 0 are scored only. Grams that share their last TOP bytes of context are worked out together, first up their
    subtree and then, from what the levels above say, down again; each of the 8 decisions is made at the deepest node that was
    seen, mixed with all the shorter contexts. A decision unseen even without context is a half.
    """
    above = [tuple(level) for level in roots(counted.where("n > 0"))]

    def run(grams_: pa.Table) -> pa.Table:
        asked, n = _arrays(grams_)
        g, n = asked[n > 0], n[n > 0]
        out = np.zeros(len(asked))
        for bit in range(8):
            levels = [*(Level(*x) for x in above), *_subtree(g, n, bit)]
            f, said, rest = [], np.zeros(0), np.zeros(0)
            for depth, level in enumerate(levels):
                if depth:
                    up = np.searchsorted(levels[depth - 1].node, parent_keys(level.node))
                    before, left = said[up], rest[up]
                else:
                    before, left = np.zeros(len(level.node)), np.ones(len(level.node))
                f.append(before + left * level.p)
                said, rest = before + left * level.own * level.p, left * (1 - level.own)
            p, open_ = np.full(len(asked), 0.5), np.arange(len(asked))
            for depth in range(DEPTH, -1, -1):
                node = levels[depth].node
                if len(node):
                    k = node_keys(asked[open_], depth, bit)
                    i = np.minimum(np.searchsorted(node, k), len(node) - 1)
                    there = node[i] == k
                    p[open_[there]] = f[depth][i[there]]
                    open_ = open_[~there]
            out += np.log2(np.where((asked >> np.uint64(bit)) & _ONE, p, 1 - p))
        return pa.table({"gram": grams_.column("gram"), "log2": pa.array(out)})

    return by_top(counted).applyInArrow(run, "gram long, log2 double")


class Tree:
    """A whole small tree in memory: sorted nodes with their estimate of a 1 and their weight; scores grams as gram_scores does."""

    def __init__(self, node: np.ndarray, p: np.ndarray, own: np.ndarray):
        self.node, self.p, self.own = node, p, own

    def logs_of(self, g: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last byte after the bytes before: 8 decisions, each mixed over all kept depths."""
        out = np.zeros(len(g))
        for bit in range(7, -1, -1):
            one = ((g >> np.uint64(bit)) & _ONE).astype(bool)
            p = np.full(len(g), 0.5)
            alive, path = np.arange(len(g) if len(self.node) else 0), []
            for depth in range(DEPTH + 1):  # contexts are kept with all their shorter ones: what is lost once stays lost
                k = node_keys(g[alive], depth, bit)
                i = np.minimum(np.searchsorted(self.node, k), max(0, len(self.node) - 1))
                there = self.node[i] == k if len(alive) else np.zeros(0, bool)
                alive, i = alive[there], i[there]
                path.append((alive, i))
            deepest = np.full(len(g), -1, np.int8)
            for depth, (who, _) in enumerate(path):
                deepest[who] = depth
            for depth in range(DEPTH, -1, -1):
                who, i = path[depth]
                here, own = self.p[i].astype(float), np.where(deepest[who] == depth, 1.0, self.own[i])
                p[who] = own * here + (1 - own) * p[who]
            out += np.log2(np.where(one, p, 1 - p))
        return out


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, and the text each is of; the ends, token 0, come last, one a text."""
    words, owner = word_hashes(texts)
    return np.concatenate([words, np.zeros(len(texts), np.uint64)]), np.concatenate([owner, np.arange(len(texts))])


def _piece(table: pa.Table) -> pa.Table:
    """What a chunk holds: its distinct grams (kind 0) and tokens (kind 1), with their counts in texts that aren't held out."""
    Cache.alone()
    chunk, parts = table.column("chunk")[0].as_py(), []

    def merge(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*pairs))
        pairs.clear()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
    for b in slices(iter(table.to_batches())):
        texts, open_ = b.column(b.schema.get_field_index("text")).to_pylist(), ~b.column(b.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
        tokens, of = _tokens(texts)
        for kind, keys, n in chain(((0, g, open_[owner]) for g, owner in gram_blocks(texts)), [(1, tokens, open_[of])]):
            held[kind].append(merge([(keys, n.astype(np.int32))]))
            if sum(len(k) for k, _ in held[kind]) > max(1_500_000, 2 * len(held[kind][0][0])):
                held[kind] = [merge(held[kind])]
    for kind, pairs in held.items():
        keys, n = merge(pairs)
        parts.append(pa.table({"chunk": pa.array(np.full(len(keys), chunk, np.int64)), "kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))}))
    return pa.concat_tables(parts)


class Known:
    """Values of 64-bit keys: a table by hash, and what that has lost in sorted order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.quick = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.quick[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        i = self.quick[self._slot(keys)]
        lost = np.flatnonzero(self.keys[i] != keys)
        i[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[i]


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, top double, log2 double, n_bytes long"


def _score(texts: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over each text of a chunk; values holds every gram (kind 0, log2) and token (kind 1, training count) of it."""
    Cache.alone()
    kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
    logs, counts = (Known(key[kind == k].view(np.uint64), value[kind == k]) for k in (0, 1))
    del values, kind, key, value
    out = []
    for b in slices(iter(texts.select(["doc_id", "held_out", "text"]).to_batches())):
        t = b.column(2).to_pylist()
        tokens, whose = _tokens(t)
        c = counts.of(tokens)
        sums = [np.bincount(whose, minlength=len(t)), np.bincount(whose, c > 0, len(t)).astype(np.int64), np.bincount(whose, np.log10(c + 0.5), len(t))]
        sums += [np.zeros(len(t)), np.full(len(t), -1)]
        for g, owner in gram_blocks(t):
            sums[-2] += np.bincount(owner, logs.of(g), len(t))
            sums[-1] += np.bincount(owner, minlength=len(t))
        out.append(pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "top", "log2", "n_bytes"]))
    return pa.Table.from_batches(out)


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Every row of docs (doc_id, held_out, text) with its base and its context-tree score, both learnt from rows that aren't
    held out: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes, bits_per_byte.

    A null text is empty: one token (the end), no bytes, the score of ending at once, and bits_per_byte null. Repeated rows are scored each; a
    null held_out counts as false. Tokens count as equal if their 64-bit hashes are. Texts are dealt by the hash of doc_id,
    text and the row's place to chunks of about chunk_bytes, so that repeated rows spread; that table is written, as a place
    may change when rows are read again. A chunk's distinct grams and tokens, pre-aggregated, meet the scores of grams and the
    counts of tokens in a join, and come back to the chunk's texts: no table that grows with the corpus is held in one place.
    Only sums over the corpus reach the driver.
    """
    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), text.alias("text"))
    size = kept.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(size // chunk_bytes + 1))
    kept = written(kept.withColumn("chunk", dealt), "dealt")
    pieces = written(kept.select("chunk", "held_out", "text").groupBy("chunk").applyInArrow(_piece, "chunk long, kind int, key long, n long"), "pieces")
    counted = written(pieces.where("kind = 0").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "grams")
    logs = gram_scores(counted)
    tokens = written(pieces.where("kind = 1").groupBy("key").agg(F.sum("n").alias("c")), "token-counts")
    whole = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count_if(F.col("c") > 0).alias("V")).first()
    values = logs.select(F.lit(0).alias("kind"), F.col("gram").alias("key"), F.col("log2").cast("float").cast("double").alias("value")).unionByName(tokens.select(F.lit(1).alias("kind"), "key", F.col("c").cast("double").alias("value")))
    values = written(values, "values")
    drop(counted, tokens)
    met = written(pieces.select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value"), "met")
    drop(pieces, values)
    out = kept.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_score, _SCORED)
    base = F.col("top") - F.col("n_tokens") * F.log10(F.lit(float(whole["N"] + 0.5 * (whole["V"] + 1))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(whole["N"])).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log2") * F.lit(log(2, 10))).alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("log2") / F.col("n_bytes")).alias("bits_per_byte"))
