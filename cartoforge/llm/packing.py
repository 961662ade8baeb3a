"""Packing along a space-filling curve: neighbouring documents share training sequences."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, written

#: Vocabulary file of byte-level BPE for the tokenizers library: a path, or the name of a public one.
VOCABULARY = "byte_bpe_50k.json"
#: Kinds of bytes where a text may be cut: 1 space, 2 other white ones, 3 letters, 4 digits, 5 apostrophe, 6 other signs; 0 is left alone.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F], KIND[0x20], KIND[0x09:0x0E], KIND[0x30:0x3A], KIND[0x27] = 6, 1, 2, 4, 5
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 3
END, DIMS, BITS, BUCKETS = 1, 4, 10, 4096
#: Leading bits of a key by which tokens are counted before they are dealt out: 65,536 counts at most.
COARSE = 16


def pieces(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces begin of texts that lie in raw (UTF-8 bytes) one after the other, up to ends. The BPE merges nothing across.

    Its pattern looks only ahead, and there only from white characters to the next one. So a text is cut between ASCII letters,
    digits and signs (never behind an apostrophe, which may lead a contraction), between what isn't white and what is, before a
    space that leads something, and behind a lone line break. À-ÿ are letters; other characters are not cut from their neighbours.
    """
    kind = KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # × and ÷
    kind[lead] = kind[lead + 1] = 3
    solid, white = kind > 2, (kind == 1) | (kind == 2)
    first = np.zeros(len(raw) + 1, bool)
    first[1:-1] = solid[:-1] & ((solid[1:] & (kind[:-1] != kind[1:]) & (kind[:-1] != 5) & ~((kind[:-1] == 6) & (kind[1:] == 5))) | white[1:])
    leads = (kind[:-1] == 1) & solid[1:]
    leads[ends[1:][(ends[1:] > 0) & (ends[1:] < len(raw))] - 1] = False  # the next character is another text's
    first[:-2] |= leads
    first[2:-1] |= solid[:-2] & (kind[1:-1] == 2) & solid[2:]
    first[ends] = True
    return np.flatnonzero(first[:-1])


class _Pieces(Cache):
    """Piece of text (UTF-8) to its ids as little-endian unsigned 16-bit numbers. Holds MOST pieces and more, and keeps those that
    it had before as `old`: what is met again moves on, the rest goes at the next turn. Pieces over LONG bytes are not kept."""

    MOST, LONG = 300_000, 48

    def __init__(self, vocabulary: str):
        super().__init__()
        self.vocabulary = vocabulary
        self.old: dict[bytes, bytes] = {}
        self.pack = (lambda ids: array("H", ids).tobytes()) if sys.byteorder == "little" else (lambda ids: np.array(ids, "<u2").tobytes())
        self.led = re.compile(rb" [!-~\xc3][^ ]*").fullmatch

    @cached_property
    def coder(self):
        from tokenizers import Tokenizer

        path = self.vocabulary
        if "/" not in path:
            import public_tokenizers

            path = str(public_tokenizers.path(path))
        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True  # their strings in a text are ordinary text
        if coder.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        return coder

    @cached_property
    def spaced(self) -> np.ndarray:
        """By id, whether its token starts with a space."""
        out = np.zeros(self.coder.get_vocab_size(), bool)
        out[[i for t, i in self.coder.get_vocab().items() if t.startswith("Ġ")]] = True
        return out

    def forget(self) -> None:
        """Empties the tables and lets go of the library's, which are read again when needed."""
        self.clear()
        self.old = {}
        self.__dict__.pop("coder", None)

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        flat, n = self.tokens(pa.array(texts, pa.large_string()))
        ends = np.cumsum(n)
        return [flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]

    def tokens(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by the ids `end`, in one array, and how many are of each text."""
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
        starts, codes, known = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if len(raw):
            starts = pieces(raw, ends)
            bounds = pa.py_buffer(np.append(starts, len(raw)))
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
            codes, known = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = [*self.looked_up(known), end]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 2
        place = np.cumsum(size) - size
        last = np.searchsorted(starts, ends[1:]) + np.arange(len(texts))  # where `end` stands among all pieces
        row = np.full(len(codes) + len(texts), len(known))
        own = np.ones(len(row), bool)
        own[last] = False
        row[own] = codes
        n = size[row]
        upto = np.cumsum(n)
        flat = np.frombuffer(b"".join(got), "<u2")[np.arange(upto[-1]) + np.repeat(place[row] - (upto - n), n)]
        return flat, np.diff(upto[last], prepend=0)

    def looked_up(self, known: list[bytes]) -> list[bytes]:
        """Ids of different pieces; those not met before are encoded together."""
        if len(self) >= self.MOST:
            self.old = dict(self)
            self.clear()
        got = list(map(self.get, known))  # each piece is looked up once: set operations would walk all that is remembered
        open_ = [i for i, x in enumerate(got) if x is None]
        for i in open_:
            got[i] = self.old.get(known[i])
        new = [i for i in open_ if got[i] is None]
        led = [i for i in new if self.led(known[i])]
        row = np.frombuffer(b"".join(self.encoded([b"".join(known[i] for i in led).decode()] if led else [])), "<u2")
        at = np.flatnonzero(self.spaced[row])  # each of these pieces starts with its only space, so a run of them can be cut again
        if len(at) == len(led):
            wide = row.tobytes()
            for i, a, e in zip(led, at.tolist(), [*at[1:].tolist(), len(row)]):
                got[i] = wide[2 * a : 2 * e]
        rest = [i for i in new if got[i] is None]
        for i, x in zip(rest, self.encoded([known[i].decode() for i in rest])):
            got[i] = x
        self.update((known[i], got[i]) for i in open_ if len(known[i]) <= self.LONG)
        return got

    def text(self, ids: bytes) -> str:
        return self.coder.decode(np.frombuffer(ids, "<u2").tolist(), skip_special_tokens=False)


@cache
def _pieces(vocabulary: str) -> _Pieces:
    return _Pieces(vocabulary)


@cache
def _projection() -> np.ndarray:
    """By dimension, token id -> its hash bucket's number in a fixed Gaussian matrix; each dimension's numbers lie together."""
    rows = np.random.default_rng(20240501).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    at = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return np.ascontiguousarray(rows[at.astype(np.int64)].T)


def _parts(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of an Arrow batch with about `most` bytes of text (column 1), a row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)) // most
    at = np.flatnonzero(np.diff(upto, prepend=-1))
    for start, end in zip(at.tolist(), [*at[1:].tolist(), b.num_rows]):
        yield b.slice(start, end - start)


def _tokenise(vocabulary: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *((f"v{k}", pa.float32()) for k in range(DIMS)), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, project, end = _pieces(vocabulary), _projection(), np.array([END], "<u2").tobytes()
        Cache.alone(known)
        for whole in batches:
            for b in _parts(whole):
                flat, n = known.tokens(b.column(1), end)
                upto = np.cumsum(n)
                v = np.stack([np.add.reduceat(project[k].take(flat), upto - n) for k in range(DIMS)]) / n
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], 2 * upto)).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array(x.astype(np.float32)) for x in v), ids], schema=schema)

    return run, "doc_id long, n long, " + ", ".join(f"v{k} float" for k in range(DIMS)) + ", ids binary"


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points in [0, 2**bits)**d; axes has a row for each dimension."""
    x = axes.astype(np.int64).copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _cut(most: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        Cache.alone()
        number, filled, tail, out = TaskContext.get().partitionId() << 40, 0, [], []

        def piece(doc: int, ids: bytes, at: int, size: int, seq: int, offset: int) -> tuple:
            part = ids[2 * at : 2 * (at + size)]
            return doc, at, size, zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes()), len(ids) // 2, seq, offset, part

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return b

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = 0, len(ids) // 2
                while at < n:
                    size = min(n - at, most - filled)
                    tail.append((doc, ids, at, size))
                    at, filled = at + size, filled + size
                    if filled == most:
                        offset = 0
                        for p in tail:
                            out.append(piece(*p, number, offset))
                            offset += p[3]
                        number, filled, tail = number + 1, 0, []
                if len(out) >= 4096:
                    yield flush()
        room, offset = 0, 0  # what is left goes into sequences of powers of two, which need no padding
        for doc, ids, at, size in tail:
            while size:
                if not room:
                    room, offset = 1 << (filled.bit_length() - 1), 0
                    filled -= room
                step = min(size, room)
                out.append(piece(doc, ids, at, step, number, offset))
                at, size, room, offset = at + step, size - step, room - step, offset + step
                if not room:
                    number += 1
        if out:
            yield flush()

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, most: int = 2048, vocabulary: str = VOCABULARY, tokens_per_task: int = 8_000_000) -> DataFrame:
    """Packs documents into sequences of `most` tokens in the order of a Hilbert curve.

    docs: doc_id, text; other columns are ignored. A document's ids are those of its text, then END. Returns a row for each
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 16-bit).

    Token counts, hashed to BUCKETS, are projected to DIMS dimensions by a fixed Gaussian matrix; each dimension is centred and
    scaled by the corpus' mean and deviation (one row reaches the driver) and brought to BITS bits by a logistic curve. Tokens
    are counted by the leading COARSE bits of the key (at most 65,536 counts reach the driver), and the curve is cut into
    ranges of about tokens_per_task tokens; a stretch with more, as where a third of all rows share one key, is dealt to
    several tasks by a hash. Each task sorts its range and cuts the stream into full sequences, holding one sequence. What is
    left at a range's end goes into sequences whose sizes are powers of two. Texts are tokenised once; the tokens are written
    to the shared folder. Rows with equal key, doc_id and size are sorted by their ids, so a task that runs again cuts alike.
    Null texts are empty and give the single id END; repeated rows are packed each on their own; an empty table gives no rows.
    """
    run, schema = _tokenise(vocabulary)
    tokens = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "tokens")
    spread = tokens.agg(F.sum("n").alias("n"), *(f(f"v{k}").alias(f"{a}{k}") for k in range(DIMS) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not spread["n"]:
        return tokens.mapInArrow(_cut(most)[0], _cut(most)[1])

    @F.pandas_udf("long")
    def key(*v: pd.Series) -> pd.Series:
        Cache.alone()
        return pd.Series(hilbert(np.stack([x.to_numpy() for x in v]), BITS))

    level = lambda k: F.least(F.lit((1 << BITS) - 1), F.floor((1 << BITS) / (1 + F.exp(-1.702 * (F.col(f"v{k}") - spread[f"m{k}"]) / (spread[f"s{k}"] or 1.0))))).cast("long")
    keyed = tokens.select("doc_id", "ids", "n", key(*(level(k) for k in range(DIMS))).alias("key")).withColumn("stretch", F.shiftright("key", DIMS * BITS - COARSE))
    counts = keyed.groupBy("stretch").agg(F.sum("n").alias("n")).orderBy("stretch").collect()  # at most 2**COARSE rows
    cuts, part, held = [], 0, 0
    for c in counts:
        if held and held + c["n"] > tokens_per_task:
            part, held = part + 1, 0
        tasks = -(-c["n"] // tokens_per_task)
        cuts.append((c["stretch"], part, tasks))
        part, held = part + tasks - 1, held + c["n"] if tasks == 1 else tokens_per_task
    dealt = keyed.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "stretch long, part int, tasks int")), "stretch")
    to = F.col("part") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("tasks")).cast("int")
    return dealt.repartitionById(part + 1, to).sortWithinPartitions("key", "doc_id", "n", "ids").select("doc_id", "ids").mapInArrow(*_cut(most))
