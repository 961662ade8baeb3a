"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .packing import VOCABULARY, _pieces

#: A turn is OPEN role CLOSE text STOP. ESCAPE, "<" and "[" don't stand in escaped texts, so no control string does.
OPEN, CLOSE, STOP = "<|", "|>", "</s>"
_TO = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_ESCAPE, _BACK = str.maketrans(_TO), {v: k for k, v in _TO.items()}


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\b", "[") for p in parts)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for turn in text.split(STOP)[:-1]:
        role, _, said = turn.removeprefix(OPEN).partition(CLOSE)
        turns.append((unescape(role), unescape(said)))
    return turns


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for turns in b.column(1).to_pylist():
            at, path = b"", []
            for t in turns:
                at = hashlib.blake2b(b"\0".join([at, (t["role"] or "").encode("utf-8", "surrogatepass"), (t["text"] or "").encode("utf-8", "surrogatepass")]), digest_size=12).digest()
                path.append(at)
            out.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["conv_id", "turns", "path"])


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FIELDS = [("pack", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("ids", pa.binary()), ("sees", _SPAN), ("path", pa.list_(pa.int64()))]
SCHEMA = "pack long, conv_id long, depth long, start long, length long, position long, loss_from long, loss_to long, ids binary, sees array<struct<start:long,end:long>>, path array<long>"


def _see(sees: list[list[int]], start: int, end: int) -> None:
    """Adds an interval to merged ones, behind all of them: a chain of new turns stays one interval."""
    if sees and sees[-1][1] == start:
        sees[-1][1] = end
    else:
        sees.append([start, end])


def _intervals(sees: list[list[int]]) -> list[dict]:
    return [{"start": a, "end": e} for a, e in sees]


def _emit(vocabulary: str, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, pack = _pieces(vocabulary), TaskContext.get().partitionId()
        stack: list[tuple[bytes, int, int]] = []  # turns of the last conversation: hash, start, length
        sees: list[list[int]] = []  # what they cover, neighbours merged
        end, rows = 0, []

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])
            rows.clear()
            return b

        for b in slices(batches, 256):
            convs, texts, last = [], [], [key for key, _, _ in stack]
            for conv, turns, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                keys = [path[i : i + 12] for i in range(0, len(path), 12)]
                shared = 0
                while shared < min(len(keys), len(last)) and last[shared] == keys[shared]:
                    shared += 1
                for t in turns[shared : len(keys)]:
                    texts += f"{OPEN}{escape(t['role'] or '')}{CLOSE}", escape(t["text"] or ""), STOP
                convs.append((conv, turns, keys, shared))
                last = keys
            coded = iter(pieces.ids(texts))  # those of many turns at once
            for conv, turns, keys, shared in convs:
                if shared < len(stack):
                    del stack[shared:]
                    sees = []
                    for _, s, k in stack:
                        _see(sees, s, s + k)
                for depth in range(shared, len(keys)):
                    role = turns[depth]["role"] or ""
                    head, said, stop = next(coded), next(coded), next(coded)
                    a, n = len(head) // 2, len(said) // 2
                    size = a + n + len(stop) // 2
                    loss = (a, a + n) if role == trained else (0, 0)
                    rows.append((pack, None, depth, end, size, sum(e - s for s, e in sees), *loss, head + said + stop, _intervals(sees), None))
                    stack.append((keys[depth], end, size))
                    _see(sees, end, end + size)
                    end += size
                rows.append((pack, conv, len(keys), end, 0, 0, 0, 0, None, _intervals(sees), [s for _, s, _ in stack]))
                if len(rows) >= 2048:
                    yield flush()
        if rows:
            yield flush()

    return run


def format_tree(conversations: DataFrame, vocabulary: str = VOCABULARY, trained: str = "assistant", packs: int | None = None) -> DataFrame:
    """Prefix trees of conversations (conv_id, turn, role, text; other columns are ignored), in packs.

    Returns two kinds of rows. A node (conv_id null) is a turn that one or more conversations share with all before it: pack,
    depth, start (its first token's place in the pack), length, position (its first token's position id: the tokens of its
    ancestors), loss_from and loss_to (its tokens that are learnt: the text of `trained` turns), ids (little-endian unsigned
    16-bit) and sees (intervals of its ancestors in the pack, which it may attend to besides itself). A conversation's row
    gives conv_id and path, the starts of its nodes.

    Conversations are range-partitioned and sorted by the chain of their turns' hashes, which puts shared beginnings side by
    side and makes the order depth-first; a task keeps only the last conversation's turns. A beginning that a third of all
    conversations share is so dealt over tasks: each pack is a forest of its own, and only the turns along the cut between
    two packs are emitted twice. Nulls in role or text are empty; turns are ordered by turn, then role and text, and repeated
    rows stay; a row without conv_id is a conversation of its own, as nothing says which others it belongs to; an empty table
    gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    keyed = written(whole.mapInArrow(_paths, "conv_id long, turns array<struct<turn:long,role:string,text:string>>, path binary"), "conversations")
    parts = packs or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns", "path").mapInArrow(_emit(vocabulary, trained), SCHEMA)


def _read(vocabulary: str, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for b in batches:
            out = []
            for conv, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, learnt = [], []
                for n in nodes or []:
                    text.append(pieces.text(n["ids"]))
                    learnt.append(pieces.text(n["ids"][2 * n["loss_from"] : 2 * n["loss_to"]]))
                turns, loss = parse("".join(text)), unescape("".join(learnt))
                digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(map(len, text))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(tree: DataFrame, vocabulary: str = VOCABULARY, trained: str = "assistant") -> DataFrame:
    """Every conversation of format_tree()'s rows, decoded along its path: turns, text under the loss mask, sizes. The tree is
    written first, as its nodes and its paths are read apart. Rows without conv_id come out one by one, each with a single turn."""
    tree = written(tree, "chat-tree")
    nodes = tree.where("path is null").select("pack", "start", "depth", F.struct("depth", "ids", "loss_from", "loss_to").alias("node"))
    paths = tree.where("path is not null")
    steps = paths.where("conv_id is not null").select("pack", "conv_id", F.explode("path").alias("start"))
    whole = steps.join(nodes, ["pack", "start"]).groupBy("conv_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    alone = paths.where("conv_id is null").groupBy("pack", "conv_id", F.col("path")[0].alias("start")).agg(F.count("*").alias("k")).join(nodes, ["pack", "start"])
    alone = alone.select("conv_id", F.array("node").alias("nodes"), F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("conv_id", "nodes")
    whole = whole.unionByName(alone)
    return whole.mapInArrow(_read(vocabulary, trained), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
