"""What several text operators share: words, hashes, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Removes a job's shuffle files as soon as it has ended; what it gave lies in a written table then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a temporary one serves a local session; on
    a cluster that is an error, as executors would not see each other's files."""
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not (master := spark.conf.get("spark.master", "local")).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Rows of an Arrow batch, so that batches of long texts stay small on both sides of a Python worker.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df: writes it to the shared folder and reads it again. The shuffle files of the write go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    meant = {CLEANUP: "true", **BATCH_ROWS}
    was = {k: spark.conf.get(k, None) for k in meant}
    for k, v in meant.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables whose last reader has ended."""
    for t in tables:
        for at in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if re.search("-[0-9a-f]{32}$", at):
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup with another part of the same table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until df has no column (in any letter case) of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def native_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: lambda variables are never expanded again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Bounded pieces of Arrow batches, so that flattened arrays stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: Gives the C library's free memory back to the system, where it has that.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Cache(dict):
    """What a Python worker remembers from task to task. Workers are reused by tasks of other operators: alone() empties the
    caches that those left."""

    ALL: list["Cache"] = []

    def __init__(self) -> None:
        super().__init__()
        self.ALL.append(self)

    def forget(self) -> None:
        self.clear()

    @classmethod
    def alone(cls, *kept: "Cache") -> None:
        """Empties every cache of this worker but those kept, and hands unused memory back."""
        for c in cls.ALL:
            if not any(c is k for k in kept):
                c.forget()
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: By byte: what separates words, and A-Z lowered.
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64)


def word_hashes(texts: list[str | None], block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts with A-Z lowered, in order, and the text each is of.

    A word's hash adds up a number of each byte at its place in the word. Bytes are worked on in blocks of whole words, so memory
    stays a small multiple of the texts however long one is; no word is an object of its own.
    """
    raw = [text_bytes(t) for t in texts]
    a = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    gaps = np.flatnonzero(_GAP[a])
    starts = np.concatenate(([0], gaps[:-1] + 1)) if len(gaps) else gaps
    word = gaps > starts
    starts, ends = starts[word], gaps[word]
    hashes = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        at = starts[i:j] - starts[i]
        part = a[starts[i] : ends[j - 1]]
        place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
        one = mix((place.astype(np.uint64) << np.uint64(8)) + _LOW[part] + np.uint64(1))
        one[_GAP[part]] = 0
        hashes[i:j] = mix(np.add.reduceat(one, at) ^ (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    last = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return hashes, np.searchsorted(last, starts, "right")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component being the smallest id that can be reached.

    Every round takes the smallest label among neighbours and then follows labels once more (pointer jumping); each round is
    written to the shared folder, and the round before deleted. Hot nodes are met by partial aggregation and skew joins. Only a
    count reaches the driver. Rounds grow with the logarithm of the longest path; beyond most_rounds an error is raised.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), name)
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("low"))
        over = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        nxt = written(low.join(over, "low", "left").select("id", "was", F.least("low", "up").alias("component")), name)
        moved = nxt.where("component <> was").limit(1).count()
        drop(labels)
        labels = nxt.select("id", "component")
        if not moved:
            drop(both)
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")
