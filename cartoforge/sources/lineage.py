"""Cutting lineage in a way that outlives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a job's shuffle files as soon as it has ended; what it gave lies in a written table then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts that a shuffle makes before small ones are joined.
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a temporary one serves a local session; on
    a cluster that is an error, as executors would not see each other's files."""
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not (master := spark.conf.get("spark.master", "local")).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. The shuffle files of the write go at its end, and what it shuffles is cut
    into 200 parts at least, of which Spark joins small ones, so that a task's sort does not spill for want of parts."""
    spark = df.sparkSession
    meant = {CLEANUP: "true", PARTS: str(max(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    was = {k: spark.conf.get(k, None) for k in meant}
    for k, v in meant.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path := f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of cut_lineage() whose last reader has ended."""
    for t in tables:
        for at in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if re.search("/table-[0-9a-f]{32}$", at):
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
