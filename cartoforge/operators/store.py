"""Tables in files: cells by level, checked dumps, reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lineage import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_tiles(content: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes rows of cells (level, ix, iy, ...) to a folder per level, sorted by row and column in range-cut files: a reader
    of some rows of a level opens the files of that level, and their statistics rule out most row groups."""
    n = parts or int(content.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content.repartitionByRange(n, "level", "iy", "ix").sortWithinPartitions("level", "iy", "ix").write.partitionBy("level").parquet(path)


def read_tiles(spark: SparkSession, path: str, level: int | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Cells of a level, a range of rows and of columns (both ends inside); each limit reaches the scan."""
    t = spark.read.parquet(path)
    t = t if level is None else t.where(F.col("level") == level)
    for name, bounds in (("iy", rows), ("ix", columns)):
        t = t if bounds is None else t.where(F.col(name).between(*bounds))
    return t


def tiled_order(cells: DataFrame, tile: int = 32) -> DataFrame:
    """cells (level, ix, iy) with place, their 1-based place inside their tile of tile x tile cells, and the tile (tx, ty)."""
    t = cells.withColumn("tx", F.floor(F.col("ix") / tile).cast("long")).withColumn("ty", F.floor(F.col("iy") / tile).cast("long"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("level", "ty", "tx").orderBy("iy", "ix")).cast("long"))


def check_dump(rows: DataFrame, manifest: DataFrame, key: str = "kind") -> DataFrame:
    """key, n (rows found), wanted (by the manifest), ok; a key of one side only counts as 0 rows on the other."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = found.select(key, "n", F.lit(0).alias("wanted")).unionByName(manifest.select(key, F.lit(0).alias("n"), F.col("n").alias("wanted")))
    return both.groupBy(key).agg(F.sum("n").alias("n"), F.sum("wanted").alias("wanted")).withColumn("ok", F.col("n") == F.col("wanted"))


def write_canonical(rows: DataFrame, order: Sequence[str], path: str, key: str = "kind") -> DataFrame:
    """Writes rows in one total order (range-cut files whose names ascend) and returns the manifest: key, n."""
    rows.orderBy(*order).write.parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(key).agg(F.count("*").alias("n"))


def report_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows as tab-parted lines: doubles with six decimals, nulls empty."""

    def text(c: str) -> Column:
        kind = dict(rows.dtypes)[c]
        one = F.format_string("%.6f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string")
        return F.when(F.col(c).isNotNull(), one).otherwise("")

    return rows.select(F.concat_ws("\t", *map(text, columns)).alias("line"))


def write_report(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """The lines, sorted, as text files."""
    report_lines(rows, columns).orderBy("line").write.text(path)


_NAME = re.compile("[a-z_][a-z0-9_]*")


def vocabulary(doc: dict, levels: Sequence[int]) -> list[dict]:
    """Rules of a vocabulary document {levels: [...], rules: [{levels: [lo, hi], match: {tag: [values]}, value}], default},
    checked before any row is read: known shape, ranges inside the levels and not reversed, every level covered by its ranges."""
    if set(doc) != {"ranges", "rules", "default"}:
        raise ValueError(f"fields {sorted(doc)}")
    covered: set[int] = set()
    for lo, hi in doc["ranges"]:
        span = {k for k in levels if lo <= k <= hi}
        if lo > hi or not span or span & covered:
            raise ValueError(f"range {lo}-{hi}")
        covered |= span
    if covered != set(levels):
        raise ValueError(f"levels without rules: {sorted(set(levels) - covered)}")
    for r in doc["rules"]:
        if tuple(r["levels"]) not in {tuple(x) for x in doc["ranges"]}:
            raise ValueError(f"levels {r['levels']} are no range of the document")
        if not r["match"] or not all(_NAME.fullmatch(t) and isinstance(v, list) for t, v in r["match"].items()):
            raise ValueError(f"match {r['match']}")
        if not isinstance(r["value"], int):
            raise ValueError(f"value {r['value']!r}")
    return doc["rules"]


def coded(doc: dict, level: Column, levels: Sequence[int], tags: dict[str, Column]) -> Column:
    """The value of the first rule of a vocabulary that covers the level and matches the tags; else its default."""
    out = F.lit(doc["default"]).cast("int")
    for r in reversed(vocabulary(doc, levels)):
        hit = level.between(*r["levels"])
        for tag, values in r["match"].items():
            hit = hit & F.coalesce(tags[tag].isNotNull() if values == ["*"] else tags[tag].isin(values), F.lit(False))
        out = F.when(hit, F.lit(r["value"])).otherwise(out)
    return out


def emitted(spark: SparkSession, doc: dict, levels: Sequence[int]) -> DataFrame:
    """level, value: what a vocabulary can give at each level (a row a rule and level)."""
    rows = {(k, r["value"]) for r in vocabulary(doc, levels) for k in levels if r["levels"][0] <= k <= r["levels"][1]}
    rows |= {(k, doc["default"]) for k in levels if doc["default"] is not None}
    return spark.createDataFrame(sorted(rows), "level int, value int")


def selection(doc: dict[int, dict], levels: Sequence[int]) -> dict[int, dict]:
    """A selection table {level: {highway: [...], place: [...], background: [...], min_length_m}}, checked: all levels there, known
    fields, lists of texts, lengths not negative."""
    if set(doc) != set(levels):
        raise ValueError(f"levels {sorted(doc)}")
    for k, row in doc.items():
        if extra := set(row) - {"highway", "place", "background", "min_length_m"}:
            raise ValueError(f"level {k}: {sorted(extra)}")
        if not all(isinstance(v, str) for f in ("highway", "place", "background") for v in row.get(f, [])):
            raise ValueError(f"level {k}: values must be texts")
        if row.get("min_length_m", 0) < 0:
            raise ValueError(f"level {k}: negative length")
    return doc


def range_lookup(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], name: str = "units") -> DataFrame:
    """rows with the coordinate range of their keys; a key that the table lacks is an error when its row is read."""
    size = ranges.count()
    if size > 100_000:
        raise ValueError(f"{size} ranges: no small table")
    found = rows.join(F.broadcast(ranges.withColumnRenamed(name, "_range")), list(keys), "left")
    missing = F.concat(F.lit("no range for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return found.withColumn(name, F.when(F.col("_range").isNull(), F.raise_error(missing).cast("int")).otherwise(F.col("_range"))).drop("_range")
