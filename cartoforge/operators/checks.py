"""Checks: tables in, verdicts out (check, scope, status, detail)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name to check; a check takes a context of tables and returns check, scope, status (PASS, FAIL, NA), detail.
CHECKS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def check(name: str):
    def add(f):
        CHECKS[name] = f
        return f

    return add


def verdict(df: DataFrame, name: str, scope: Column, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), scope.cast("string").alias("scope"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), detail.cast("string").alias("detail"))


def run_checks(tables: dict[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Verdicts of all checks (or those named) in one table; a check whose tables are missing gives NA, never PASS."""
    return reduce(DataFrame.unionByName, (CHECKS[n](tables) for n in names or sorted(CHECKS)))


def passed(verdicts: DataFrame) -> bool:
    """Whether no verdict is FAIL (one row reaches the driver)."""
    return not verdicts.where("status = 'FAIL'").limit(1).count()


def absent(tables: dict[str, DataFrame], name: str, *need: str) -> DataFrame | None:
    """The NA verdict if a table that a check needs isn't there."""
    if not (gone := [t for t in need if t not in tables]):
        return None
    any_table = next(iter(tables.values()))
    return any_table.sparkSession.createDataFrame([(name, "all", "NA", f"no {', '.join(gone)}")], "check string, scope string, status string, detail string")


@check("count_envelope")
def count_envelope(t: dict[str, DataFrame]) -> DataFrame:
    """Rows of `made` lie within 0.5 to 1.5 times those of `wanted` at every level of either; level 0 is exempt."""
    if (na := absent(t, "count_envelope", "made", "wanted")) is not None:
        return na
    side = lambda k: t[k].select("level", *((F.lit(1) if k == x else F.lit(0)).alias(x) for x in ("made", "wanted")))
    n = side("made").unionByName(side("wanted")).groupBy("level").agg(F.sum("made").alias("g"), F.sum("wanted").alias("r"))
    ok = (F.col("level") == 0) | F.when(F.col("r") == 0, F.col("g") == 0).otherwise((F.col("g") >= 0.5 * F.col("r")) & (F.col("g") <= 1.5 * F.col("r")))
    return verdict(n, "count_envelope", F.col("level"), ok, F.concat_ws("/", "g", "r"))


@check("presence_subset")
def presence_subset(t: dict[str, DataFrame]) -> DataFrame:
    """Codes of `made` at each level are among those of `wanted`."""
    if (na := absent(t, "presence_subset", "made", "wanted")) is not None:
        return na
    extra = t["made"].select("level", "code").distinct().join(t["wanted"].select("level", "code").distinct().withColumn("there", F.lit(1)), ["level", "code"], "left")
    n = extra.groupBy("level").agg(F.count_if(F.col("there").isNull()).alias("extra"))
    return verdict(n, "presence_subset", F.col("level"), F.col("extra") == 0, F.col("extra"))


@check("coordinate_range")
def coordinate_range(t: dict[str, DataFrame]) -> DataFrame:
    """Every `vert` of `made` lies in 0..22; offenders, least and greatest by level."""
    if (na := absent(t, "coordinate_range", "made")) is not None:
        return na
    n = t["made"].groupBy("level").agg(F.count_if(~F.col("vert").between(0, 22)).alias("bad"), F.min("vert").alias("lo"), F.max("vert").alias("hi"))
    return verdict(n, "coordinate_range", F.col("level"), F.col("bad") == 0, F.concat_ws("/", "bad", "lo", "hi"))


@check("grid_shape")
def grid_shape(t: dict[str, DataFrame]) -> DataFrame:
    """The extents of cells of both tables differ by one cell at most at each level."""
    if (na := absent(t, "grid_shape", "made", "wanted")) is not None:
        return na
    box = lambda k: t[k].groupBy("level").agg(*(f(c).alias(f"{k}_{f.__name__}_{c}") for c in ("ix", "iy") for f in (F.min, F.max)))
    both = box("made").join(box("wanted"), "level", "full_outer")
    apart = F.greatest(*(F.abs(F.col(f"made_{m}_{c}") - F.col(f"wanted_{m}_{c}")) for c in ("ix", "iy") for m in ("min", "max")))
    return verdict(both, "grid_shape", F.col("level"), F.coalesce(apart <= 1, F.lit(False)), F.coalesce(apart.cast("string"), F.lit("one side only")))


@check("spot_check")
def spot_check(t: dict[str, DataFrame]) -> DataFrame:
    """Each row of `spots` (spot, level, ix, iy) has a row in `made`."""
    if (na := absent(t, "spot_check", "made", "spots")) is not None:
        return na
    there = t["made"].select("level", "ix", "iy").distinct().withColumn("there", F.lit(True))
    return verdict(t["spots"].join(there, ["level", "ix", "iy"], "left"), "spot_check", F.col("spot"), F.coalesce("there", F.lit(False)), F.concat_ws("/", "level", "ix", "iy"))


def kind_census(rows: DataFrame, kinds: DataFrame, key: str = "kind") -> DataFrame:
    """n for every kind of the dimension, 0 where no row has it."""
    return kinds.join(rows.groupBy(key).agg(F.count("*").alias("k")), key, "left").select(key, F.coalesce("k", F.lit(0)).alias("n"))


def partition_proof(rows: DataFrame, manifest: DataFrame, assigned: Column, key: str = "kind") -> DataFrame:
    """key, wanted (manifest), assigned, unclassified, proven: all rows of the manifest are assigned and none is unclassified.
    Kinds without rows stay."""
    n = rows.groupBy(key).agg(F.count_if(assigned).alias("assigned"), F.count_if(~assigned).alias("unclassified"))
    both = manifest.join(n, key, "left").select(key, F.col("n").alias("wanted"), F.coalesce("assigned", F.lit(0)).alias("assigned"), F.coalesce("unclassified", F.lit(0)).alias("unclassified"))
    return both.withColumn("proven", (F.col("wanted") == F.col("assigned")) & (F.col("unclassified") == 0))


def spread_first(rows: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """rows with turn: k positions spread evenly over each group's order come first, then the others."""
    w = Window.partitionBy(*group)
    p = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int")) - 1), lambda i: F.when(F.least(F.lit(k), F.col("_n")) == 1, F.lit(0.0)).otherwise(F.rint(i * (F.col("_n") - 1) / (F.least(F.lit(k), F.col("_n")) - 1))))
    spread = F.array_contains(picks, F.col("_at").cast("double"))
    return p.withColumn("_s", spread).withColumn("turn", F.row_number().over(w.orderBy(F.col("_s").desc(), "_at")).cast("long")).drop("_at", "_n", "_s")
