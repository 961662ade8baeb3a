"""Address points to an index of streets, ranges and cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut_lineage, drop_tables


def house_numbers(text: Column) -> tuple[Column, Column]:
    """Lower and upper house number: a range if the whole text is two numbers with - or / between, else leading digits twice, else
    0 and 0."""
    a = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    b = F.regexp_extract(text, r"^\s*[0-9]+\s*[-–/]\s*([0-9]+)\s*$", 1)
    first = F.when(a == "", F.lit(0)).otherwise(a.cast("int"))
    second = F.when(b == "", first).otherwise(b.cast("int"))
    return F.least(first, second), F.greatest(first, second)


def state_suffix(rows: DataFrame, code: str, states: DataFrame, default: int) -> DataFrame:
    """rows with suffix and state. states: suffix, state. A code is a suffix or a state's name in any case, null the default; one
    that no state has is an error. states is a small table of fixed codes."""
    known = states.select(F.upper(F.col("suffix").cast("string")).alias("_code"), "suffix", "state").unionByName(states.select(F.upper("state").alias("_code"), "suffix", "state"))
    met = rows.withColumn("_code", F.coalesce(F.upper(F.trim(F.col(code).cast("string"))), F.lit(str(default)))).join(known, "_code", "left")
    return met.withColumn("suffix", F.when(F.col("suffix").isNull(), F.raise_error(F.concat(F.lit("unknown state code: "), "_code")).cast(dict(states.dtypes)["suffix"])).otherwise(F.col("suffix"))).drop("_code")


def key(text: Column) -> Column:
    return F.upper(F.trim(text))


def dense_ids(names: DataFrame, name: str, alias: str, unique: bool = False) -> DataFrame:
    """1-based dense ids of distinct names in alphabetical order, without one task for all: ranges are sorted each on its own
    and start after the counts of those before (one count a range, a small table). unique: no name is repeated."""
    distinct = names.select(name).where(F.col(name).isNotNull())
    distinct = distinct if unique else distinct.distinct()
    distinct = cut_lineage(distinct)  # range partitioning reads its input twice: once for a sample of it
    parts = cut_lineage(distinct.repartitionByRange(name).select(name, F.spark_partition_id().alias("part")))
    drop_tables(distinct)
    sizes = parts.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    placed = parts.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(name)))
    return placed.join(F.broadcast(before), "part").select(name, (F.col("before") + F.col("rn")).cast("long").alias(alias))


def index(points: DataFrame) -> dict[str, DataFrame]:
    """streets (street_id, street), ranges (street_id, house_lo, house_hi, lat, lon, city), cities (city, street_ids, lat, lon)."""
    lo, hi = house_numbers(F.col("house_number"))
    p = points.select("addr_id", "lat", "lon", key(F.col("street_name")).alias("street"), key(F.col("city_name")).alias("city"), lo.alias("house_lo"), hi.alias("house_hi"), "suffix").where("street is not null and street <> ''")
    streets = dense_ids(p, "street", "street_id")
    placed = p.join(streets, "street")
    cities = placed.groupBy("city").agg(F.sort_array(F.collect_set("street_id")).alias("street_ids"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return {"streets": streets, "ranges": placed.select("addr_id", "street_id", "house_lo", "house_hi", "lat", "lon", "city", "suffix"), "cities": cities}


def violations(idx: dict[str, DataFrame]) -> DataFrame:
    """Rows (invariant, n) of the index' six invariants; n is 0 where one holds."""
    s, r, c = idx["streets"], idx["ranges"], idx["cities"]
    listed = c.select("city", F.explode("street_ids").alias("street_id"))
    checks = {
        "range without street": r.join(s, "street_id", "left_anti"), "street without range": s.join(r, "street_id", "left_anti"), "range upside down": r.where("house_lo > house_hi"),
        "city without street": c.where("size(street_ids) = 0"), "listed street missing": listed.join(s, "street_id", "left_anti"), "street listed twice": listed.groupBy("city", "street_id").count().where("count > 1"),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("invariant"), "n")
        out = one if out is None else out.unionByName(one)
    return out
