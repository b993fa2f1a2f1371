"""Sign regimes of work and transfer: F3, F4, G1, G6, G7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.scalar import FIELDS, clean, ratio

REGIMES = ("1+", "1-", "2", "3", "4+", "4-")
#: Legacy quadrant of each regime.
QUADRANTS = {"1+": "Q1", "1-": "Q1", "2": "Q2", "3": "Q3", "4+": "Q4", "4-": "Q4"}


def sign_regime(full: str = "work_full", resolved: str = "work_resolved") -> Column:
    """One of six regimes; zero counts as nonnegative, so every point has one."""
    a, b = F.col(full), F.col(resolved)
    up = (a - b) >= 0
    return (F.when((a >= 0) & (b >= 0), F.when(up, "1+").otherwise("1-")).when((a >= 0) & (b < 0), "2")
            .when((a < 0) & (b >= 0), "3").otherwise(F.when(up, "4+").otherwise("4-")))


REGIME_SQL = """CASE WHEN work_full >= 0 AND work_resolved >= 0 THEN CASE WHEN work_full - work_resolved >= 0 THEN '1+' ELSE '1-' END
  WHEN work_full >= 0 THEN '2' WHEN work_resolved >= 0 THEN '3'
  ELSE CASE WHEN work_full - work_resolved >= 0 THEN '4+' ELSE '4-' END END"""


def threshold_code(eps_full: Column, eps_resolved: Column, full: str = "work_full", resolved: str = "work_resolved") -> Column:
    """Codes 1..6 beyond the thresholds (strictly), 0 for uncertain."""
    a, b = F.col(full), F.col(resolved)
    d = a - b
    eps = F.greatest(eps_full, eps_resolved)
    return (F.when((a > eps_full) & (b > eps_resolved) & (d > eps), 1).when((a > eps_full) & (b > eps_resolved) & (d < -eps), 2)
            .when((a > eps_full) & (b < -eps_resolved), 3).when((a < -eps_full) & (b > eps_resolved), 4)
            .when((a < -eps_full) & (b < -eps_resolved) & (d > eps), 5).when((a < -eps_full) & (b < -eps_resolved) & (d < -eps), 6).otherwise(0))


def contributions(points: DataFrame) -> DataFrame:
    """Per regime and field: count, share, sum, means over all and over the regime."""
    d = points.withColumn("delta_w", F.col("work_full") - F.col("work_resolved")).withColumn("regime", sign_regime())
    by = d.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in FIELDS])
    names = d.sparkSession.createDataFrame([(r,) for r in REGIMES], "regime string")
    full = F.broadcast(names).join(by, "regime", "left").fillna(0)
    long = full.select("regime", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in FIELDS])).alias("f")).select("regime", "n", "f.*")
    totals = long.groupBy("field").agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"))
    out = long.join(F.broadcast(totals), "field")
    return out.select(
        "regime", "field", F.col("n").alias("count"), clean(ratio(F.col("n"), F.col("all_n"))).alias("volume_fraction"),
        clean(F.col("total"), 4).alias("sum"), clean(ratio(F.col("total"), F.col("all_n"))).alias("mean_all"),
        clean(ratio(F.col("total"), F.col("n"))).alias("mean_in_regime"), clean(ratio(F.col("all_total"), F.col("all_n"))).alias("global_mean"))


def legacy_rollup(points: DataFrame) -> DataFrame:
    """The six regimes and the four quadrants they make, by one rollup."""
    quadrant = F.element_at(F.create_map(*[F.lit(x) for kv in QUADRANTS.items() for x in kv]), F.col("regime"))
    d = points.withColumn("regime", sign_regime()).withColumn("quadrant", quadrant)
    return d.rollup("quadrant", "regime").agg(F.count(F.lit(1)).alias("count"), clean(F.sum("pi"), 4).alias("pi_sum")).select(
        F.coalesce("quadrant", F.lit("all")).alias("quadrant"), F.coalesce("regime", F.lit("all")).alias("regime"), "count", "pi_sum")


def occupancy(points: DataFrame, absolute: float = 0.0, relative: float = 1e-3) -> DataFrame:
    """Counts of codes 0..6 with thresholds max(absolute, relative * rms)."""
    rms = points.agg(F.sqrt(F.avg(F.col("work_full") ** 2)).alias("rf"), F.sqrt(F.avg(F.col("work_resolved") ** 2)).alias("rr"))
    d = points.join(F.broadcast(rms))  # one row of two scalars
    eps = lambda c: F.greatest(F.lit(absolute), relative * F.col(c))
    by = d.groupBy(threshold_code(eps("rf"), eps("rr")).alias("code")).agg(F.count(F.lit(1)).alias("count"))
    codes = points.sparkSession.range(7).select(F.col("id").cast("int").alias("code"))
    return F.broadcast(codes).join(by, "code", "left").select("code", F.coalesce("count", F.lit(0)).alias("count"))


def direction_transfer(points: DataFrame) -> DataFrame:
    """Per regime and direction (pi < 0 forward, > 0 backscatter): count, magnitude, mean, fraction, intensity."""
    d = points.withColumn("regime", sign_regime())
    by = d.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pi") == 0).alias("zero_count"),
        F.count_if(F.col("pi") < 0).alias("forward_n"), F.sum(F.greatest(-F.col("pi"), F.lit(0.0))).alias("forward_m"),
        F.count_if(F.col("pi") > 0).alias("back_n"), F.sum(F.greatest(F.col("pi"), F.lit(0.0))).alias("back_m"))
    each = F.explode(F.array(F.struct(F.lit("forward").alias("direction"), F.col("forward_n").alias("count"), F.col("forward_m").alias("m")),
                             F.struct(F.lit("backscatter").alias("direction"), F.col("back_n").alias("count"), F.col("back_m").alias("m"))))
    return by.select("regime", "n", "zero_count", each.alias("e")).select(
        "regime", "e.direction", "e.count", "zero_count", clean(F.col("e.m"), 4).alias("magnitude_sum"), clean(ratio(F.col("e.m"), F.col("e.count"))).alias("mean"),
        clean(ratio(F.col("e.count"), F.col("n"))).alias("fraction"), clean(ratio(F.col("e.m"), F.col("n"))).alias("intensity"))
