"""Threshold events, overlaps, nested regions, angles and near-zero populations: F1-F5, F7, G15-G17, P7, P8; reduced forms of F6 and G23-G25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.scalar import angle_degrees, clean, ratio
from fieldspark.operators.binning import uniform_bin
from fieldspark.operators.stats import beside, exact_percentiles


def event(q: Column, q_rms: Column, alpha, mode: str = "positive") -> Column:
    """Strict threshold events of q."""
    limit = alpha * q_rms
    return {"positive": q > limit, "negative": q < -limit, "absolute": F.abs(q) > limit}[mode]


def scaled(points: DataFrame) -> DataFrame:
    """points with q over its frame's rms (qn) and u2 over its frame's mean (un); the points are not shuffled for it."""
    by = points.groupBy("frame").agg(F.sqrt(F.avg(F.col("q") * F.col("q"))).alias("q_rms"), F.avg("u2").alias("u2_mean"))
    return points.join(beside(by), "frame").withColumn("qn", ratio(F.col("q"), F.col("q_rms"))).withColumn("un", ratio(F.col("u2"), F.col("u2_mean")))


def threshold_counts(points: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """Counts and fractions beyond each threshold in one pass over the points."""
    steps = [("q", a, event(F.col("q"), F.col("q_rms"), a)) for a in alphas] + [("u2", b, F.col("u2") > b * F.col("u2_mean")) for b in betas]
    d = scaled(points).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(steps)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("count")) for i, (k, t, _) in enumerate(steps)]))
    return d.select("frame", "n", each.alias("e")).select("frame", "e.*", clean(F.col("e.count") / F.col("n")).alias("fraction"))


def nested_regions(points: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """For each pair of thresholds, what lies beyond both: one 2-D histogram of levels, then suffix sums of its few cells."""
    level = lambda c, steps: sum((F.col(c) > t).cast("int") for t in steps)
    q = F.col("q")
    cells = scaled(points).groupBy("frame", level("qn", alphas).alias("la"), level("un", betas).alias("lb")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("u2").alias("u2"), F.sum(F.greatest(q, F.lit(0.0))).alias("q_positive"), F.sum(q * q).alias("q_squared"))
    inside = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("la")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("lb"))))
    sums = inside.groupBy("frame", "i", "j").agg(*[F.sum(c).alias(c) for c in ("count", "u2", "q_positive", "q_squared")])
    threshold = lambda c, steps: F.get(F.array(F.lit(None).cast("double"), *[F.lit(float(t)) for t in steps]), F.col(c))
    return sums.select("frame", threshold("i", alphas).alias("alpha"), threshold("j", betas).alias("beta"), "count", *[F.col(c) for c in ("u2", "q_positive", "q_squared")])


def overlap(points: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """A and B counts, intersection, conditional shares and lift over independence, from the nested regions."""
    r = nested_regions(points, alphas, betas).select("frame", "alpha", "beta", "count")
    a = r.where("beta is null and alpha is not null").select("frame", "alpha", F.col("count").alias("a_count"))
    b = r.where("alpha is null and beta is not null").select("frame", "beta", F.col("count").alias("b_count"))
    n = r.where("alpha is null and beta is null").select("frame", F.col("count").alias("n"))
    both = r.where("alpha is not null and beta is not null").withColumnRenamed("count", "i")
    # Some pairs may be empty: every pair of a frame's thresholds is a row.
    grid = n.join(a, "frame").join(b, "frame").join(both, ["frame", "alpha", "beta"], "left").fillna(0, ["i"])
    return grid.select("frame", "alpha", "beta", "a_count", "b_count", F.col("i").alias("intersection_count"),
                       clean(ratio(F.col("i"), F.col("b_count"))).alias("p_a_given_b"), clean(ratio(F.col("i"), F.col("a_count"))).alias("p_b_given_a"),
                       clean(ratio(F.col("n") * F.col("i"), F.col("a_count") * F.col("b_count"))).alias("lift"))


def with_angles(points: DataFrame) -> DataFrame:
    """points with theta, the angle of u and g in degrees, and theta_force = 180 - theta."""
    norm = F.sqrt(F.col("u2")) * F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    d = points.withColumn("theta", angle_degrees(-F.col("q"), norm))
    return d.withColumn("theta_force", 180 - F.col("theta"))


def angle_summary(points: DataFrame) -> DataFrame:
    a = F.col("theta_force")
    known = with_angles(points).where(a.isNotNull())
    d = known.groupBy("frame").agg(F.count(F.lit(1)).alias("count"), F.avg(a).alias("m"), F.avg(F.cos(F.radians(a))).alias("c"), F.corr(a, F.col("q")).alias("r"))
    p = exact_percentiles(known, "frame", "theta_force", [0.05, 0.5, 0.95]).withColumnRenamed("frame", "of")
    d = d.join(F.broadcast(p), F.col("frame").eqNullSafe(F.col("of")), "left")  # a row per frame
    return d.select("frame", "count", clean(F.col("m")).alias("mean_angle"), clean(F.col("c")).alias("mean_cos"), *[clean(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(("p05", "p50", "p95"))], clean(F.col("r")).alias("corr_q"))


def angle_histogram(points: DataFrame, n: int = 36) -> DataFrame:
    d = with_angles(points).where("theta_force is not null").groupBy(uniform_bin(F.col("theta_force"), 0.0, 180.0, n).alias("bin"), (F.col("q") > 0).alias("q_positive"))
    return d.agg(F.count(F.lit(1)).alias("count"), clean(F.avg("q")).alias("mean_q"))


def near_zero(points: DataFrame) -> DataFrame:
    """Overlapping populations by |q| over its rms: sizes, shares of small features, means."""
    speed, size = F.sqrt("u2"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    cos = F.abs(ratio(F.col("q"), speed * size))
    d = scaled(points).withColumn("speed", speed).withColumn("size", size).withColumn("cos", cos)
    names = [("all", F.lit(True)), *((f"q<{t}", F.abs("qn") < t) for t in (1.0, 0.5, 0.1))]
    d = d.withColumn("population", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in names]), lambda x: x.isNotNull())))
    share = lambda c: clean(F.avg(c.cast("double")))
    return d.groupBy("population").agg(F.count(F.lit(1)).alias("count"), share(F.col("speed") < 0.2).alias("slow"), share(F.col("size") < 0.2).alias("flat"), share(F.col("cos") < 0.1).alias("normal"),
                                       clean(F.avg("speed")).alias("mean_speed"), clean(F.avg("cos")).alias("mean_abs_cos"), F.count_if(F.col("q") == 0).alias("exact_zero"))
