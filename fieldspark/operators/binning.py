"""Bins, histograms and what is read off them: G13, G14, G19-G22, G26, G27, G31, G32, W1-W5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, ratio
from fieldspark.operators.stats import exact_percentiles


def uniform_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    """Bin 0..n-1 of equal widths, the last one closed on the right; null outside."""
    width = (hi - lo) / n
    return F.when((value >= lo) & (value <= hi), F.least(F.floor((value - lo) / width), F.lit(n - 1)).cast("int"))


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Bin between given edges by comparison with each (few edges); last bin closed, null outside."""
    inside = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:-1]]), lambda e: e <= value))
    return F.when((value >= edges[0]) & (value <= edges[-1]), inside)


def conditional_mean(points: DataFrame, given: str, value: str, lo: float, hi: float, n: int, least: int = 1) -> DataFrame:
    """Mean of value by uniform bins of given, in each frame; points beyond hi count in the probability only."""
    total = Window.partitionBy("frame")
    by = points.groupBy("frame", uniform_bin(F.col(given), lo, hi, n).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("m"))
    by = by.withColumn("probability", F.col("count") / F.sum("count").over(total)).where("bin is not null")
    width = (hi - lo) / n
    return by.select("frame", "bin", clean(lo + F.col("bin") * width).alias("bin_left"), "count", clean(F.col("probability")).alias("probability"),
                     (F.col("count") >= least).alias("valid"), clean(F.when(F.col("count") >= least, F.col("m"))).alias("conditional_mean"))


def ensemble(by_frame: DataFrame) -> DataFrame:
    """Over frames: mean and sample deviation of the valid conditional means of each bin."""
    m = F.when(F.col("valid"), F.col("conditional_mean"))
    return by_frame.groupBy("bin").agg(F.count(m).alias("valid_frames"), clean(F.avg(m), 4).alias("mean"), clean(F.stddev_samp(m), 4).alias("std"))


def histogram(points: DataFrame, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts, signed and absolute sums, density and cumulated shares by bin; empty bins included."""
    width = (hi - lo) / n
    by = points.groupBy(uniform_bin(F.col(value), lo, hi, n).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("s"), F.sum(F.abs(value)).alias("a"))
    bins = points.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    full = F.broadcast(bins).join(by.where("bin is not null"), "bin", "left").fillna(0)
    all_bins, upto = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # n rows
    onward = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("count").over(all_bins)
    return full.select(
        "bin", clean(lo + F.col("bin") * width).alias("bin_left"), F.col("count").cast("bigint").alias("count"), clean(F.col("s"), 4).alias("signed_sum"), clean(F.col("a"), 4).alias("abs_sum"),
        clean(ratio(F.col("count"), total * width)).alias("density"), clean(ratio(F.sum("count").over(upto), total)).alias("cdf"),
        clean(ratio(F.sum("count").over(onward), total)).alias("ccdf"), clean(ratio(F.sum("a").over(onward), F.sum("a").over(all_bins))).alias("tail_contribution"))


def gradient(rows: DataFrame, x: str, y: str) -> DataFrame:
    """dy/dx over ordered rows: second order inside (uneven steps), one-sided at the ends."""
    w = Window.orderBy(x)
    h0, h1 = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    y0, y1 = F.lag(y).over(w), F.lead(y).over(w)
    inner = (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * F.col(y) - h1 * h1 * y0) / (h0 * h1 * (h0 + h1))
    return rows.withColumn("gradient", F.when(y0.isNull(), (y1 - F.col(y)) / h1).when(y1.isNull(), (F.col(y) - y0) / h0).otherwise(inner))


def histogram_quantile(hist: DataFrame, lo: float, width: float, share: float) -> DataFrame:
    """One row: the quantile of (bin, count) rows, linear inside the bin."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.where("count > 0").select("bin", "count", F.sum("count").over(w).alias("c"), F.sum("count").over(Window.partitionBy()).alias("n"))
    hit = d.where(F.col("c") >= share * F.col("n")).agg(F.min_by(F.struct("bin", "count", "c", "n"), "bin").alias("h")).select("h.*")
    inside = (share * F.col("n") - (F.col("c") - F.col("count"))) / F.col("count")
    return hit.select(F.lit(share).alias("share"), clean(lo + (F.col("bin") + inside) * width).alias("quantile"))


def conditional_tails(points: DataFrame, given: str, value: str, edges: list[float], regions: list[str], least: int = 100) -> DataFrame:
    """Counts, means and central ranges of value between irregular edges of given."""
    binned = points.withColumn("bin", edge_bin(F.col(given), edges)).where("bin is not null")
    by = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("m"))
    by = by.join(F.broadcast(exact_percentiles(binned, "bin", value, [0.025, 0.25, 0.75, 0.975])), "bin", "left")  # a row per bin
    name = F.element_at(F.array(*[F.lit(r) for r in regions]), F.col("bin") + 1)
    total = F.sum("count").over(Window.partitionBy())
    return by.select("bin", name.alias("region"), "count", clean(F.col("count") / total).alias("volume_fraction"), clean(F.col("m")).alias("conditional_mean"),
                     (F.col("count") >= least).alias("reliable"), *[clean(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(("p025", "p25", "p75", "p975"))])


def density_2d(points: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], n: int) -> DataFrame:
    """Sparse joint counts and probability density (integral 1) on n x n bins."""
    x0, x1, y0, y1 = bounds
    by = points.groupBy(uniform_bin(F.col(x), x0, x1, n).alias("bx"), uniform_bin(F.col(y), y0, y1, n).alias("by")).agg(F.count(F.lit(1)).alias("count"))
    by = by.where("bx is not null and by is not null")
    area = (x1 - x0) * (y1 - y0) / n / n
    total = by.agg(F.sum("count").alias("total"))
    return by.join(F.broadcast(total)).select("bx", "by", "count", clean(F.col("count") / F.col("total") / area, 8).alias("density"))  # one row


def density_3d(points: DataFrame, columns: tuple[str, str, str], bounds: list[tuple[float, float]], n: int) -> DataFrame:
    names = ("bx", "by", "bz")
    by = points.groupBy(*[uniform_bin(F.col(c), lo, hi, n).alias(b) for c, b, (lo, hi) in zip(columns, names, bounds, strict=True)]).agg(F.count(F.lit(1)).alias("count"))
    return by.where(" and ".join(f"{b} is not null" for b in names))


def top_density(density: DataFrame, share: float = 0.95) -> DataFrame:
    """Occupied bins at or above a percentile of the densities."""
    edge = density.agg(F.percentile("density", share).alias("edge"))
    return density.join(F.broadcast(edge)).where(F.col("density") >= F.col("edge")).drop("edge")  # one row


def log_moments(points: DataFrame, value: str, rms: float) -> DataFrame:
    """Of log10(|value| / rms), weighted by |value|, by sign: counts, weight, mean, deviation, skewness, excess kurtosis; zeros out."""
    v = F.col(value)
    d = points.where(v != 0).select(F.when(v < 0, "forward").otherwise("backscatter").alias("branch"), F.abs(v).alias("w"), F.log10(F.abs(v) / rms).alias("y"))
    s = d.groupBy("branch").agg(F.count(F.lit(1)).alias("count"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.pow("y", F.lit(k))).alias(f"m{k}") for k in (1, 2, 3, 4)])
    m1, m2, m3, m4 = (F.col(f"m{k}") / F.col("w") for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    third = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return s.select("branch", "count", clean(F.col("w"), 4).alias("weight"), clean(m1).alias("mu_log10"), clean(F.sqrt(var)).alias("sigma_log10"),
                    clean(third / (var * F.sqrt(var)), 4).alias("skewness"), clean(fourth / (var * var) - 3, 4).alias("excess_kurtosis"))
