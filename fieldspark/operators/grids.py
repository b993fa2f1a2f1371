"""Planes, sampled grids, histograms by rms, block tables, flux points and display scales: F9, F10, F12, F14, G9, G10, G26, G29, G30, G35-G37, P12, P15-P18, U2, U3, U7."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, ratio
from fieldspark.operators.lattices import AXES, blocks, stencil
from fieldspark.operators.stats import beside, exact_percentiles

NORMALS = {"xy": "z", "xz": "y", "yz": "x"}


def sampled_indices(size: int, step: int, required: list[int]) -> list[int]:
    """Every step-th index from 0, the last one and the required ones, once each and in order."""
    if any(not 0 <= k < size for k in required):
        raise ValueError("a required index lies outside the axis")
    return sorted({*range(0, size, step), size - 1, *required})


def coordinate(index: Column, size: int, length: float) -> Column:
    """Place of a lattice index on a periodic axis, whose far end is its beginning."""
    return index * F.lit(length) / size


def physical_time(frame: Column, step: float) -> Column:
    """Time of a frame that counts from 1."""
    return (frame - 1) * F.lit(step)


def stepped_planes(points: DataFrame, sizes: dict[str, int], step: int, length: float = 2 * math.pi) -> DataFrame:
    """The middle planes, sampled along both axes at every step, the last index and where the planes meet.

    plane, x, y, z, their physical coordinates px, py, pz, and v.  The filters are lists of indices of an axis.
    """
    middle = {a: n // 2 for a, n in sizes.items()}
    kept = {a: F.col(a).isin(sampled_indices(n, step, [middle[a]])) for a, n in sizes.items()}
    flags = []
    for plane, normal in NORMALS.items():
        on = F.col(normal) == middle[normal]
        for a in AXES:
            on = on if a == normal else on & kept[a]
        flags.append(F.when(on, F.lit(plane)))
    planes = F.filter(F.array(*flags), lambda p: p.isNotNull())
    d = points.where(F.size(planes) > 0).select(F.explode(planes).alias("plane"), *AXES, "v")
    return d.select("plane", *AXES, *[clean(coordinate(F.col(a), sizes[a], length)).alias(f"p{a}") for a in AXES], "v")


def comparison_slices(points: DataFrame, sizes: dict[str, int], stride: int = 2) -> DataFrame:
    """The middle xy plane of a field beside its smoothed form (1, 2, 1 along z), on the lattice that both are sampled on."""
    at = sizes["z"] // 2
    keep = (F.col("z") == at) & (F.col("x") % stride == 0) & (F.col("y") % stride == 0)
    near = points.where(F.col("z").isin([(at + k) % sizes["z"] for k in (-1, 0, 1)]))
    smooth = stencil(near, "z", sizes["z"], {-1: 0.25, 0: 0.5, 1: 0.25}, "filtered").where(keep)
    both = points.where(keep).select(*AXES, F.col("v").alias("raw")).join(smooth, list(AXES))
    return both.select(*AXES, "raw", clean(F.col("filtered"), 5).alias("filtered"))


def plane_limits(planes: DataFrame, share: float = 0.99) -> DataFrame:
    """Symmetric limit of each plane's values: a percentile of |v|, the largest where that is 0, 1 where all are."""
    d = planes.select("plane", F.abs("v").alias("size"))
    p = exact_percentiles(d, "plane", "size", [share])
    by = d.groupBy("plane").agg(F.max("size").alias("most")).join(F.broadcast(p), "plane", "left")
    own = F.get("p", F.lit(0))
    return by.select("plane", clean(F.when(own > 0, own).when(F.col("most") > 0, F.col("most")).otherwise(1.0)).alias("limit"))


def first_chunks(points: DataFrame, sizes: dict[str, int], chunk: int, many: int) -> DataFrame:
    """Points of the first `many` chunks in z-major order, with their chunk's number."""
    across = {a: -(-n // chunk) for a, n in sizes.items()}
    number = (F.floor(F.col("z") / chunk) * across["y"] + F.floor(F.col("y") / chunk)) * across["x"] + F.floor(F.col("x") / chunk)
    return points.withColumn("chunk", number).where(F.col("chunk") < many)


def block_table(points: DataFrame, sizes: dict[str, int], divisions: int, square: str, length: float) -> DataFrame:
    """One row per block: place as indices and coordinates, moments of v, the mean of a square, and both means over those of the whole."""
    v, s = F.col("v"), F.col(square)
    by = blocks(points, sizes, divisions).groupBy("block_id", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("v"), F.sum(v * v).alias("vv"), F.sum(s).alias("s"))
    whole = by.agg(F.sum("n").alias("all_n"), F.sum("v").alias("all_v"), F.sum("s").alias("all_s"))  # divisions ** 3 rows
    d = by.join(F.broadcast(whole))
    mean, square_mean = F.col("v") / F.col("n"), F.col("s") / F.col("n")
    begin = [clean(coordinate(F.col(f"b{a}") * (sizes[a] // divisions), sizes[a], length)).alias(f"{a}_begin") for a in AXES]
    return d.select("block_id", "bx", "by", "bz", *begin, F.col("n").alias("point_count"), clean(mean).alias("mean"), clean(F.sqrt(F.greatest(F.col("vv") / F.col("n") - mean * mean, F.lit(0.0))), 4).alias("std"),
                    clean(square_mean).alias("sij_sij_mean"), clean(ratio(mean, F.col("all_v") / F.col("all_n"))).alias("mean_ratio"), clean(ratio(square_mean, F.col("all_s") / F.col("all_n"))).alias("square_ratio"))


def cube_block_sums(cells: DataFrame, n: int, divisions: int, value: str) -> DataFrame:
    """Sums and means of a value over the blocks of cubes given as (frame, p) cells."""
    side = n // divisions
    p = F.col("p")
    part = lambda stride: F.floor(F.floor(p / stride).cast("int") % n / side).cast("int")
    block = (part(n * n) * divisions + part(n)) * divisions + part(1)
    return cells.groupBy("frame", block.alias("block_id")).agg(F.count(F.lit(1)).alias("point_count"), clean(F.sum(value)).alias("sum"), clean(F.avg(value)).alias("mean"))


def normalized_histograms(points: DataFrame, value: str, reach: float = 3.0, bins: int = 24, tail_start: float = 1.0, tail_step: float = 0.25, tail_bins: int = 12) -> DataFrame:
    """Of value over its rms, two histograms in one pass: `central` on [-reach, reach] and `tail` of its size, whose bin 0 is [0, tail_start).

    kind, bin, bin_left, count, signed_sum, abs_sum, density (over all points).  Central bins -1 and
    `bins`, and the last tail bin, hold what lies outside, so counts of a kind add up to all points.
    """
    rms = points.agg(F.sqrt(F.avg(F.col(value) ** 2)).alias("rms"), F.count(F.lit(1)).alias("total"))
    d = points.join(F.broadcast(rms)).select(F.col(value).alias("v"), "total", F.round(F.col(value) / F.col("rms"), 9).alias("x"))  # one row
    width = 2 * reach / bins
    x, size = F.col("x"), F.abs("x")
    central = F.when(x < -reach, -1).when(x > reach, bins).otherwise(F.least(F.floor((x + reach) / width), F.lit(bins - 1)))
    tail = F.when(size < tail_start, 0).otherwise(F.least(1 + F.floor((size - tail_start) / tail_step), F.lit(tail_bins)))
    kinds = F.explode(F.array(F.struct(F.lit("central").alias("kind"), central.cast("int").alias("bin")), F.struct(F.lit("tail").alias("kind"), tail.cast("int").alias("bin"))))
    by = d.select("v", "total", kinds.alias("k")).groupBy("k.kind", "k.bin", "total").agg(F.count(F.lit(1)).alias("count"), F.sum("v").alias("s"), F.sum(F.abs("v")).alias("a"))
    c = F.col("kind") == "central"
    inside = F.when(c, F.col("bin").between(0, bins - 1)).otherwise(F.col("bin") < tail_bins)
    left = F.when(c, -reach + F.col("bin") * width).when(F.col("bin") == 0, 0.0).otherwise(tail_start + (F.col("bin") - 1) * tail_step)
    own = F.when(c, width).when(F.col("bin") == 0, tail_start).otherwise(tail_step)
    return by.select("kind", "bin", clean(F.when(inside, left)).alias("bin_left"), "count", clean(F.col("s"), 4).alias("signed_sum"), clean(F.col("a"), 4).alias("abs_sum"), clean(F.when(inside, F.col("count") / F.col("total") / own)).alias("density"))


def pdf_summary(points: DataFrame, value: str) -> DataFrame:
    """Per frame: shares by sign and beyond one and two rms, mean over rms."""
    rms = points.groupBy("frame").agg(F.sqrt(F.avg(F.col(value) ** 2)).alias("rms"))
    d = points.join(beside(rms), "frame").select("frame", "rms", F.col(value).alias("v"))
    share = lambda c: clean(F.avg(c.cast("double")))
    v = F.col("v")
    return d.groupBy("frame").agg(F.count(F.lit(1)).alias("count"), share(v < 0).alias("forward"), share(v > 0).alias("backscatter"), share(F.abs(v) > F.col("rms")).alias("beyond_rms"), share(F.abs(v) > 2 * F.col("rms")).alias("beyond_2_rms"),
                                  clean(F.avg(v) / F.max("rms")).alias("mean_over_rms"))


#: The coefficients of formula 7.1.26 of Abramowitz and Stegun for the error function (error under 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_pdf(x: Column, mean: Column, deviation: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / deviation, F.lit(2.0))) / (deviation * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation / math.sqrt(2)
    t = 1 / (1 + ERF_P * F.abs(z))
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    erf = F.signum(z) * (1 - series * F.exp(-z * z))
    return (1 + erf) / 2


#: Shares of the quantiles that are compared with normal ones.
QQ_SHARES = (0.01, 0.05, 0.5, 0.95, 0.99)


def log_normality(points: DataFrame, value: str, scale: float, lo: float, hi: float, bins: int) -> DataFrame:
    """How normal log10(|value| / scale), weighted by |value|, is in each sign branch; zeros belong to none.

    mean and deviation from weighted moments of all points; over the bins whose upper edge has 0.5 to
    99.5 % below it: the largest and the rms error of the distribution function, R2 of the density
    (bin middles), and the curvature of a parabola through the logarithm of the density.  skewness and
    excess_kurtosis from weighted moments of all points; qq_r2: how the middles of the bins that hold the
    weighted quantiles of QQ_SHARES lie on the normal quantiles.
    """
    v, y = F.col(value), F.col("y")
    d = points.where(v != 0).select(F.when(v < 0, "forward").otherwise("backscatter").alias("branch"), F.abs(v).alias("w"), F.log10(F.abs(v) / scale).alias("y"))
    width = (hi - lo) / bins
    place = F.when((y >= lo) & (y <= hi), F.least(F.floor((y - lo) / width), F.lit(bins - 1)).cast("int"))
    by = d.groupBy("branch", place.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * y).alias("wy"), *[F.sum(F.col("w") * F.pow(y, F.lit(float(k)))).alias(f"w{k}") for k in (2, 3, 4)])
    # From here on rows are bins: two branches times `bins`.
    own = Window.partitionBy("branch")
    upto = own.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.when(F.col("bin").isNotNull(), F.col("w"))).over(own)
    mean = lambda c: F.sum(c).over(own) / F.sum("w").over(own)
    m, m2, m3, m4 = mean("wy"), mean("w2"), mean("w3"), mean("w4")
    spread = m2 - m * m
    rows = by.select("branch", "bin", "w", m.alias("mu"), F.sqrt(spread).alias("sd"), ratio(m3 - 3 * m * m2 + 2 * m * m * m, F.pow(spread, F.lit(1.5))).alias("skew"),
                     (ratio(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m, spread * spread) - 3).alias("kurt"),
                     inside.alias("inside"), F.sum(F.when(F.col("bin").isNotNull(), F.col("w"))).over(upto).alias("c")).where("bin is not null")
    # Quantiles: for each share the first bin up to which the weight reaches it.
    shares = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(NormalDist().inv_cdf(s)).alias("z")) for s in QQ_SHARES]))
    held = rows.where("w > 0").select("branch", "mu", "sd", "bin", "c", "inside", shares.alias("q")).where(F.col("c") >= F.col("q.share") * F.col("inside"))
    held = held.groupBy("branch", "q.z").agg(F.min("bin").alias("bin"), F.first("mu").alias("mu"), F.first("sd").alias("sd"))
    at = lo + (F.col("bin") + F.lit(0.5)) * width
    qq = held.groupBy(F.col("branch").alias("of")).agg((1 - ratio(F.sum((at - F.col("mu") - F.col("sd") * F.col("z")) ** 2), F.count(F.lit(1)) * F.var_pop(at))).alias("qq"))
    mu, sd, right = F.col("mu"), F.col("sd"), lo + (F.col("bin") + 1) * width
    middle = lo + (F.col("bin") + F.lit(0.5)) * width
    rows = rows.select("branch", "mu", "sd", "skew", "kurt", (F.col("c") / F.col("inside")).alias("f"), (F.col("w") / F.col("inside") / width).alias("h"), normal_cdf(right, mu, sd).alias("n"), normal_pdf(middle, mu, sd).alias("g"), ((middle - mu) / sd).alias("z"))
    core = rows.where("f >= 0.005 and f <= 0.995")
    z, l = F.col("z"), F.ln("h")
    s = core.groupBy("branch", "mu", "sd", "skew", "kurt").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.abs(F.col("f") - F.col("n"))).alias("worst"), F.sqrt(F.avg((F.col("f") - F.col("n")) ** 2)).alias("rms"), F.sum((F.col("h") - F.col("g")) ** 2).alias("off"), F.var_pop("h").alias("spread"),
        *[F.sum(F.pow(z, F.lit(float(k)))).alias(f"z{k}") for k in (1, 2, 3, 4)], *[F.sum(l * F.pow(z, F.lit(float(k)))).alias(f"l{k}") for k in (0, 1, 2)])
    c = F.col
    # The parabola's leading coefficient by Cramer's rule on the normal equations.
    det = c("k") * (c("z2") * c("z4") - c("z3") ** 2) - c("z1") * (c("z1") * c("z4") - c("z2") * c("z3")) + c("z2") * (c("z1") * c("z3") - c("z2") ** 2)
    top = c("k") * (c("z2") * c("l2") - c("z3") * c("l1")) - c("z1") * (c("z1") * c("l2") - c("z3") * c("l0")) + c("z2") * (c("z1") * c("l1") - c("z2") * c("l0"))
    s = s.join(F.broadcast(qq), c("branch") == c("of"), "left")  # two rows
    return s.select("branch", clean(c("mu")).alias("mean"), clean(c("sd")).alias("deviation"), clean(c("skew")).alias("skewness"), clean(c("kurt")).alias("excess_kurtosis"), clean(c("qq")).alias("qq_r2"), c("k").alias("core_bins"), clean(c("worst")).alias("cdf_max_error"), clean(c("rms")).alias("cdf_rms_error"),
                    clean(1 - ratio(c("off"), c("k") * c("spread"))).alias("pdf_r2"), clean(2 * ratio(top, det), 4).alias("curvature"))


def feature_bounds(points: DataFrame, features: dict[str, Column]) -> DataFrame:
    """feature, min, max: one pass, a row per feature."""
    a = points.agg(*[f(c).alias(f"{n}_{k}") for n, c in features.items() for k, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_lo").alias("min"), F.col(f"{n}_hi").alias("max")) for n in features])
    return a.select(F.explode(rows).alias("r")).select("r.feature", clean(F.col("r.min")).alias("min"), clean(F.col("r.max")).alias("max"))


def display_density(density: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """log10 of a density between its percentiles, as a shade from 0 to 1; -1 where it is empty."""
    d = density.withColumn("l", F.when(F.col("density") > 0, F.round(F.log10("density"), 9))).withColumn("all", F.lit(0))
    p = exact_percentiles(d, "all", "l", [low, high]).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("l") - F.col("a"), F.col("b") - F.col("a"))))
    return d.join(F.broadcast(p), how="left").select("bx", "by", clean(F.coalesce(shade, F.lit(-1.0))).alias("shade"))  # one row


def nice_limits(lo: float, hi: float, ticks: int = 5) -> tuple[float, float, float]:
    """(begin, end, step): whole steps of 1, 2 or 5 times a power of ten around a range."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or hi < lo:
        raise ValueError("limits must be finite and in order")
    span = hi - lo or abs(hi) or 1.0
    raw = span / ticks
    power = 10 ** math.floor(math.log10(raw))
    step = next(k * power for k in (1, 2, 5, 10) if k * power >= raw * (1 - 1e-12))
    return math.floor(lo / step + 1e-9) * step, math.ceil(hi / step - 1e-9) * step, step


def padded_limits(lo: float, hi: float, padding: float = 0.05, ticks: int = 6) -> tuple[float, float]:
    """Whole steps of 1, 2 or 5 times a power of ten that hold a range, zero and a share of padding; both lie beyond the range."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or hi < lo:
        raise ValueError("limits must be finite and in order")
    lo, hi = min(lo, 0.0), max(hi, 0.0)
    span = hi - lo or 1.0
    step = nice_limits(0.0, span, max(ticks, 1))[2]
    first, last = math.floor((lo - span * padding) / step), math.ceil((hi + span * padding) / step)
    return (first - (first * step >= lo)) * step, (last + (last * step <= hi)) * step


#: Half gain of a Gaussian filter lies where k r is this.
HALF_GAIN = math.sqrt(2 * math.log(2))
#: Wavenumber times filter width at the cutoff of each kernel.
CUTOFFS = {"gaussian": HALF_GAIN, "smooth_sharp": math.pi}


def flux_points(means: DataFrame, widths: list[float], reference: list[tuple[str, float, float]], grid: int, length: float, viscosity: float, kernel: str = "gaussian") -> DataFrame:
    """Scale algebra of mean transfers: a row per series, frame and filter width, and the reference rows, ordered within their series.

    means: frame, forward_mean_pi, epsilon.  cutoff is the wavenumber of half gain (gaussian) or of pi over
    the width (smooth_sharp), modes its number of waves in the box, eta the dissipation length, r_over_eta the width that the cutoff stands for.
    """
    spark = means.sparkSession
    ladder = spark.createDataFrame([(float(w),) for w in sorted(set(widths))], "width double")
    eta = F.pow(F.lit(viscosity) ** 3 / F.col("epsilon"), F.lit(0.25))
    cutoff = F.lit(CUTOFFS[kernel]) / (F.col("width") * (length / grid))
    ours = means.where("epsilon > 0").join(F.broadcast(ladder)).select(  # a few widths
        F.concat(F.lit("frame_"), F.col("frame").cast("string")).alias("series"), cutoff.alias("cutoff"), (F.lit(HALF_GAIN) / cutoff / eta).alias("r_over_eta"), ratio(F.col("forward_mean_pi"), F.col("epsilon")).alias("pi_over_epsilon"))
    theirs = spark.createDataFrame([(s, HALF_GAIN / r, r, p) for s, r, p in reference], "series string, cutoff double, r_over_eta double, pi_over_epsilon double")
    nth = F.row_number().over(Window.partitionBy("series").orderBy("r_over_eta"))  # rows of a series: widths
    return ours.unionByName(theirs).select("series", nth.alias("nth"), clean(F.col("cutoff"), 4).alias("cutoff"), clean(F.col("cutoff") * length / (2 * math.pi), 4).alias("modes"), clean(F.col("r_over_eta"), 3).alias("r_over_eta"), clean(F.col("pi_over_epsilon"), 3).alias("pi_over_epsilon"))
