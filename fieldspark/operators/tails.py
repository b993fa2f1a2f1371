"""Tail plans of a value and what is conditioned on them: F5-F7, G14, G18, G20-G25, O3, O4, W4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, ratio
from fieldspark.operators.binning import histogram_quantile
from fieldspark.operators.events import scaled, with_angles
from fieldspark.operators.stats import beside, exact_percentiles, exact_percentiles_of

TAILS, CENTRE = 20, 60
BINS = 2 * TAILS + CENTRE


def tail_plan(points: DataFrame, value: str, outer: float = 0.025, flat_tails: bool = False) -> DataFrame:
    """One row per frame: lo, lower, upper, hi of a value, `outer` of the points lying in each tail.

    A centre or a tail without a width is an error; flat_tails lets such tails through, which hold only
    points at the extreme itself.
    """
    p = exact_percentiles(points, "frame", value, [0.0, outer, 1 - outer, 1.0])
    plan = p.select("frame", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("lo", "lower", "upper", "hi"))])
    if plan.where("not lower < upper").count():
        raise ValueError(f"{value} has a centre without a width")
    if not flat_tails and plan.where("not (lo < lower and upper < hi)").count():
        raise ValueError(f"{value} has a tail without a width")
    return plan


def _share(x: Column, a: Column, b: Column) -> Column:
    """Where x lies between a and b: by ratio if both have one sign, else by difference; 0 where they are equal."""
    by_ratio = ratio(F.ln(F.abs(x)) - F.ln(F.abs(a)), F.ln(F.abs(b)) - F.ln(F.abs(a)))
    return F.coalesce(F.when(a * b > 0, by_ratio).otherwise(ratio(x - a, b - a)), F.lit(0.0))


def _edge(i: Column, n: int, a: Column, b: Column, geometric: bool) -> Column:
    line = a + (b - a) * i / n
    return F.when(a * b > 0, a * F.pow(b / a, i / F.lit(float(n)))).otherwise(line) if geometric else line


def tail_bin(x: Column, plan: str = "") -> Column:
    """Bin of a value under its plan's columns: 20 in the lower tail, 60 in the centre, 20 in the upper tail; the last is closed."""
    lo, lower, upper, hi = (F.col(f"{plan}{n}") for n in ("lo", "lower", "upper", "hi"))
    part = lambda share, n: F.least(F.floor(share * n), F.lit(n - 1)).cast("int")
    return F.when(x < lower, part(_share(x, lo, lower), TAILS)).when(x < upper, TAILS + part((x - lower) / (upper - lower), CENTRE)).otherwise(
        TAILS + CENTRE + part(_share(x, upper, hi), TAILS))


def bin_edges(plan: DataFrame) -> DataFrame:
    """frame, bin, region, bin_left, bin_right, bin_center (a geometric mean in tails of one sign) and bin_width of a plan."""
    lo, lower, upper, hi, b = (F.col(n) for n in ("lo", "lower", "upper", "hi", "bin"))
    d = plan.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    at = lambda k: F.when(b < TAILS, _edge(b + k, TAILS, lo, lower, True)).when(b < TAILS + CENTRE, _edge(b - TAILS + k, CENTRE, lower, upper, False)).otherwise(
        _edge(b - TAILS - CENTRE + k, TAILS, upper, hi, True))
    region = F.when(b < TAILS, "lower_tail").when(b < TAILS + CENTRE, "center").otherwise("upper_tail")
    d = d.select("frame", "bin", region.alias("region"), at(0).alias("bin_left"), at(1).alias("bin_right"))
    left, right = F.col("bin_left"), F.col("bin_right")
    middle = F.when((F.col("region") != "center") & (left * right > 0), F.signum(left) * F.sqrt(left * right)).otherwise((left + right) / 2)
    return d.select("*", middle.alias("bin_center"), (right - left).alias("bin_width"))


def conditional_both(points: DataFrame, x: str, y: str, least: int = 100, coverage: float = 0.5, flat_tails: bool = False) -> DataFrame:
    """For y given x and x given y: the mean and the central range of the one in each bin of the other, by frame.

    A point's bin is found by arithmetic from its frame's plan, a row per frame; the ranges are exact
    percentiles for all bins together, so sparse bins need no other treatment.
    """
    out = None
    for given, of in ((x, y), (y, x)):
        plan = tail_plan(points, given, flat_tails=flat_tails)
        d = points.join(beside(plan), "frame").select("frame", tail_bin(F.col(given)).alias("bin"), F.col(of).alias("v"))
        d = d.withColumn("key", F.col("frame").cast("bigint") * BINS + F.col("bin"))
        by = d.groupBy("frame", "bin", "key").agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("m"))
        ranges = exact_percentiles(d, "key", "v", [(1 - coverage) / 2, (1 + coverage) / 2])
        sizes = by.groupBy("frame").agg(F.sum("count").alias("n"))
        # Rows here are bins: frames times BINS.
        rows = bin_edges(plan).join(by, ["frame", "bin"], "left").join(beside(ranges), "key", "left").join(beside(sizes), "frame")
        rows = rows.select(
            F.lit(f"{of}_given_{given}").alias("direction"), "frame", "bin", "region", "bin_left", "bin_right", "bin_center", "bin_width",
            F.coalesce("count", F.lit(0)).alias("count"), clean(F.coalesce("count", F.lit(0)) / F.col("n")).alias("volume_fraction"), F.col("m").alias("conditional_mean"),
            (F.coalesce("count", F.lit(0)) >= least).alias("reliable"), clean(F.get("p", F.lit(0)), 8).alias("range_low"), clean(F.get("p", F.lit(1)), 8).alias("range_high"))
        out = rows if out is None else out.unionByName(rows)
    return out


def modal_bin(conditional: DataFrame, direction: str) -> DataFrame:
    """Per frame, the central bin with most points (the first of equals) and its edges."""
    d = conditional.where((F.col("direction") == direction) & (F.col("region") == "center"))
    best = d.groupBy("frame").agg(F.min_by(F.struct("bin", "count", "bin_left", "bin_right"), F.struct(-F.col("count"), "bin")).alias("b"))
    return best.select("frame", "b.*")


def grid_quantiles(points: DataFrame, column: str, shares: list[float], bins: int = 131072) -> DataFrame:
    """Quantiles read off a fine histogram of the whole range: share, quantile."""
    r = points.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if r["lo"] is None:
        return points.sparkSession.createDataFrame([], "share double, quantile double")
    margin = max(abs(r["lo"]), abs(r["hi"]), 1) * 1e-5
    lo, width = r["lo"] - margin, (r["hi"] - r["lo"] + 2 * margin) / bins
    hist = points.groupBy(F.floor((F.col(column) - lo) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = None
    for share in shares:
        q = histogram_quantile(hist, lo, width, share)
        out = q if out is None else out.unionByName(q)
    return out


def common_edge(points: DataFrame, bins: int = 10, share: float = 0.999, least: int = 20) -> DataFrame:
    """Over frames: mean and sample deviation of conditional means of qn in bins of un that all frames share.

    The upper edge is the largest of the frames' percentiles of un, so no frame decides alone.
    """
    d = scaled(points).select("frame", F.round("qn", 9).alias("qn"), F.round("un", 9).alias("un"))
    p = exact_percentiles(d, "frame", "un", [share])
    hi = p.agg(F.max(F.round(F.get("p", F.lit(0)), 9)).alias("hi")).first()["hi"] or 1.0
    by = d.where(F.col("un") <= hi).groupBy("frame", F.least(F.floor(F.col("un") / hi * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("qn").alias("m"))
    good = F.when(F.col("n") >= least, F.col("m"))
    return by.groupBy("bin").agg(clean(F.lit(hi)).alias("upper_edge"), F.count(good).alias("valid_frames"), clean(F.avg(good), 4).alias("mean"), clean(F.stddev_samp(good), 4).alias("std"))


def overlap_points(vectors: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Points beyond both thresholds, of all frames as one: theta, qn, un."""
    d = scaled(with_angles(vectors.withColumn("frame", F.lit(0)))).where((F.col("qn") > alpha) & (F.col("un") > beta) & F.col("theta_force").isNotNull())
    return d.select("frame", F.col("theta_force").alias("theta"), F.round("qn", 9).alias("qn"), F.round("un", 9).alias("un"))


def overlap_angles(vectors: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """One row: size, mean angle and cosine, five percentiles, correlations with q and u2 of the overlap set."""
    d = overlap_points(vectors, alpha, beta)
    p = exact_percentiles(d, "frame", "theta", [0.025, 0.25, 0.5, 0.75, 0.975])
    a = d.groupBy("frame").agg(F.count(F.lit(1)).alias("count"), F.avg("theta").alias("m"), F.avg(F.cos(F.radians("theta"))).alias("c"), F.corr("theta", "qn").alias("rq"), F.corr("theta", "un").alias("ru"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    a = a.join(F.broadcast(p), "frame").join(F.broadcast(n))  # one row each
    return a.select("count", clean(F.col("count") / F.col("n")).alias("volume_fraction"), clean(F.col("m")).alias("mean_angle"), clean(F.col("c")).alias("mean_cos"),
                    *[clean(F.get("p", F.lit(k))).alias(x) for k, x in enumerate(("p025", "p25", "p50", "p75", "p975"))], clean(F.col("rq")).alias("corr_q"), clean(F.col("ru")).alias("corr_u2"))


def _angle_bins(d: DataFrame, given: str) -> DataFrame:
    """d with bin 0 (below the centre), 1-40 and 41 (above), and the edges of the centre a and b."""
    p = exact_percentiles(d, "frame", given, [0.025, 0.975]).select("frame", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    x = F.col(given)
    inner = 1 + F.least(F.floor((x - F.col("a")) / (F.col("b") - F.col("a")) * 40), F.lit(39))
    return d.join(F.broadcast(p), "frame").withColumn("bin", F.when(x < F.col("a"), 0).when(x >= F.col("b"), 41).otherwise(inner).cast("int"))


def overlap_angle_bins(vectors: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Angles of the overlap set by bins of q and of u2: 40 central ones and a tail on each side; empty bins are left out."""
    d, out = overlap_points(vectors, alpha, beta), None
    for given in ("qn", "un"):
        binned = _angle_bins(d, given)
        p = exact_percentiles(binned, "bin", "theta", [0.25, 0.75])
        total = d.agg(F.count(F.lit(1)).alias("n"))
        by = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg(given).alias("x"), F.avg("theta").alias("m"), F.avg(F.cos(F.radians("theta"))).alias("c"))
        rows = by.join(F.broadcast(p), "bin").join(F.broadcast(total)).select(
            F.lit(given).alias("given"), "bin", "count", clean(F.col("count") / F.col("n")).alias("fraction"), clean(F.col("x")).alias("x_mean"), clean(F.col("m")).alias("mean_angle"), clean(F.col("c")).alias("mean_cos"),
            clean(F.get("p", F.lit(0))).alias("p25"), clean(F.get("p", F.lit(1))).alias("p75"))
        out = rows if out is None else out.unionByName(rows)
    return out


def lowest_q_angles(vectors: DataFrame, alpha: float = 1.0, beta: float = 1.0, rows: int = 2) -> DataFrame:
    """Angles of the overlap set in bins of one degree, for the lowest bins of q that hold points."""
    d = _angle_bins(overlap_points(vectors, alpha, beta), "qn")
    lowest = d.select("bin").distinct().orderBy("bin").limit(rows)
    return d.join(F.broadcast(lowest), "bin").groupBy("bin", F.least(F.floor("theta"), F.lit(179)).cast("int").alias("degree")).agg(F.count(F.lit(1)).alias("count"))


#: Populations by |q| over its rms, beside all points and those of the modal bin.
LIMITS = (0.1, 0.05, 0.01)


def near_zero_features(vectors: DataFrame) -> DataFrame:
    """Five overlapping populations of points with little power, and how often each way to have little power occurs in them.

    Means and quartiles of speed (over the rms velocity), gradient (over its rms) and |cos|, exact zeros.
    The populations of a point are listed in its row, so one pass serves them all.
    """
    d = vectors.withColumn("frame", F.lit(0)).withColumn("g2", F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    # One row of scales.
    scales = d.agg(F.sqrt(F.avg(F.col("q") * F.col("q"))).alias("q_rms"), F.avg("u2").alias("u2_mean"), F.sqrt(F.avg("g2")).alias("g_rms"))
    amp = F.sqrt(F.col("u2") * F.col("g2"))
    d = d.join(F.broadcast(scales)).select("frame", "u2", "g2", "q", F.round(F.col("q") / F.col("q_rms"), 9).alias("qn"), F.round(F.sqrt(F.col("u2") / F.col("u2_mean")), 9).alias("speed"),
                                           F.round(F.sqrt("g2") / F.col("g_rms"), 9).alias("gradient"), F.round(F.least(ratio(F.abs("q"), amp), F.lit(1.0)), 9).alias("cos"), F.round(amp / F.col("q_rms"), 9).alias("amplitude"))
    plan = tail_plan(d, "qn", flat_tails=True)  # one frame, whose exact zeros may fill a tail
    binned = d.join(F.broadcast(plan), "frame").withColumn("bin", tail_bin(F.col("qn")))
    peak = binned.where(F.col("bin").between(TAILS, TAILS + CENTRE - 1)).groupBy("bin").count().orderBy(F.desc("count"), "bin").limit(1).select(F.col("bin").alias("peak"))
    binned = binned.join(F.broadcast(peak), how="left")
    names = [("all", F.lit(True)), *((f"q<{t}", F.abs("qn") < t) for t in LIMITS), ("peak", F.col("bin") == F.col("peak"))]
    each = binned.withColumn("population", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in names]), lambda x: x.isNotNull())))
    slow, flat, normal = F.col("speed") < 0.1, F.col("gradient") < 0.1, F.coalesce(F.col("cos") < 0.1, F.lit(False))
    features = {"slow": slow, "flat": flat, "normal": normal, "only_normal": ~slow & ~flat & normal, "slow_or_flat": slow | flat, "slow_and_flat": slow & flat, "regular": ~slow & ~flat & ~normal, "weak": F.col("amplitude") < 0.1}
    by = each.groupBy("population").agg(
        F.count(F.lit(1)).alias("count"), *[clean(F.avg(c.cast("double"))).alias(k) for k, c in features.items()],
        *[clean(F.avg(c)).alias(n) for n, c in (("speed2_mean", F.col("speed") ** 2), ("gradient2_mean", F.col("gradient") ** 2), ("cos_mean", F.col("cos")), ("amplitude_mean", F.col("amplitude")))],
        clean(F.sqrt(F.avg(F.col("cos") ** 2))).alias("cos_rms"), F.count_if(F.col("q") == 0).alias("zero_power"), F.count_if(F.col("u2") == 0).alias("zero_velocity"), F.count_if(F.col("g2") == 0).alias("zero_gradient"))
    p = exact_percentiles_of(each, "population", ["speed", "gradient", "cos"], [0.25, 0.5, 0.75])
    wide = p.groupBy("population").agg(*[clean(F.get(F.max(F.when(F.col("column") == c, F.col("p"))), F.lit(k))).alias(f"{c}_p{n}") for c in ("speed", "gradient", "cos") for k, n in enumerate((25, 50, 75))])
    return by.join(beside(wide), "population", "left")  # five rows
