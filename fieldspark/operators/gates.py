"""Quality gates: finite input, closures, divergence, coverage, joins that must match: F13, F15, G1, G2, G5, G7, G33, J2, J4, J7, U5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.scalar import FIELDS, clean, safe_ratio
from fieldspark.operators.regimes import sign_regime


def is_finite(column: Column) -> Column:
    """False for null, NaN and infinite values."""
    return column.isNotNull() & ~F.isnan(column.cast("double")) & (F.abs(column) != float("inf"))


def require_finite(points: DataFrame, *columns: str) -> DataFrame:
    """points as they are; a task that meets a null, NaN or infinite value of the columns fails with its name.

    The check is part of the columns, so it runs only where they are read, and costs no pass.
    """
    checked = {c: F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast(points.schema[c].dataType)) for c in columns}
    return points.withColumns(checked)


def _closed(name: str, left: Column, right: Column, size: Column, tolerance: float) -> Column:
    """A check that two sums agree, as a share of the sum of magnitudes."""
    off = safe_ratio(F.abs(left - right), size)
    return F.struct(F.lit(name).alias("check"), clean(left.cast("double"), 3).alias("left_side"), clean(right.cast("double"), 3).alias("right_side"), (off <= tolerance).alias("passed"))


def closures(points: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Partition checks, one row each: the regimes against the whole for every field, both signs of pi against its sum, directions against counts.

    Input that is not finite is an error.  Regimes are one grouped pass; the whole is summed apart from
    them, in a second one, or the comparison would say nothing.
    """
    d = require_finite(points, "pi", "s_bar", "work_full", "work_resolved").withColumn("delta_w", F.col("work_full") - F.col("work_resolved")).withColumn("regime", sign_regime())
    pi, zero = F.col("pi"), F.lit(0.0)
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(pi > 0).alias("np"), F.count_if(pi < 0).alias("nn"), F.count_if(pi == 0).alias("nz"), F.sum(F.greatest(pi, zero)).alias("pos"), F.sum(F.least(pi, zero)).alias("neg"),
            *[x for f in FIELDS for x in (F.sum(f).alias(f), F.sum(F.abs(f)).alias(f"abs_{f}"))]]
    names = ["n", "np", "nn", "nz", "pos", "neg", *FIELDS, *[f"abs_{f}" for f in FIELDS]]
    by = d.groupBy("regime").agg(*sums)
    parts = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"r_{c}") for c in names], F.coalesce(F.sum(F.col("np") + F.col("nn") + F.col("nz")), F.lit(0)).alias("signs"))
    whole = d.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f), zero).alias(f) for f in FIELDS], *[F.coalesce(F.sum(F.abs(f)), zero).alias(f"abs_{f}") for f in FIELDS])
    one = whole.join(F.broadcast(parts))  # one row each
    c = F.col
    checks = [_closed("regime_counts", c("r_n"), c("n"), c("n"), 0.0), _closed("direction_counts", c("signs"), c("n"), c("n"), 0.0), _closed("signed_parts_of_pi", c("r_pos") + c("r_neg"), c("pi"), c("abs_pi"), tolerance),
              _closed("magnitudes_of_pi", c("r_pos") - c("r_neg"), c("abs_pi"), c("abs_pi"), tolerance), *[_closed(f"regimes_of_{f}", c(f"r_{f}"), c(f), c(f"abs_{f}"), tolerance) for f in FIELDS]]
    return one.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def enforce(checks: DataFrame) -> None:
    """Raises with the names of the checks that did not pass."""
    failed = [r["check"] for r in checks.where("not coalesce(passed, false)").select("check").limit(100).collect()]
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def divergence_gate(fields: DataFrame, rms_limit: float = 1e-4, max_limit: float = 1e-3) -> DataFrame:
    """Per frame: divergence over the strain it stands beside, by rms and by maximum, and whether both are within limits."""
    by = fields.groupBy("frame").agg(F.sqrt(F.avg(F.col("divergence") ** 2)).alias("d"), F.max(F.abs("divergence")).alias("dm"), F.sqrt(F.avg("strain")).alias("s"), F.sqrt(F.max("strain")).alias("sm"))
    rms, most = safe_ratio(F.col("d"), F.col("s")), safe_ratio(F.col("dm"), F.col("sm"))
    return by.select("frame", clean(rms).alias("rms_ratio"), clean(most).alias("max_ratio"), (rms <= rms_limit).alias("rms_passed"), (most <= max_limit).alias("max_passed"))


def preflight(points: DataFrame, sizes: dict[str, int], value: str = "v") -> DataFrame:
    """Checks of a lattice before any work: check, expected, found, passed.

    Every place is covered exactly once, lies inside, and its value is finite.
    """
    total = reduce(lambda a, b: a * b, sizes.values(), 1)
    inside = reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in sizes.items()])
    each = points.groupBy(*sizes).agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(F.col(value))).alias("bad"), F.max(inside.cast("int")).alias("inside"))
    r = each.agg(F.count_if(F.col("inside") == 1).alias("covered"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("nonfinite"), F.count_if(F.col("inside") == 0).alias("outside"))
    row = lambda name, want: F.struct(F.lit(name).alias("check"), F.lit(want).cast("bigint").alias("expected"), F.col(name).cast("bigint").alias("found"), (F.col(name) == want).alias("passed"))
    return r.select(F.explode(F.array(row("covered", total), row("repeated", 0), row("nonfinite", 0), row("outside", 0))).alias("x")).select("x.*")


def joined_by_place(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right joined by their places; a place that only one of them has, or has twice, is an error.

    The sides are compared in the join itself: a full join whose unmatched rows fail their task.
    """
    mark = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__{n}"), *[F.max(c).alias(c) for c in d.columns if c not in keys])
    both = mark(left, "l").join(mark(right, "r"), keys, "full")
    good = (F.coalesce("__l", F.lit(0)) == 1) & (F.coalesce("__r", F.lit(0)) == 1)
    first = F.when(good, F.col(keys[0])).otherwise(F.raise_error(F.lit("the tables do not have the same places once each")).cast(both.schema[keys[0]].dataType))
    return both.withColumn(keys[0], first).drop("__l", "__r")


def matching_counts(ours: DataFrame, theirs: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows of two tables of counts side by side: keys, count of each, passed."""
    a, b = ours.select(*keys, F.col(count).alias("own_count")), theirs.select(*keys, F.col(count).alias("other_count"))
    return a.join(b, keys, "full").withColumn("passed", F.col("own_count").eqNullSafe(F.col("other_count")))


def frame_measures(points: DataFrame) -> DataFrame:
    """frame, measure, value: what frames are judged by, without a judgement, from one grouped pass.

    identity_residual: rms of work_full - work_resolved + pi - s_bar over the joint rms of its terms;
    identity_worst: its largest magnitude; net_ratio: |sum of s_bar| over |sum of pi|, null where the
    latter vanishes; nonfinite: how many values of pi are no numbers.
    """
    terms = ("work_full", "work_resolved", "pi", "s_bar")
    r = F.col("work_full") - F.col("work_resolved") + F.col("pi") - F.col("s_bar")
    square = lambda c: F.avg(c * c)
    d = points.groupBy("frame").agg(F.sqrt(square(r)).alias("r"), F.sqrt(sum(square(F.col(t)) for t in terms)).alias("joint"), F.max(F.abs(r)).alias("worst"),
                                    F.abs(F.sum("s_bar")).alias("s"), F.abs(F.sum("pi")).alias("p"), F.count_if(~is_finite(F.col("pi"))).cast("double").alias("bad"))
    found = {"identity_residual": safe_ratio(F.col("r"), F.col("joint")), "identity_worst": F.col("worst"), "net_ratio": safe_ratio(F.col("s"), F.col("p")), "nonfinite": F.col("bad")}
    return d.select("frame", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in found.items()])).alias("m")).select("frame", "m.*")


def judge(measures: DataFrame, limits: dict[str, float]) -> DataFrame:
    """measures with limit and passed under given limits; a value that is null or not a number does not pass, a measure without a limit is left out.

    Only the measures are read, so stored ones are judged anew under other limits without a scan of points.
    """
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v))]), F.col("measure"))
    good = is_finite(F.col("value")) & (F.col("value") <= F.col("limit"))
    return measures.where(F.col("measure").isin(*limits)).withColumn("limit", limit).withColumn("passed", good)


def verdicts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed, and the names of the measures that failed, in order."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("measure"))))
    return judged.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), failed.alias("failed"))
