"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("pi", "s_bar", "work_full", "work_resolved", "delta_w")


def ratio(a, b) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where both are zero, null where only b is."""
    return F.when(b != 0, a / b).when(a == 0, F.lit(0.0))


def normalized_difference(left: Column, right: Column) -> Column:
    return ratio(left - right, left + right)


def clean(column: Column, digits: int = 6) -> Column:
    """Rounded and without a negative zero, so engines that sum in another order agree."""
    return F.round(column, digits) + F.lit(0.0)


def angle_degrees(dot: Column, norm: Column) -> Column:
    """acos of the clipped cosine in degrees, null where a vector vanishes."""
    cosine = ratio(dot, norm)
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def symlog(value: Column, threshold: float) -> Column:
    return F.signum(value) * F.log1p(F.abs(value) / threshold)


def sigma_tag(sigma: Column) -> Column:
    return F.replace(F.replace(sigma.cast("string"), F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))
