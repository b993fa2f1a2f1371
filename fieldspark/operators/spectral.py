"""Periodic spectral operators (X1-X7), derived fields (D1-D7) and the flux ladder (P4, P16, P19, X13).

Small cubes sit whole in a row: an operator is a circulant kernel applied inside the row, so
a table of cubes needs no shuffle and parallels over frames.  Large lattices are gathered
into lines along one axis (one shuffle for each axis), and an FFT runs over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def derivative_kernel(n: int, length: float) -> list[float]:
    """K[m] with out_i = sum_j K[(i - j) mod n] f_j."""
    scale = 2 * math.pi / length
    if n % 2:
        return [0.0] + [scale * 0.5 * (-1) ** m / math.sin(math.pi * m / n) for m in range(1, n)]
    return [0.0] + [scale * 0.5 * (-1) ** m / math.tan(math.pi * m / n) if 2 * m != n else 0.0 for m in range(1, n)]


def gaussian_kernel(n: int, sigma: float) -> list[float]:
    """sigma in grid steps."""
    weight = lambda k: (1 if k == 0 or 2 * k == n else 2) * math.exp(-0.5 * (sigma * 2 * math.pi * k / n) ** 2)
    return [sum(weight(k) * math.cos(2 * math.pi * k * m / n) for k in range(n // 2 + 1)) / n for m in range(n)]


def smooth_sharp_weights(n: int, sigma: float, alpha: float) -> np.ndarray:
    """Gain at each mode of an n-cube: 1 at zero, one half at the cutoff pi / sigma."""
    k = np.fft.fftfreq(n, 1 / n) * 2 * np.pi / n
    size = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    cut = math.pi / sigma
    gain = np.vectorize(lambda s: 0.5 * math.erfc((s - cut) / (math.sqrt(2) * alpha * cut)))(size)
    gain[0, 0, 0] = 1.0
    return gain


def smooth_sharp_kernel(n: int, sigma: float, alpha: float) -> list[float]:
    """The filter as a kernel over (dz, dy, dx), z-major."""
    return np.fft.ifftn(smooth_sharp_weights(n, sigma, alpha)).real.ravel().tolist()


def _bound(cube: Column, use) -> Column:
    """use(cube) with the cube worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(cube), use), 1)


def apply_axis(cube: Column, n: int, axis: str, kernel: list[float]) -> Column:
    """A circulant kernel along one axis of a z-major cube."""
    stride = {"x": 1, "y": n, "z": n * n}[axis]
    k = F.array(*[F.lit(float(x)) for x in kernel])

    def whole(c):
        def cell(p):
            i = F.floor(p / stride).cast("int") % n
            return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda acc, j: acc + F.get(k, F.pmod(i - j, F.lit(n))) * F.get(c, p + (j - i) * stride))

        return F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), cell)

    return _bound(cube, whole)


def apply_gaussian(cube: Column, n: int, sigma: float) -> Column:
    kernel = gaussian_kernel(n, sigma)
    for axis in AXES:
        cube = apply_axis(cube, n, axis, kernel)
    return cube


def apply_full(cube: Column, n: int, kernel: list[float]) -> Column:
    """A circulant kernel over all three axes of a z-major cube."""
    k = F.array(*[F.lit(float(x)) for x in kernel])
    part = lambda p, stride: F.floor(p / stride).cast("int") % n

    def whole(c):
        return F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), lambda p: cell(c, p))

    def cell(c, p):
        at = lambda q: F.pmod(part(p, n * n) - part(q, n * n), F.lit(n)) * n * n + F.pmod(part(p, n) - part(q, n), F.lit(n)) * n + F.pmod(part(p, 1) - part(q, 1), F.lit(n))
        return F.aggregate(F.sequence(F.lit(0), F.lit(n**3 - 1)), F.lit(0.0), lambda acc, q: acc + F.get(k, at(q)) * F.get(c, q))

    return _bound(cube, whole)


def line_operator(points: DataFrame, axis: str, size: int, kind: str, parameter: float, value: str = "v") -> DataFrame:
    """An FFT operator along whole lines of a long lattice: kind derivative (parameter: length) or gaussian (sigma).

    One shuffle gathers each line of `size` points; a missing point counts as an error.
    """
    others = [a for a in AXES if a != axis]
    lines = points.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, value))), lambda s: s[value].cast("double")).alias("line"))

    @F.pandas_udf("array<double>")
    def operate(values):
        import pandas as pd

        data = np.array(values.tolist(), float).reshape(len(values), size)
        spectrum, k = np.fft.rfft(data, axis=1), np.arange(size // 2 + 1)
        if kind == "derivative":
            gain = 1j * k * 2 * np.pi / parameter
            if size % 2 == 0:
                gain[-1] = 0
        else:
            gain = np.exp(-0.5 * (parameter * 2 * np.pi * k / size) ** 2)
        return pd.Series(list(np.fft.irfft(spectrum * gain, size, axis=1)))

    return lines.select(*others, F.posexplode(operate("line")).alias(axis, value))


def derived_fields(velocity: DataFrame, n: int, sigma: float, length: float = 2 * math.pi, filter_kind: str = "gaussian", alpha: float = 0.1171875) -> DataFrame:
    """frame, ux, uy, uz (z-major cubes in a row) -> work_full, work_resolved, pi, s_bar, divergence and strain, cube by cube.

    Fields follow one another as columns of arrays, so everything stays in the row.
    """
    derive = derivative_kernel(n, length)
    sharp = smooth_sharp_kernel(n, sigma, alpha) if filter_kind == "smooth_sharp" else None
    smooth = (lambda c: apply_full(c, n, sharp)) if sharp else (lambda c: apply_gaussian(c, n, sigma))
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)

    def total(columns):
        out = columns[0]
        for c in columns[1:]:
            out = plus(out, c)
        return out

    c = F.col
    pairs = [(i, j) for i in AXES for j in AXES]
    upper = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    both = lambda i, j: "".join(sorted(i + j))
    d = velocity.select("frame", *[c(f"u{i}") for i in AXES])
    d = d.select("*", *[apply_axis(c(f"u{i}"), n, j, derive).alias(f"g{i}{j}") for i, j in pairs], *[smooth(c(f"u{i}")).alias(f"b{i}") for i in AXES])
    d = d.select("*", *[total([times(c(f"u{j}"), c(f"g{i}{j}")) for j in AXES]).alias(f"a{i}") for i in AXES],
                 *[times(c(f"u{i}"), c(f"u{j}")).alias(f"p{i}{j}") for i, j in upper], *[apply_axis(c(f"b{i}"), n, j, derive).alias(f"h{i}{j}") for i, j in pairs])
    d = d.select("*", *[smooth(c(f"a{i}")).alias(f"ga{i}") for i in AXES], *[minus(smooth(c(f"p{i}{j}")), times(c(f"b{i}"), c(f"b{j}"))).alias(f"t{i}{j}") for i, j in upper])
    d = d.select("*", *[total([times(c(f"b{i}"), c(f"t{both(i, j)}")) for i in AXES]).alias(f"f{j}") for j in AXES])
    strain = total([times(s, s) for s in [F.zip_with(c(f"g{i}{j}"), c(f"g{j}{i}"), lambda x, y: (x + y) / 2) for i, j in pairs]])
    return d.select(
        "frame", total([times(c(f"b{i}"), c(f"ga{i}")) for i in AXES]).alias("work_full"),
        total([times(times(c(f"b{i}"), c(f"b{j}")), c(f"h{i}{j}")) for i, j in pairs]).alias("work_resolved"),
        total([times(c(f"t{both(i, j)}"), c(f"h{i}{j}")) for i, j in pairs]).alias("pi"),
        total([apply_axis(c(f"f{j}"), n, j, derive) for j in AXES]).alias("s_bar"),
        total([c(f"g{i}{i}") for i in AXES]).alias("divergence"), strain.alias("strain"))


def as_points(cubes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell: frame, p (z-major place) and the columns."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return cubes.select("frame", F.posexplode(zipped).alias("p", "c")).select("frame", "p", *[F.col("c")[c].alias(c) for c in columns])
