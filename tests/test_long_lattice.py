import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import long_lattice, spectral
from fieldspark.operators.long_lattice import Gain


def field(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, n, n))


def as_points(spark, **columns):
    n = len(next(iter(columns.values())))
    z, y, x = (c.ravel().tolist() for c in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    names = list(columns)
    return spark.createDataFrame(list(zip(x, y, z, *(columns[c].ravel().tolist() for c in names))), f"x int, y int, z int, {', '.join(f'{c} double' for c in names)}").repartition(3)


def cube(d, column, n):
    p = d.select("x", "y", "z", column).toPandas().sort_values(["z", "y", "x"])
    return p[column].to_numpy().reshape(n, n, n)


@pytest.mark.parametrize("n", [6, 7])
def test_operators_equal_whole_array_transforms(spark, n):
    f = field(n)
    wanted = {"same": Gain("v"), "dx": Gain("v", "x"), "dy": Gain("v", "y"), "dz": Gain("v", "z"), "soft": Gain("v", None, "gaussian", 1.3), "sharp": Gain("v", None, "smooth_sharp", 2.0), "soft_dz": Gain("v", "z", "gaussian", 0.7)}
    d = long_lattice.spectral_columns(as_points(spark, v=f), n, wanted).cache()
    k = np.fft.fftfreq(n, 1 / n)
    line = np.where(2 * np.abs(k) == n, 0, 1j * k)
    along = {"x": line[None, None, :], "y": line[None, :, None], "z": line[:, None, None]}
    spectrum = np.fft.fftn(f)
    gauss = lambda w: np.exp(-0.5 * (w * 2 * np.pi / n) ** 2 * (k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2))
    want = {"same": 1, **{f"d{a}": g for a, g in along.items()}, "soft": gauss(1.3), "sharp": spectral.smooth_sharp_weights(n, 2.0, 0.1171875), "soft_dz": gauss(0.7) * along["z"]}
    for name, gain in want.items():
        assert np.allclose(cube(d, name, n), np.fft.ifftn(spectrum * gain).real, atol=1e-10), name
    d.unpersist()


def test_derived_fields_equal_the_form_in_a_row(spark):
    n, sigmas = 6, [1.5, 2.5]
    u = {f"u{a}": field(n, k) for k, a in enumerate("xyz")}
    row = spark.createDataFrame([(0, *(u[f"u{a}"].ravel().tolist() for a in "xyz"))], "frame bigint, ux array<double>, uy array<double>, uz array<double>")
    names = ["work_full", "work_resolved", "pi", "s_bar", "divergence", "strain"]
    d = long_lattice.derived_fields(as_points(spark, **u), n, sigmas).cache()
    for s in sigmas:
        want = spectral.as_points(spectral.derived_fields(row, n, s), names).toPandas().sort_values("p")
        for c in names:
            assert np.allclose(cube(d.where(F.col("sigma") == s), c, n).ravel(), want[c], atol=1e-8), (s, c)
    d.unpersist()


def test_a_missing_point_is_an_error(spark):
    d = as_points(spark, v=field(4)).where("not (x = 1 and y = 2 and z = 3)")
    with pytest.raises(Exception, match="missing or repeated"):
        long_lattice.pressure_gradient(d, 4).count()


def test_three_regroupings_serve_all_operators(spark):
    wanted = {f"w{k}": Gain("v", None, "gaussian", float(k + 1)) for k in range(9)}
    d = long_lattice.spectral_columns(as_points(spark, v=field(4)), 4, wanted)
    plan = d._jdf.queryExecution().sparkPlan().toString() + d._jdf.queryExecution().executedPlan().toString()
    assert d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 3, plan


def test_a_longer_lattice(spark):
    n = 32
    x = np.arange(n) * 2 * math.pi / n
    f = np.sin(3 * x)[None, None, :] * np.cos(2 * x)[:, None, None] + 0 * x[None, :, None]
    points = spark.range(n ** 3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / (n * n)).cast("int").alias("z"))
    points = points.withColumn("v", F.sin(3 * F.col("x") * (2 * math.pi / n)) * F.cos(2 * F.col("z") * (2 * math.pi / n)))
    g = cube(long_lattice.pressure_gradient(points, n), "gx", n)
    assert np.allclose(g, 3 * np.cos(3 * x)[None, None, :] * np.cos(2 * x)[:, None, None] + 0 * f, atol=1e-10)


def test_sides_of_different_lengths(spark):
    shape, lengths = (16, 24, 32), {"z": 3.0, "y": 5.0, "x": 7.0}
    f = np.random.default_rng(2).normal(size=shape)
    z, y, x = (c.ravel().tolist() for c in np.indices(shape))
    points = spark.createDataFrame(list(zip(x, y, z, f.ravel().tolist())), "x int, y int, z int, v double").repartition(3)
    sizes = dict(zip("zyx", shape))
    wanted = {**{f"d{a}": Gain("v", a) for a in "xyz"}, "soft": Gain("v", None, "gaussian", 1.3)}
    p = long_lattice.spectral_columns(points, sizes, wanted, lengths, ["v"]).toPandas().sort_values(["z", "y", "x"])
    cube_of = lambda c: p[c].to_numpy().reshape(shape)
    waves = {a: np.fft.fftfreq(n, 1 / n).reshape([-1 if b == a else 1 for b in "zyx"]) for a, n in sizes.items()}
    spectrum = np.fft.fftn(f)
    assert np.array_equal(cube_of("v"), f)
    for a, k in waves.items():
        slope = np.where(2 * np.abs(k) == sizes[a], 0, 2j * np.pi / lengths[a] * k)
        assert np.allclose(cube_of(f"d{a}"), np.fft.ifftn(spectrum * slope).real), a
    soft = math.prod(np.exp(-0.5 * (1.3 * 2 * np.pi / sizes[a] * k) ** 2) for a, k in waves.items())
    assert np.allclose(cube_of("soft"), np.fft.ifftn(spectrum * soft).real)
    with pytest.raises(ValueError, match="cubic"):
        long_lattice.spectral_columns(points, sizes, {"s": Gain("v", None, "smooth_sharp", 2.0)})


def test_carried_columns_are_not_transformed(spark):
    n = {"x": 4, "y": 6, "z": 5}
    points = spark.range(120).selectExpr("cast(id % 4 as int) x", "cast(floor(id / 4) % 6 as int) y", "cast(floor(id / 24) as int) z", "sin(id) ux", "cos(id) uy", "sin(2 * id) uz")
    plan = long_lattice.derived_fields(points, n, [1.0, 2.0])._jdf.queryExecution().optimizedPlan().toString()
    # Transformed: 9 gradients and 12 columns a width, then 9 a width, then 3 fluxes a width.
    assert len(set(re.findall(r"\bre_(s\d_\w+|g\w\w)#", plan))) == 9 + 2 * (12 + 9 + 3 + 3)  # fluxes go in, their slopes come out
