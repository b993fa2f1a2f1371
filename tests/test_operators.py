import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import binning, events, lattices, regimes, spectral, stats


def plain_regime(a, b):
    if (a >= 0) != (b >= 0):
        return "2" if a >= 0 else "3"
    return ("1" if a >= 0 else "4") + ("+" if a - b >= 0 else "-")


def test_every_point_of_a_grid_of_works_has_its_regime(spark):
    steps = [k / 4 for k in range(-7, 8)]
    rows = [(a, b, plain_regime(a, b)) for a in steps for b in steps]
    d = spark.createDataFrame(rows, "work_full double, work_resolved double, want string")
    assert d.where(regimes.sign_regime() != F.col("want")).count() == 0
    assert {r["want"]: r["count"] for r in d.groupBy("want").count().collect()} == {"1+": 36, "1-": 28, "2": 56, "3": 56, "4+": 28, "4-": 21}


def test_threshold_codes_leave_what_is_on_a_threshold_uncertain(spark):
    full, resolved = 0.75, 0.5

    def plain(a, b):
        small = max(full, resolved)
        if abs(a) <= full or abs(b) <= resolved:
            return 0
        if (a > 0) != (b > 0):
            return 3 if a > 0 else 4
        if abs(a - b) <= small:
            return 0
        return {(True, True): 1, (True, False): 2, (False, True): 5, (False, False): 6}[a > 0, a - b > 0]

    steps = [k / 4 for k in range(-9, 10)]
    d = spark.createDataFrame([(a, b, plain(a, b)) for a in steps for b in steps], "work_full double, work_resolved double, want int")
    assert d.where(regimes.threshold_code(F.lit(full), F.lit(resolved)) != F.col("want")).count() == 0
    assert {r[0] for r in d.select("want").distinct().collect()} == set(range(7))


def test_exact_percentile(spark):
    values = np.random.default_rng(905).gamma(1.7, size=4211).tolist() + [1.25] * 2500 + [-3.0]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.3, 0.5, 0.99, 1.0):
        assert stats.exact_percentile(d, "v", share) == pytest.approx(np.percentile(values, 100 * share), abs=1e-12)
    assert stats.exact_percentile(d.where("v > 99"), "v", 0.5) is None


def test_exact_percentiles_by_group(spark):
    draw, shares = np.random.default_rng(7), [0.95, 0.025, 0.5, 0.0, 1.0]
    groups = {0: draw.normal(size=3001), 1: np.append(draw.normal(size=40), [0.5] * 900), None: np.array([2.0]), 3: np.exp(40 * draw.normal(size=500)), 4: np.array([-np.inf, 1.0, 2.0, 3.0, 4.0, 5.0, np.inf])}
    d = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(0, None), (9, None)], "g int, v double").repartition(3)
    got = {r["g"]: r["p"] for r in stats.exact_percentiles(d, "g", "v", shares, 16).collect()}
    assert got.keys() == groups.keys()
    for g in (0, 1, None, 3):
        assert got[g] == pytest.approx(np.percentile(groups[g], [100 * s for s in shares]).tolist(), rel=1e-12)
    assert got[4][2:] == [3.0, -np.inf, np.inf]
    assert stats.exact_percentiles(d.where("v is null"), "g", "v", shares).count() == 0


@pytest.mark.parametrize("way", [{"DRIVER_ROWS": -1}, {"DRIVER_ROWS": -1, "BRACKET_ROWS": 0}, {"NEAR": 0.0}])
def test_percentiles_by_every_way(spark, monkeypatch, way):
    for name, value in way.items():
        monkeypatch.setattr(stats, name, value)
    draw, shares = np.random.default_rng(12), [0.1, 0.5, 0.505, 0.999]
    values = {g: {"a": draw.normal(size=n), "b": draw.integers(0, 9, n).astype(float)} for g, n in ((1, 7000), (2, 3), (None, 900))}
    rows = [(g, float(a), float(b) if k % 5 else None) for g, x in values.items() for k, (a, b) in enumerate(zip(x["a"], x["b"]))]
    d = spark.createDataFrame([*rows, (7, None, None)], "g int, a double, b double").repartition(3)
    got = {(r["g"], r["column"]): r["p"] for r in stats.exact_percentiles_of(d, "g", ["a", "b"], shares, 16).collect()}
    kept = {(g, c): [x for k, x in enumerate(v) if c == "a" or k % 5] for g, cols in values.items() for c, v in cols.items()}
    assert got.keys() == kept.keys()
    for key, x in kept.items():
        assert got[key] == pytest.approx(np.percentile(x, [100 * s for s in shares]).tolist(), rel=1e-12), key


def test_percentiles_scan_their_source_twice(spark):
    met = spark.sparkContext.accumulator(0)

    def count(it):
        for batch in it:
            met.add(batch.num_rows)
            yield batch

    d = spark.range(30_000).selectExpr("cast(id % 3 as int) g", "sin(id) v").mapInArrow(count, "g int, v double")
    assert stats.exact_percentiles(d, "g", "v", [0.025, 0.25, 0.5, 0.75, 0.975]).count() == 3
    assert met.value == 60_000


def test_no_task_gathers_the_values_of_a_bin(spark):
    d = spark.range(200).selectExpr("0 as frame", "cast(id as double) q", "1.0d u2", "cast(id + 1 as double) ux", "0.0d uy", "0.0d uz", "-1.0d gx", "cast(id as double) gy", "0.0d gz")
    for got in (binning.conditional_tails(d, "u2", "q", [0.0, 2.0], ["all"]), events.angle_summary(d)):
        assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bins_are_half_open_but_for_the_last(spark):
    edges = [-4.5, -0.5, 2.0, 3.0, 7.5]
    values = [k / 2 for k in range(-12, 18)]
    d = spark.createDataFrame([(x,) for x in values], "x double")
    counts, _ = np.histogram(values, edges)
    got = [r[0] for r in d.select(binning.edge_bin(F.col("x"), edges)).collect()]
    assert [got.count(k) for k in range(4)] == counts.tolist() and got.count(None) == len(values) - counts.sum()
    even, _ = np.histogram(values, 5, (-3.0, 7.0))
    got = [r[0] for r in d.select(binning.uniform_bin(F.col("x"), -3.0, 7.0, 5)).collect()]
    assert [got.count(k) for k in range(5)] == even.tolist()


def test_histogram_quantile_interpolates(spark):
    counts = [3, 0, 9, 4, 0, 8]
    h = spark.createDataFrame(list(enumerate(counts)), "bin int, count bigint")
    upto = np.cumsum(counts)
    for share in (0.1, 0.4, 0.5, 0.9):
        want = 2.0 + 0.5 * np.interp(share * 24, [0, 3, 3.0000001, 12, 16, 16.0000001, 24], [0, 1, 2, 3, 4, 5, 6])
        assert binning.histogram_quantile(h, 2.0, 0.5, share).first()["quantile"] == pytest.approx(want, abs=1e-6) and upto[-1] == 24


def test_gradient_matches_numpy(spark):
    x = [-2.0, -1.25, 0.5, 0.75, 2.0, 5.0]
    y = [math.exp(v / 3) for v in x]
    d = binning.gradient(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").orderBy("x").toPandas()
    assert np.allclose(d["gradient"], np.gradient(y, x))


def test_angle_of_zero_vector_is_null(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "ux double, uy double, uz double, gx double, gy double, gz double")
    d = d.withColumn("q", -(F.col("ux") * F.col("gx"))).withColumn("u2", F.col("ux") ** 2)
    assert [r["theta"] for r in events.with_angles(d).collect()] == [None, 0.0]


def _line(spark, f, n):
    return spark.range(n * 2 * 2).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % 2).cast("int").alias("y"), F.floor(F.col("id") / (2 * n)).cast("int").alias("z")).withColumn("v", f(F.col("x") * (2 * math.pi / n)))


def test_fourth_order_convergence(spark):
    errors = []
    for n in (16, 32):
        d = lattices.fd4(_line(spark, F.sin, n), "x", n, 2 * math.pi / n).toPandas()
        errors.append(np.abs(d.dx - np.cos(d.x * 2 * math.pi / n)).max())
    assert 14 < errors[0] / errors[1] < 18


def test_spectral_forms_agree(spark):
    n = 8
    long = _line(spark, lambda t: F.sin(3 * t) + F.cos(t), n)
    d = spectral.line_operator(long, "x", n, "derivative", 2 * math.pi).toPandas()
    assert np.allclose(d.v, 3 * np.cos(3 * d.x * 2 * math.pi / n) - np.sin(d.x * 2 * math.pi / n), atol=1e-12)
    kernel = spectral.derivative_kernel(n, 2 * math.pi)
    f = np.sin(3 * np.arange(n) * 2 * math.pi / n)
    assert np.allclose([sum(kernel[(i - j) % n] * f[j] for j in range(n)) for i in range(n)], 3 * np.cos(3 * np.arange(n) * 2 * math.pi / n))
    for odd in (5, 7):
        g = np.cos(2 * np.arange(odd) * 2 * math.pi / odd)
        k = spectral.derivative_kernel(odd, 2 * math.pi)
        assert np.allclose([sum(k[(i - j) % odd] * g[j] for j in range(odd)) for i in range(odd)], -2 * np.sin(2 * np.arange(odd) * 2 * math.pi / odd))
    gauss = spectral.line_operator(long, "x", n, "gaussian", 1.5).toPandas().query("y == 0 and z == 0").sort_values("x").v.to_numpy()
    own = spectral.gaussian_kernel(n, 1.5)
    v = np.sin(3 * np.arange(n) * 2 * math.pi / n) + np.cos(np.arange(n) * 2 * math.pi / n)
    assert np.allclose(gauss, [sum(own[(i - j) % n] * v[j] for j in range(n)) for i in range(n)])


def test_smooth_sharp_gain():
    gain = spectral.smooth_sharp_weights(16, 2.0, 0.1171875)
    assert gain[0, 0, 0] == 1 and gain[0, 0, 4] == pytest.approx(0.5)


@pytest.mark.parametrize("kind", ["gaussian", "smooth_sharp"])
def test_energy_identity_of_derived_fields(spark, kind):
    """work_full = work_resolved - pi + s_bar for a solenoidal field."""
    n = 8
    z, y, x = np.meshgrid(*[np.arange(n) * 2 * math.pi / n] * 3, indexing="ij")
    modes = [((1, 1, 0), (1, -1, 1), 0.3), ((0, 1, -1), (2, 1, 1), 0.9), ((1, 0, 1), (1, 2, -1), 0.55)]
    u = [sum(0.5 * a[i] * np.cos(k[0] * x + k[1] * y + k[2] * z + p) for k, a, p in modes).ravel().tolist() for i in range(3)]
    d = spark.createDataFrame([(0, *u)], "frame bigint, ux array<double>, uy array<double>, uz array<double>")
    f = spectral.as_points(spectral.derived_fields(d, n, 1.5, filter_kind=kind), ["work_full", "work_resolved", "pi", "s_bar", "divergence"]).toPandas()
    assert np.abs(f.divergence).max() < 1e-12
    assert np.abs(f.work_full - (f.work_resolved - f.pi + f.s_bar)).max() < 1e-10


def test_a_line_with_a_gap_has_no_derivative(spark):
    d = _line(spark, F.sin, 16)
    with pytest.raises(Exception, match="missing or repeated"):
        lattices.fd4(d.where("x <> 3 or y <> 1"), "x", 16, 1.0).collect()


def test_blocks_must_divide(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0)], "x int, y int, z int, v double")
    with pytest.raises(ValueError):
        lattices.blocks(d, {"x": 10, "y": 10, "z": 7}, 5)


def test_regime_pairs_by_block(spark):
    draw, n = np.random.default_rng(3), 4
    z, y, x = (c.ravel() for c in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    pi, regime = draw.normal(size=n ** 3), draw.integers(0, 7, n ** 3)
    d = spark.createDataFrame(list(zip(*(c.tolist() for c in (x, y, z, pi, regime)))), "x int, y int, z int, pi double, regime int")
    rows = [(b, b % 2, b // 2 % 2, b // 4, float(b)) for b in range(8)]
    strain = lambda r: spark.createDataFrame(r, "block_id int, block_x int, block_y int, block_z int, sij_sij_mean double")
    sizes = {"x": n, "y": n, "z": n}
    got = {r["block_id"]: r for r in lattices.regime_pair_asymmetry(d, strain(rows), sizes, 2).collect()}
    assert len(got) == 8
    for b in range(8):
        own = (z // 2 * 4 + y // 2 * 2 + x // 2) == b
        covered = 0
        for pair, ends in {"1_4": ((1, 2), (5, 6)), "2_3": ((3,), (4,))}.items():
            v = [pi[own & np.isin(regime, codes)] for codes in ends]
            (lb, lf), (rb, rf) = ((e[e > 0].sum(), -e[e < 0].sum()) for e in v)
            covered += sum(map(len, v))
            for name, a, w in (("backscatter", lb - rb, lb + rb), ("forward", lf - rf, lf + rf), ("total", lb - lf - rb + rf, lb + lf + rb + rf)):
                assert got[b][f"a_{pair}_{name}"] == (pytest.approx(a / w, abs=1e-6) if w else None)
        assert (got[b]["classified_count"], got[b]["uncertain_count"], got[b]["sij_sij_mean"]) == (covered, 8 - covered, b)
    for bad in (rows[1:], [*rows[1:], rows[1]], [(0, 1, 0, 0, 0.0), *rows[1:]]):
        with pytest.raises(ValueError):
            lattices.regime_pair_asymmetry(d, strain(bad), sizes, 2)


def test_tiles_in_request(spark):
    sizes = {"x": 10, "y": 4, "z": 6}
    plans = [lattices.tile_plan(spark.range(1), sizes, k) for k in (4, 3)]
    requests, tiles = ([r.asDict() for r in p.collect()] for p in plans)
    want = {(r["tile_key"], t["tile_key"]) for r in requests for t in tiles if all(r[f"{a}0"] <= t[f"{a}0"] and t[f"{a}0"] + t[f"n{a}"] <= r[f"{a}0"] + r[f"n{a}"] for a in "xyz")}
    assert want and {tuple(r) for r in lattices.tiles_in_request(*plans).collect()} == want


def test_empty_tables(spark):
    bag = spark.createDataFrame([], "work_full double, work_resolved double, pi double, s_bar double, q double, u2 double, frame int")
    assert regimes.contributions(bag).count() == 30
    assert stats.weak_asymmetry(bag).first()["count"] == 0
    assert binning.histogram(bag, "pi", -1.0, 1.0, 4).agg(F.sum("count")).first()[0] == 0
