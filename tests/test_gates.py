import math

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import scalar
from fieldspark.operators import gates, grids, tails

BAG = "work_full double, work_resolved double, pi double, s_bar double, q double, u2 double, frame int"


def bag(spark, pis):
    return spark.createDataFrame([(p * 2, p - 0.5, p, p / 3, p, p * p, k % 2) for k, p in enumerate(pis)], BAG)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), None])
def test_values_that_are_not_finite_are_errors(spark, bad):
    rows = [(1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0), (1.0, 1.0, bad, 1.0, 1.0, 1.0, 0)]
    with pytest.raises(Exception, match="pi is not finite"):
        gates.closures(spark.createDataFrame(rows, BAG)).collect()


def test_closures_hold_and_failures_are_named(spark):
    checks = gates.closures(bag(spark, [k / 7 - 3 for k in range(50)]))
    assert checks.count() == 9 and checks.where("passed").count() == 9
    gates.enforce(checks)
    with pytest.raises(ValueError, match="regimes_of_pi"):
        gates.enforce(checks.withColumn("passed", F.col("check") != "regimes_of_pi"))
    assert gates.closures(bag(spark, [])).where("not passed").count() == 0


def test_divergence_limits(spark):
    d = spark.createDataFrame([(0, 1e-6, 1.0), (0, -1e-6, 1.0), (1, 0.01, 1.0), (2, 0.0, 0.0)], "frame int, divergence double, strain double")
    assert {r["frame"]: (r["rms_passed"], r["max_passed"]) for r in gates.divergence_gate(d).collect()} == {0: (True, True), 1: (False, False), 2: (True, True)}


def test_preflight_finds_gaps_repeats_and_strays(spark):
    whole = [(x, y, 0, 1.0) for x in range(2) for y in range(2)]
    table = lambda rows: spark.createDataFrame(rows, "x int, y int, z int, v double")
    found = lambda rows: {r["check"]: r["found"] for r in gates.preflight(table(rows), {"x": 2, "y": 2, "z": 1}).collect()}
    assert found(whole) == {"covered": 4, "repeated": 0, "nonfinite": 0, "outside": 0}
    assert found([*whole[:3], whole[0], (9, 0, 0, None)]) == {"covered": 3, "repeated": 1, "nonfinite": 1, "outside": 1}


def test_places_must_agree(spark):
    left, right = spark.range(5).selectExpr("id", "id * 2 as a"), spark.range(5).selectExpr("id", "id * 3 as b")
    assert gates.joined_by_place(left, right, ["id"]).where("b * 2 = a * 3").count() == 5
    for wrong in (right.where("id > 0"), right.unionByName(right.limit(1))):
        with pytest.raises(Exception, match="same places"):
            gates.joined_by_place(left, wrong, ["id"]).collect()


def test_a_centre_without_width_is_an_error(spark):
    d = bag(spark, [1.0] * 50)
    with pytest.raises(ValueError):
        tails.tail_plan(d, "q")


def test_a_tail_without_width_is_an_error_unless_asked_for(spark):
    d = bag(spark, [0.0] * 50 + [1.0, 2.0, 3.0] * 20)
    with pytest.raises(ValueError, match="tail"):
        tails.tail_plan(d, "q")
    assert tails.tail_plan(d, "q", flat_tails=True).count() == 2  # frames


def test_every_point_is_in_one_bin_between_its_edges(spark):
    d = bag(spark, [math.sin(k) * 3 + math.cos(k * k) for k in range(3000)])
    plan = tails.tail_plan(d, "q")
    got = d.join(plan, "frame").withColumn("bin", tails.tail_bin(F.col("q"))).join(tails.bin_edges(plan), ["frame", "bin"])
    assert got.count() == 3000 and got.where("q < bin_left - 1e-9 or q > bin_right + 1e-9").count() == 0


def test_sampled_indices_and_limits():
    assert grids.sampled_indices(10, 4, [5]) == [0, 4, 5, 8, 9]
    with pytest.raises(ValueError):
        grids.sampled_indices(10, 4, [10])
    for lo, hi in ((-0.93, 4.1), (12.0, 12.0), (1e-7, 3e-6), (0.0, 1000.0)):
        a, b, step = grids.nice_limits(lo, hi)
        assert a <= lo and b >= hi and round(step / 10 ** math.floor(math.log10(step) + 1e-9)) in (1, 2, 5)
    with pytest.raises(ValueError):
        grids.nice_limits(float("nan"), 1.0)


def test_normal_distribution(spark):
    d = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "x double")
    got = d.select("x", grids.normal_cdf(F.col("x"), F.lit(0.5), F.lit(1.5)).alias("c"), grids.normal_pdf(F.col("x"), F.lit(0.5), F.lit(1.5)).alias("p")).collect()
    for r in got:
        z = (r["x"] - 0.5) / 1.5
        assert r["c"] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-7) and r["p"] == pytest.approx(math.exp(-z * z / 2) / 1.5 / math.sqrt(2 * math.pi))


def test_scalar_helpers(spark):
    d = spark.createDataFrame([(-3.0,), (0.0,), (0.5,), (12.25,)], "s double")
    got = d.select(scalar.symlog(F.col("s"), 0.5).alias("l"), scalar.sigma_tag(F.col("s")).alias("t")).collect()
    assert [r["l"] for r in got] == pytest.approx([math.copysign(math.log1p(abs(s) / 0.5), s) if s else 0.0 for s in (-3.0, 0.0, 0.5, 12.25)])
    assert [r["t"] for r in got] == ["m3p0", "0p0", "0p5", "12p25"]
    r = spark.range(1).select(scalar.safe_ratio(F.lit(0.0), F.lit(0.0)).alias("a"), scalar.safe_ratio(F.lit(2.0), F.lit(0.0)).alias("b"), grids.physical_time(F.lit(5), 0.25).alias("t")).first()
    assert (r["a"], r["b"], r["t"]) == (0.0, None, 1.0)


def test_stored_measures_are_judged_without_their_points(spark, tmp_path):
    d = bag(spark, [1.0, -2.0, 4.0, 0.5])
    path = str(tmp_path / "measures")
    gates.frame_measures(d).write.parquet(path)
    kept = spark.read.parquet(path)
    value = {(r["frame"], r["measure"]): r["value"] for r in kept.collect()}
    r = [p * 2 - (p - 0.5) + p - p / 3 for p in (1.0, 4.0)]
    joint = math.sqrt(sum(x * x for p in (1.0, 4.0) for x in (p * 2, p - 0.5, p, p / 3)) / 2)
    assert value[0, "identity_residual"] == pytest.approx(math.sqrt(sum(x * x for x in r) / 2) / joint)
    assert value[0, "identity_worst"] == pytest.approx(max(r)) and value[0, "net_ratio"] == pytest.approx(1 / 3)
    strict, loose = (gates.judge(kept, {"net_ratio": x, "identity_worst": 100.0}) for x in (0.1, 0.5))
    assert {tuple(r) for r in gates.verdicts(strict, ["frame"]).select("frame", "passed").collect()} == {(0, False), (1, False)}
    assert gates.verdicts(strict, ["frame"]).first()["failed"] == ["net_ratio"]
    assert gates.verdicts(loose, ["frame"]).where("passed").count() == 2
    assert path in "".join(strict.inputFiles()) and strict.count() == 4


def test_a_measure_that_is_no_number_does_not_pass(spark):
    d = spark.createDataFrame([(0, "a", None), (0, "b", float("nan")), (0, "c", 1.0), (0, "d", 9.0)], "frame int, measure string, value double")
    got = {r["measure"]: r["passed"] for r in gates.judge(d, {"a": 2.0, "b": 2.0, "c": 2.0}).collect()}
    assert got == {"a": False, "b": False, "c": True}


@pytest.mark.parametrize(("lo", "hi", "want"), [(0.2, 0.9, (-0.2, 1.0)), (-3.0, -1.0, (-3.5, 0.5)), (0.0, 0.0, (-0.2, 0.2)), (-7.0, 13.0, (-10.0, 15.0))])
def test_padded_limits_hold_zero_and_lie_beyond_the_range(lo, hi, want):
    assert grids.padded_limits(lo, hi) == pytest.approx(want)
    a, b = grids.padded_limits(lo, hi, padding=0.0)
    assert a < min(lo, 0.0) and b > max(hi, 0.0)
    with pytest.raises(ValueError):
        grids.padded_limits(hi + 1, lo)


def test_cutoffs_of_both_kernels(spark):
    means = spark.createDataFrame([(1, 0.5, 0.25)], "frame int, forward_mean_pi double, epsilon double")
    width, grid, length = 4.0, 64, 2 * math.pi
    for kernel, reach in (("gaussian", math.sqrt(2 * math.log(2))), ("smooth_sharp", math.pi)):
        r = grids.flux_points(means, [width], [("other", 20.0, 0.5)], grid, length, 1e-3, kernel).where("series = 'frame_1'").first()
        cutoff = reach / (width * length / grid)
        eta = (1e-9 / 0.25) ** 0.25
        assert r["cutoff"] == pytest.approx(cutoff, abs=1e-4) and r["modes"] == pytest.approx(cutoff, abs=1e-4)
        assert r["r_over_eta"] == pytest.approx(math.sqrt(2 * math.log(2)) / cutoff / eta, abs=1e-3) and r["pi_over_epsilon"] == 2.0
