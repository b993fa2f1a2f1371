"""Registered queries over the tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, ratio
from fieldspark.jobs.cubes import _DERIVE, SIGMA, N, _axis, _gauss, _list, derived_sql, velocity
from fieldspark.jobs.registry import ORACLES, QUERIES, _bag, _r, query
from fieldspark.operators import binning, events, lattices, regimes, spectral, stats
from fieldspark.sources import views

ALPHAS, BETAS = [0.5, 1.0, 1.5], [1.0, 1.5, 2.0]
TAIL_EDGES = [0.0, 0.25, 1.0, 2.25, 4.0, 6.25]
TAIL_REGIONS = ["lower", "center", "center", "center", "upper"]

__all__ = ["ORACLES", "QUERIES"]

# --- regimes and global statistics over the bag of points -------------------------------------

_LONG = "".join(f" UNION ALL SELECT regime, '{f}' AS field, {f} AS v FROM d" for f in ("pi", "s_bar", "work_full", "work_resolved", "delta_w"))[len(" UNION ALL"):]


@query(_bag(f"""
d AS (SELECT *, work_full - work_resolved AS delta_w, {regimes.REGIME_SQL} AS regime FROM bag),
l AS ({_LONG}), g AS (SELECT field, count(*) AS n, sum(v) AS s FROM l GROUP BY field),
dim AS (SELECT * FROM (VALUES ('1+'), ('1-'), ('2'), ('3'), ('4+'), ('4-')) r(regime), (SELECT DISTINCT field FROM l)),
k AS (SELECT regime, field, count(*) AS c, sum(v) AS s FROM l GROUP BY ALL)
SELECT regime, field, coalesce(c, 0)::BIGINT AS "count", {_r('coalesce(c, 0)::double / n')} AS volume_fraction, {_r('coalesce(k.s, 0)', 4)} AS "sum",
  {_r('coalesce(k.s, 0) / n')} AS mean_all, {_r('k.s / nullif(c, 0)')} AS mean_in_regime, {_r('g.s / n')} AS global_mean
FROM dim LEFT JOIN k USING (regime, field) JOIN g USING (field)"""))
def regime_contributions(spark, sf_dir):
    return regimes.contributions(views.bag_of_points(spark, sf_dir))


@query(_bag(f"""d AS (SELECT *, {regimes.REGIME_SQL} AS regime FROM bag), e AS (SELECT *, 'Q' || regime[1] AS quadrant FROM d)
SELECT coalesce(quadrant, 'all') AS quadrant, coalesce(regime, 'all') AS regime, count(*) AS "count", {_r('sum(pi)', 4)} AS pi_sum FROM e GROUP BY ROLLUP (quadrant, regime)"""))
def regime_legacy_rollup(spark, sf_dir):
    return regimes.legacy_rollup(views.bag_of_points(spark, sf_dir))


@query(_bag("""t AS (SELECT 1e-3 * sqrt(avg(work_full * work_full)) AS ef, 1e-3 * sqrt(avg(work_resolved * work_resolved)) AS er FROM bag),
d AS (SELECT work_full AS a, work_resolved AS b, work_full - work_resolved AS d, ef, er, greatest(ef, er) AS e FROM bag, t),
c AS (SELECT CASE WHEN a > ef AND b > er AND d > e THEN 1 WHEN a > ef AND b > er AND d < -e THEN 2 WHEN a > ef AND b < -er THEN 3
  WHEN a < -ef AND b > er THEN 4 WHEN a < -ef AND b < -er AND d > e THEN 5 WHEN a < -ef AND b < -er AND d < -e THEN 6 ELSE 0 END AS code FROM d)
SELECT r.i::INTEGER AS code, count(c.code) AS "count" FROM range(7) r(i) LEFT JOIN c ON c.code = r.i GROUP BY r.i"""))
def regime_codes_occupancy(spark, sf_dir):
    return regimes.occupancy(views.bag_of_points(spark, sf_dir))


@query(_bag(f"""d AS (SELECT *, {regimes.REGIME_SQL} AS regime FROM bag),
n AS (SELECT regime, count(*) AS n, count(*) FILTER (pi = 0) AS zero_count FROM d GROUP BY regime),
m AS (SELECT regime, dir AS direction, count(*) FILTER (pi * s > 0) AS c, coalesce(sum(abs(pi)) FILTER (pi * s > 0), 0) AS m FROM d, (VALUES ('forward', -1), ('backscatter', 1)) x(dir, s) GROUP BY ALL)
SELECT regime, direction, c AS "count", zero_count, {_r('m', 4)} AS magnitude_sum, {_r('m / nullif(c, 0)')} AS mean, {_r('c::double / n')} AS fraction, {_r('m / n')} AS intensity FROM m JOIN n USING (regime)"""))
def regime_direction_transfer(spark, sf_dir):
    return regimes.direction_transfer(views.bag_of_points(spark, sf_dir))


@query(_bag(f"""a AS (SELECT count(*) AS n, sum(pi) AS s, sum(abs(pi)) AS sa, sqrt(avg(pi * pi)) AS rms, quantile_cont(abs(pi), 0.99) AS p, max(abs(pi)) AS mx,
  sum(greatest(pi, 0)) AS ps, sum(least(pi, 0)) AS ns, count(*) FILTER (pi > 0) AS np, count(*) FILTER (pi < 0) AS nn, count(*) FILTER (pi = 0) AS nz FROM bag)
SELECT n AS "count", {_r('s', 4)} AS "sum", {_r('sa', 4)} AS abs_sum, {_r('rms')} AS rms, {_r('p')} AS p99_abs, {_r('mx')} AS max_abs, {_r('ps', 4)} AS positive_sum, {_r('ns', 4)} AS negative_sum,
  np AS positive_count, nn AS negative_count, nz AS zero_count, {_r('s / n / nullif(rms, 0)')} AS index, {_r('s / n / nullif(p, 0)')} AS ratio_p99, {_r('s / n / nullif(mx, 0)')} AS ratio_max FROM a"""))
def weak_asymmetry(spark, sf_dir):
    return stats.weak_asymmetry(views.bag_of_points(spark, sf_dir))


@query(_bag(f"""d AS (SELECT *, work_full - work_resolved + pi - s_bar AS r FROM bag),
a AS (SELECT frame, count(*) AS n, sqrt(avg(work_full * work_full)) AS f, sqrt(avg(work_resolved * work_resolved)) AS w, sqrt(avg(pi * pi)) AS p, sqrt(avg(s_bar * s_bar)) AS s,
  sqrt(avg(r * r)) AS r, max(abs(r)) AS rm, sum(s_bar) AS ss, sum(pi) AS sp, count(*) FILTER (NOT isfinite(pi)) AS bad FROM d GROUP BY frame)
SELECT frame::INTEGER AS frame, n AS "count", bad AS nonfinite, {_r('f')} AS work_full_rms, {_r('w')} AS work_resolved_rms, {_r('p')} AS pi_rms, {_r('s')} AS s_bar_rms,
  coalesce(r / nullif(sqrt(f * f + w * w + p * p + s * s), 0), 0) <= 1e-4 AS passed, rm < 1e-9 AS closes, {_r('abs(ss) / nullif(abs(sp), 0)', 4)} AS s_bar_over_pi FROM a"""))
def energy_identity_qa(spark, sf_dir):
    return stats.identity_qa(views.bag_of_points(spark, sf_dir))


@query(_bag(f"""x AS (SELECT 1) SELECT frame::INTEGER AS frame, {_r('min(q)')} AS q_min, {_r('max(q)')} AS q_max, {_r('avg(q)')} AS q_mean, {_r('sqrt(avg(q * q))')} AS q_rms, {_r('min(u2)')} AS u2_min, {_r('max(u2)')} AS u2_max,
  {_r('avg(u2)')} AS u2_mean, {_r('avg((q > 0)::double)')} AS fraction_q_positive FROM bag GROUP BY frame"""))
def frame_summary(spark, sf_dir):
    return stats.frame_summary(views.bag_of_points(spark, sf_dir))


# --- bins ------------------------------------------------------------------------------------

_COND = f"""b AS (SELECT frame, CASE WHEN u2 >= 0 AND u2 <= 5 THEN least(floor((u2 - 0e0) / 5e-1), 9)::INTEGER END AS bin, q FROM bag),
c AS (SELECT frame, bin, count(*) AS n, avg(q) AS m FROM b GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY frame) AS pr FROM c),
cond AS (SELECT frame::INTEGER AS frame, bin, {_r('bin * 5e-1')} AS bin_left, n AS "count", {_r('pr')} AS probability, n >= 20 AS valid, {_r('CASE WHEN n >= 20 THEN m END')} AS conditional_mean FROM p WHERE bin IS NOT NULL)"""


def _conditional(spark, sf_dir):
    return binning.conditional_mean(views.bag_of_points(spark, sf_dir), "u2", "q", 0.0, 5.0, 10, 20)


@query(_bag(f"{_COND} SELECT * FROM cond"))
def conditional_mean_uniform(spark, sf_dir):
    return _conditional(spark, sf_dir)


@query(_bag(f"""{_COND}, v AS (SELECT bin, CASE WHEN valid THEN conditional_mean END AS m FROM cond)
SELECT bin, count(m) AS valid_frames, {_r('avg(m)', 4)} AS mean, {_r('stddev_samp(m)', 4)} AS std FROM v GROUP BY bin"""))
def ensemble_conditional(spark, sf_dir):
    return binning.ensemble(_conditional(spark, sf_dir))


@query(_bag(f"""b AS (SELECT CASE WHEN u2 < 0 OR u2 > 6.25e0 THEN NULL WHEN u2 < 2.5e-1 THEN 0 WHEN u2 < 1 THEN 1 WHEN u2 < 2.25e0 THEN 2 WHEN u2 < 4 THEN 3 ELSE 4 END AS bin, q FROM bag),
c AS (SELECT bin, count(*) AS n, avg(q) AS m, quantile_cont(q, [0.025, 0.25, 0.75, 0.975]) AS p FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT bin::INTEGER AS bin, ['lower','center','center','center','upper'][bin + 1] AS region, n AS "count", {_r('n / sum(n) OVER ()')} AS volume_fraction, {_r('m')} AS conditional_mean, n >= 100 AS reliable,
  {_r('p[1]')} AS p025, {_r('p[2]')} AS p25, {_r('p[3]')} AS p75, {_r('p[4]')} AS p975 FROM c"""))
def conditional_tails(spark, sf_dir):
    return binning.conditional_tails(views.bag_of_points(spark, sf_dir), "u2", "q", TAIL_EDGES, TAIL_REGIONS)


_HIST = f"""b AS (SELECT CASE WHEN pi >= -6 AND pi <= 6 THEN least(floor((pi + 6) / 5e-1), 23)::INTEGER END AS bin, pi FROM bag),
c AS (SELECT bin, count(*) AS n, sum(pi) AS s, sum(abs(pi)) AS a FROM b WHERE bin IS NOT NULL GROUP BY bin),
f AS (SELECT r.i::INTEGER AS bin, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(a, 0) AS a FROM range(24) r(i) LEFT JOIN c ON c.bin = r.i),
hist AS (SELECT bin, {_r('-6 + bin * 5e-1')} AS bin_left, n::BIGINT AS "count", {_r('s', 4)} AS signed_sum, {_r('a', 4)} AS abs_sum, {_r('n / (sum(n) OVER () * 5e-1)')} AS density,
  {_r('sum(n) OVER (ORDER BY bin) / sum(n) OVER ()')} AS cdf, {_r('sum(n) OVER (ORDER BY bin DESC) / sum(n) OVER ()')} AS ccdf, {_r('sum(a) OVER (ORDER BY bin DESC) / sum(a) OVER ()')} AS tail_contribution FROM f)"""


def _histogram(spark, sf_dir):
    return binning.histogram(views.bag_of_points(spark, sf_dir), "pi", -6.0, 6.0, 24)


@query(_bag(f"{_HIST} SELECT * FROM hist"))
def pi_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(_bag(f"""{_HIST}, g AS (SELECT bin, bin_left, tail_contribution AS t, lag(tail_contribution) OVER (ORDER BY bin) AS a, lead(tail_contribution) OVER (ORDER BY bin) AS b FROM hist)
SELECT bin, bin_left, {_r('CASE WHEN a IS NULL THEN (b - t) / 5e-1 WHEN b IS NULL THEN (t - a) / 5e-1 ELSE (b - a) / 1e0 END', 4)} AS gradient FROM g"""))
def tail_descent_rate(spark, sf_dir):
    d = binning.gradient(_histogram(spark, sf_dir), "bin_left", "tail_contribution")
    return d.select("bin", "bin_left", clean(F.col("gradient"), 4).alias("gradient"))


@query(_bag(f"""{_HIST}, k AS (SELECT bin, "count" AS n, sum("count") OVER (ORDER BY bin) AS c, sum("count") OVER () AS t FROM hist WHERE "count" > 0),
h AS (SELECT share, min(bin) AS bin FROM k, (VALUES (0.25::double), (0.75::double)) x(share) WHERE c >= share * t GROUP BY share)
SELECT share, {_r('-6 + (k.bin + (share * t - (c - n)) / n) * 5e-1')} AS quantile FROM h JOIN k USING (bin)"""))
def histogram_quartiles(spark, sf_dir):
    h = _histogram(spark, sf_dir)
    return binning.histogram_quantile(h, -6.0, 0.5, 0.25).unionByName(binning.histogram_quantile(h, -6.0, 0.5, 0.75))


@query(_bag(f"""d AS (SELECT CASE WHEN pi < 0 THEN 'forward' ELSE 'backscatter' END AS branch, abs(pi) AS w, log10(abs(pi) / 3e0) AS y FROM bag WHERE pi <> 0),
s AS (SELECT branch, count(*) AS n, sum(w) AS w, sum(w*y) / sum(w) AS a, sum(w*y*y) / sum(w) AS b, sum(w*y*y*y) / sum(w) AS c, sum(w*y*y*y*y) / sum(w) AS d FROM d GROUP BY branch),
v AS (SELECT *, b - a*a AS v FROM s)
SELECT branch, n AS "count", {_r('w', 4)} AS weight, {_r('a')} AS mu_log10, {_r('sqrt(v)')} AS sigma_log10, {_r('(c - 3*a*b + 2*a*a*a) / (v * sqrt(v))', 4)} AS skewness,
  {_r('(d - 4*a*c + 6*a*a*b - 3*a*a*a*a) / (v*v) - 3', 4)} AS excess_kurtosis FROM v"""))
def log_contribution_moments(spark, sf_dir):
    return binning.log_moments(views.bag_of_points(spark, sf_dir), "pi", 3.0)


_DENSITY = f"""b AS (SELECT CASE WHEN work_full >= -25 AND work_full <= 25 THEN least(floor((work_full + 25) / 5), 9)::INTEGER END AS bx, CASE WHEN pi >= -6 AND pi <= 6 THEN least(floor((pi + 6) / 1.2e0), 9)::INTEGER END AS "by" FROM bag),
c AS (SELECT bx, "by", count(*) AS n FROM b WHERE bx IS NOT NULL AND "by" IS NOT NULL GROUP BY ALL), dens AS (SELECT bx, "by", n AS "count", {_r('n / sum(n) OVER () / 6', 8)} AS density FROM c)"""


def _density(spark, sf_dir):
    return binning.density_2d(views.bag_of_points(spark, sf_dir), "work_full", "pi", (-25.0, 25.0, -6.0, 6.0), 10)


@query(_bag(f"{_DENSITY} SELECT * FROM dens"))
def density_2d(spark, sf_dir):
    return _density(spark, sf_dir)


@query(_bag(f"{_DENSITY} SELECT * FROM dens WHERE density >= (SELECT quantile_cont(density, 0.95) FROM dens)"))
def density_top5(spark, sf_dir):
    return binning.top_density(_density(spark, sf_dir))


@query(_bag("""b AS (SELECT least(floor((work_full + 25) / 1e1), 4)::INTEGER AS bx, least(floor((work_resolved + 6) / 2.4e0), 4)::INTEGER AS "by", least(floor((pi + 6) / 2.4e0), 4)::INTEGER AS bz FROM bag
  WHERE work_full BETWEEN -25 AND 25 AND work_resolved BETWEEN -6 AND 6 AND pi BETWEEN -6 AND 6) SELECT bx, "by", bz, count(*) AS "count" FROM b GROUP BY ALL"""))
def density_3d(spark, sf_dir):
    return binning.density_3d(views.bag_of_points(spark, sf_dir), ("work_full", "work_resolved", "pi"), [(-25.0, 25.0), (-6.0, 6.0), (-6.0, 6.0)], 5)


# --- events ----------------------------------------------------------------------------------

_SCALED = "s AS (SELECT b.*, q / nullif(qr, 0) AS qn, u2 / nullif(um, 0) AS un, qr, um FROM bag b JOIN (SELECT frame, sqrt(avg(q*q)) AS qr, avg(u2) AS um FROM bag GROUP BY frame) USING (frame))"
_STEPS = ", ".join([f"('q', {a}::double)" for a in ALPHAS] + [f"('u2', {b}::double)" for b in BETAS])


@query(_bag(f"""{_SCALED} SELECT frame::INTEGER AS frame, kind, threshold, count(*) FILTER (CASE WHEN kind = 'q' THEN q > threshold * qr ELSE u2 > threshold * um END) AS "count",
  {_r("avg((CASE WHEN kind = 'q' THEN q > threshold * qr ELSE u2 > threshold * um END)::double)")} AS fraction FROM s, (VALUES {_STEPS}) t(kind, threshold) GROUP BY ALL"""))
def threshold_counts(spark, sf_dir):
    return events.threshold_counts(views.bag_of_points(spark, sf_dir), ALPHAS, BETAS)


_A, _B = ", ".join(f"({a}::double)" for a in ALPHAS), ", ".join(f"({b}::double)" for b in BETAS)


@query(_bag(f"""{_SCALED}, g AS (SELECT frame, alpha, beta, count(*) FILTER (qn > alpha) AS a, count(*) FILTER (un > beta) AS b, count(*) FILTER (qn > alpha AND un > beta) AS i, count(*) AS n
  FROM s, (VALUES {_A}) x(alpha), (VALUES {_B}) y(beta) GROUP BY ALL)
SELECT frame::INTEGER AS frame, alpha, beta, a AS a_count, b AS b_count, i AS intersection_count, {_r('i / nullif(b, 0)::double')} AS p_a_given_b, {_r('i / nullif(a, 0)::double')} AS p_b_given_a,
  {_r('n::double * i / nullif(a * b, 0)')} AS lift FROM g WHERE a > 0 AND b > 0"""))
def event_overlap(spark, sf_dir):
    return events.overlap(views.bag_of_points(spark, sf_dir), ALPHAS, BETAS)


@query(_bag(f"""{_SCALED} SELECT frame::INTEGER AS frame, alpha, beta, count(*) AS "count", {_r('sum(u2)', 3)} AS u2, {_r('sum(greatest(q, 0))', 3)} AS q_positive, {_r('sum(q*q)', 3)} AS q_squared
  FROM s, (VALUES (NULL::double), {_A}) x(alpha), (VALUES (NULL::double), {_B}) y(beta) WHERE (alpha IS NULL OR qn > alpha) AND (beta IS NULL OR un > beta) GROUP BY ALL"""))
def nested_contributions(spark, sf_dir):
    d = events.nested_regions(views.bag_of_points(spark, sf_dir), ALPHAS, BETAS)
    return d.select("frame", "alpha", "beta", "count", *[clean(F.col(c), 3).alias(c) for c in ("u2", "q_positive", "q_squared")])


_ANGLES = f"WITH {views.VECTORS_SQL}, a AS (SELECT *, sqrt(u2) * sqrt(gx*gx + gy*gy + gz*gz) AS nm FROM vectors), t AS (SELECT *, 180 - degrees(acos(greatest(-1, least(1, -q / nm)))) AS th FROM a WHERE nm <> 0)"


@query(f"""{_ANGLES}, g AS (SELECT frame, count(*) AS n, avg(th) AS m, avg(cos(radians(th))) AS c, quantile_cont(th, [0.05, 0.5, 0.95]) AS p, corr(th, q) AS r FROM t GROUP BY frame)
SELECT frame, n AS "count", {_r('m')} AS mean_angle, {_r('c')} AS mean_cos, {_r('p[1]')} AS p05, {_r('p[2]')} AS p50, {_r('p[3]')} AS p95, {_r('r')} AS corr_q FROM g""")
def angle_summary(spark, sf_dir):
    return events.angle_summary(views.vectors(spark, sf_dir))


@query(f"""{_ANGLES} SELECT least(floor(th / 5e0), 35)::INTEGER AS bin, q > 0 AS q_positive, count(*) AS "count", {_r('avg(q)')} AS mean_q FROM t GROUP BY ALL""")
def angle_histogram(spark, sf_dir):
    return events.angle_histogram(views.vectors(spark, sf_dir))


@query(f"""WITH {views.VECTORS_SQL}, s AS (SELECT v.*, q / nullif(qr, 0) AS qn, sqrt(u2) AS sp, sqrt(gx*gx + gy*gy + gz*gz) AS sz FROM vectors v JOIN (SELECT frame, sqrt(avg(q*q)) AS qr FROM vectors GROUP BY frame) USING (frame)),
c AS (SELECT *, abs(q / nullif(sp * sz, 0)) AS cs FROM s), p AS (SELECT c.*, population FROM c, (VALUES ('all', NULL::double), ('q<1.0', 1e0), ('q<0.5', 5e-1), ('q<0.1', 1e-1)) x(population, lim) WHERE lim IS NULL OR abs(qn) < lim)
SELECT population, count(*) AS "count", {_r('avg((sp < 2e-1)::double)')} AS slow, {_r('avg((sz < 2e-1)::double)')} AS flat, {_r('avg((cs < 1e-1)::double)')} AS normal, {_r('avg(sp)')} AS mean_speed, {_r('avg(cs)')} AS mean_abs_cos,
  count(*) FILTER (q = 0) AS exact_zero FROM p GROUP BY population""")
def near_zero_populations(spark, sf_dir):
    return events.near_zero(views.vectors(spark, sf_dir))


@query(f"""WITH {views.VECTORS_SQL} SELECT frame, count(*) AS "count", {_r('sqrt(avg(q*q))')} AS q_rms, {_r('avg(u2)')} AS u2_mean, {_r('avg(q)')} AS q_mean FROM vectors GROUP BY frame""")
def pressure_power(spark, sf_dir):
    q, u2 = F.col("q"), F.col("u2")
    return views.vectors(spark, sf_dir).groupBy("frame").agg(F.count(F.lit(1)).alias("count"), clean(F.sqrt(F.avg(q * q))).alias("q_rms"), clean(F.avg(u2)).alias("u2_mean"), clean(F.avg(q)).alias("q_mean"))


# --- dense lattices --------------------------------------------------------------------------

_LAT = f"WITH {views.LATTICE_SQL}, size AS (SELECT max(z) + 1 AS nz FROM lattice)"


def _lattice(spark, sf_dir):
    d = views.lattice(spark, sf_dir)
    return d, lattices.extent(d)


@query(f"""{_LAT}, b AS (SELECT z // (nz // 5) AS bz, y // 2 AS "by", x // 2 AS bx, v FROM lattice, size),
m AS (SELECT bz*25 + "by"*5 + bx AS block_id, bx, "by", bz, count(*) AS n, sum(v) AS s, avg(v) AS m, sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0)) AS d, min(v) AS lo, max(v) AS hi FROM b GROUP BY ALL)
SELECT block_id::INTEGER AS block_id, bx::INTEGER AS bx, "by"::INTEGER AS "by", bz::INTEGER AS bz, n AS point_count, {_r('s', 3)} AS "sum", {_r('m', 7)} AS mean, {_r('d', 3)} AS std, lo AS "min", hi AS "max", row_number() OVER (ORDER BY m, block_id) AS rank FROM m""")
def block_moments(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.block_moments(d, n, 5)


@query(f"""{_LAT}, b AS (SELECT (z // (nz // 5))*25 + (y // 2)*5 + x // 2 AS block_id, v FROM lattice, size),
s AS (SELECT block_id, sum(greatest(v - 250000, 0)) AS a, sum(greatest(250000 - v, 0)) AS b FROM b GROUP BY block_id)
SELECT block_id::INTEGER AS block_id, {_r('a', 3)} AS above, {_r('b', 3)} AS below, {_r('(a - b) / nullif(a + b, 0)')} AS asymmetry FROM s""")
def block_pair_asymmetry(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.pair_asymmetry(d, n, 5, 250000.0)


@query(f"""{_LAT} SELECT 'xy' AS plane, x, y, z, v FROM lattice, size WHERE z = nz // 2 UNION ALL SELECT 'xz', x, y, z, v FROM lattice WHERE y = 5 UNION ALL SELECT 'yz', x, y, z, v FROM lattice WHERE x = 5""")
def orthogonal_planes(spark, sf_dir):
    return lattices.planes(*_lattice(spark, sf_dir))


@query(f"{_LAT} SELECT (x // 2)::INTEGER AS x, (y // 2)::INTEGER AS y, (z // 2)::INTEGER AS z, v FROM lattice WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def stride2_sample(spark, sf_dir):
    return lattices.sampled(views.lattice(spark, sf_dir))


@query(f"""{_LAT}, d AS (SELECT 'x' AS axis, max(v) FILTER (x = 0) AS a, max(v) FILTER (x = 1) AS b, max(v) FILTER (x = 9) AS c FROM lattice GROUP BY y, z
  UNION ALL SELECT 'y', max(v) FILTER (y = 0), max(v) FILTER (y = 1), max(v) FILTER (y = 9) FROM lattice GROUP BY x, z
  UNION ALL SELECT 'z', max(v) FILTER (z = 0), max(v) FILTER (z = 1), max(v) FILTER (z = nz - 1) FROM lattice, size GROUP BY x, y)
SELECT axis, {_r('sqrt(avg((a - c) * (a - c)))', 3)} AS seam_rms, {_r('sqrt(avg((b - a) * (b - a)))', 3)} AS inner_rms FROM d GROUP BY axis""")
def seam_statistics(spark, sf_dir):
    return lattices.seams(*_lattice(spark, sf_dir))


@query(f"""{_LAT}, t AS (SELECT x, y, (z - k + nz) % nz AS z, w * v AS w FROM lattice, size, (VALUES (-2, 1e0), (-1, -8e0), (1, 8e0), (2, -1e0)) s(k, w))
SELECT x, y, z::INTEGER AS z, {_r('sum(w)', 3)} AS dz FROM t GROUP BY ALL""")
def fd4_gradient(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.fd4(d, "z", n["z"], 1 / 12).withColumn("dz", clean(F.col("dz"), 3))


@query(f"""{_LAT}, w AS (SELECT *, lag(v) OVER l AS b1, lag(v, 2) OVER l AS b2, lead(v) OVER l AS a1, lead(v, 2) OVER l AS a2 FROM lattice WINDOW l AS (PARTITION BY y, z ORDER BY x))
SELECT x, y, z, {_r('CASE WHEN b1 IS NULL THEN -15e-1 * v + 2 * a1 - 5e-1 * a2 WHEN a1 IS NULL THEN 15e-1 * v - 2 * b1 + 5e-1 * b2 ELSE (a1 - b1) / 2 END', 3)} AS dx FROM w""")
def fd2_gradient_open(spark, sf_dir):
    return lattices.fd2_open(views.lattice(spark, sf_dir), "x", 1.0).withColumn("dx", clean(F.col("dx"), 3))


@query(f"""{_LAT}, c AS (SELECT x, y, z FROM lattice WHERE v > 400000), f AS (SELECT side, x + dx AS x, y + dy AS y, z + dz AS z FROM c,
  (VALUES ('+x',1,0,0), ('-x',-1,0,0), ('+y',0,1,0), ('-y',0,-1,0), ('+z',0,0,1), ('-z',0,0,-1)) s(side, dx, dy, dz))
SELECT side, count(*) AS faces FROM f ANTI JOIN c USING (x, y, z) GROUP BY side""")
def voxel_exposed_faces(spark, sf_dir):
    return lattices.exposed_faces(views.lattice(spark, sf_dir), 400000.0)


@query(f"""{_LAT} SELECT CASE WHEN v > 400000 AND z % 2 = 0 AND v > 300000 THEN 'both' WHEN v > 400000 THEN 'a_only' WHEN z % 2 = 0 AND v > 300000 THEN 'b_only' ELSE 'neither' END AS region, count(*) AS "count" FROM lattice GROUP BY region""")
def overlay_regions(spark, sf_dir):
    return lattices.overlays(views.lattice(spark, sf_dir), 400000.0, 300000.0)


@query(f"""{_LAT}, p AS (SELECT z0, y0, x0, least(4, nz - z0) * least(4, 10 - y0) * least(4, 10 - x0) AS n FROM size, (SELECT unnest(range(0, nz, 4)) AS z0 FROM size), (SELECT unnest(range(0, 10, 4)) AS y0), (SELECT unnest(range(0, 10, 4)) AS x0)),
h AS (SELECT (z // 4) * 4 AS z0, (y // 4) * 4 AS y0, (x // 4) * 4 AS x0, count(*) AS f, min(v) AS lo, max(v) AS hi, sum(v) AS s FROM lattice GROUP BY ALL)
SELECT printf('x%04d_y%04d_z%04d', x0, y0, z0) AS tile_key, n::BIGINT AS expected_points, coalesce(f, 0) AS found, CASE WHEN f = n THEN 'verified' WHEN f IS NULL THEN 'missing' ELSE 'partial' END AS status, lo, hi, {_r('s', 3)} AS "sum" FROM p LEFT JOIN h USING (z0, y0, x0)""")
def tile_status(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.tile_status(d, n, 4)


@query(f"""{_LAT}, t AS (SELECT DISTINCT z // 4 AS tile FROM lattice) SELECT DISTINCT tile::INTEGER AS tile, (((r.i + nz) % nz) // 4)::INTEGER AS needs FROM t, size, range(-2, 1000000) r(i) WHERE r.i >= tile * 4 - 2 AND r.i <= least((tile + 1) * 4, nz) + 1""")
def halo_dependencies(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.halo_dependencies(d, n, 4)


# --- spectral operators and derived fields on the cubes of embeddings -------------------------

_CUBES = f"WITH {views.CUBES_SQL}"
_PLACE = "(z * 16 + y * 4 + x)::INTEGER AS p"


@query(f"{_CUBES}, {_axis('d', 'cells', 'x', _DERIVE, {'w': 'v'})} SELECT frame, {_PLACE}, {_r('w')} AS v FROM d")
def spectral_derivative(spark, sf_dir):
    d = views.cubes(spark, sf_dir).select("frame", spectral.apply_axis(F.col("cube"), N, "x", _DERIVE).alias("v"))
    return spectral.as_points(d, ["v"]).withColumn("v", clean(F.col("v")))


@query(f"{_CUBES}, {_gauss('g', 'cells', {'v': 'v'})} SELECT frame, {_PLACE}, {_r('v')} AS v FROM g")
def gaussian_filter(spark, sf_dir):
    d = views.cubes(spark, sf_dir).select("frame", spectral.apply_gaussian(F.col("cube"), N, SIGMA).alias("v"))
    return spectral.as_points(d, ["v"]).withColumn("v", clean(F.col("v")))


_SHARP = spectral.smooth_sharp_kernel(N, SIGMA, 0.1171875)


@query(f"""{_CUBES} SELECT s.frame, t.i::INTEGER AS p, {_r(f"sum({_list(_SHARP)}[((t.i // 16 - s.z + 4) % 4) * 16 + (((t.i // 4) % 4 - s.y + 4) % 4) * 4 + ((t.i % 4 - s.x + 4) % 4) + 1] * s.v)")} AS v
FROM cells s, range(64) t(i) GROUP BY s.frame, t.i""")
def smooth_sharp_filter(spark, sf_dir):
    d = views.cubes(spark, sf_dir).select("frame", spectral.apply_full(F.col("cube"), N, _SHARP).alias("v"))
    return spectral.as_points(d, ["v"]).withColumn("v", clean(F.col("v")))


_FIELDS = ("work_full", "work_resolved", "pi", "s_bar", "divergence", "strain")


@query(f"{derived_sql()} SELECT frame, p::INTEGER AS p, {', '.join(f'{_r(c)} AS {c}' for c in _FIELDS)} FROM fields")
def derived_fields(spark, sf_dir):
    d = spectral.as_points(spectral.derived_fields(velocity(spark, sf_dir), N, SIGMA), list(_FIELDS))
    return d.select("frame", "p", *[clean(F.col(c)).alias(c) for c in _FIELDS])


@query(f"""{derived_sql()} SELECT frame, {_r('-avg(pi)')} AS forward_mean_pi, {_r('185e-6 * 2 * avg(strain)', 8)} AS epsilon, {_r('-avg(pi) / nullif(185e-6 * 2 * avg(strain), 0)', 3)} AS pi_over_epsilon,
  {_r('sqrt(avg(divergence * divergence))')} AS divergence_rms, {_r('avg((pi < 0)::double)')} AS forward_fraction FROM fields GROUP BY frame""")
def flux_ladder(spark, sf_dir):
    d = spectral.as_points(spectral.derived_fields(velocity(spark, sf_dir), N, SIGMA), list(_FIELDS)).groupBy("frame")
    e = 185e-6 * 2 * F.avg("strain")
    return d.agg(clean(-F.avg("pi")).alias("forward_mean_pi"), clean(e, 8).alias("epsilon"), clean(ratio(-F.avg("pi"), e), 3).alias("pi_over_epsilon"),
                 clean(F.sqrt(F.avg(F.col("divergence") ** 2))).alias("divergence_rms"), clean(F.avg((F.col("pi") < 0).cast("double"))).alias("forward_fraction"))


from fieldspark.jobs import conditional, gates, geometry, grids  # noqa: E402, F401  (they register their own queries)
