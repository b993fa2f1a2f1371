"""Queries on planes, blocks, histograms by rms, normality, flux points and display scales, each with its SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, symlog
from fieldspark.jobs.cubes import SIGMA, N, derived_sql, velocity
from fieldspark.jobs.registry import _bag, _r, query
from fieldspark.operators import binning, gates, grids, lattices, regimes, spectral
from fieldspark.sources import views

TWO_PI = f"{2 * math.pi!r}"
_LAT = f"WITH {views.LATTICE_SQL}, size AS (SELECT max(z) + 1 AS nz FROM lattice)"


def _lattice(spark, sf_dir):
    d = views.lattice(spark, sf_dir)
    return d, lattices.extent(d)


_PLANE = lambda name, on, kept: f"SELECT '{name}' AS plane, x, y, z, v FROM lattice, size WHERE {on} AND {' AND '.join(kept)}"
_KEPT = {"x": "x IN (0, 3, 5, 6, 9)", "y": "y IN (0, 3, 5, 6, 9)", "z": "(z % 3 = 0 OR z = nz - 1 OR z = nz // 2)"}
_STEPPED = f"""planes AS ({' UNION ALL '.join([_PLANE('xy', 'z = nz // 2', [_KEPT['x'], _KEPT['y']]), _PLANE('xz', 'y = 5', [_KEPT['x'], _KEPT['z']]), _PLANE('yz', 'x = 5', [_KEPT['y'], _KEPT['z']])])})"""


@query(f"""{_LAT}, {_STEPPED} SELECT plane, x, y, z, {_r(f'x * {TWO_PI} / 10')} AS px, {_r(f'y * {TWO_PI} / 10')} AS py, {_r(f'z * {TWO_PI} / nz')} AS pz, v FROM planes, size""")
def stepped_planes(spark, sf_dir):
    return grids.stepped_planes(*_lattice(spark, sf_dir), 3)


@query(f"""{_LAT}, {_STEPPED}, k AS (SELECT plane, quantile_cont(abs(v), 0.99) AS p, max(abs(v)) AS m FROM planes GROUP BY plane) SELECT plane, {_r('CASE WHEN p > 0 THEN p WHEN m > 0 THEN m ELSE 1 END')} AS "limit" FROM k""")
def plane_limits(spark, sf_dir):
    return grids.plane_limits(grids.stepped_planes(*_lattice(spark, sf_dir), 3))


@query(f"""{_LAT}, s AS (SELECT x, y, z, 0.25 * (SELECT any_value(v) FROM lattice b WHERE b.x = a.x AND b.y = a.y AND b.z = (a.z - 1 + nz) % nz) + 0.5 * v + 0.25 * (SELECT any_value(v) FROM lattice b WHERE b.x = a.x AND b.y = a.y AND b.z = (a.z + 1) % nz) AS f, v
FROM lattice a, size WHERE z = nz // 2 AND x % 2 = 0 AND y % 2 = 0) SELECT x, y, z, v AS raw, {_r('f', 5)} AS filtered FROM s""")
def comparison_slices(spark, sf_dir):
    return grids.comparison_slices(*_lattice(spark, sf_dir))


@query(f"""{_LAT}, t AS (SELECT (z // 4 * 3 + y // 4) * 3 + x // 4 AS chunk, v FROM lattice) SELECT chunk::BIGINT AS chunk, count(*) AS "count", min(v) AS "min", max(v) AS "max" FROM t WHERE chunk < 8 GROUP BY chunk""")
def first_chunks(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return grids.first_chunks(d, n, 4, 8).groupBy("chunk").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("min"), F.max("v").alias("max"))


_TILES = lambda name, n: f"{name} AS (SELECT printf('x%04d_y%04d_z%04d', x0, y0, z0) AS k, x0, y0, z0, least({n}, 10 - x0) AS nx, least({n}, 10 - y0) AS ny, least({n}, nz - z0) AS sz FROM size, (SELECT unnest(range(0, nz, {n})) AS z0 FROM size), (SELECT unnest(range(0, 10, {n})) AS y0), (SELECT unnest(range(0, 10, {n})) AS x0))"


@query(f"""{_LAT}, {_TILES('r', 5)}, {_TILES('t', 2)} SELECT r.k AS request_key, t.k AS tile_key FROM t JOIN r ON t.x0 >= r.x0 AND t.y0 >= r.y0 AND t.z0 >= r.z0 AND t.x0 + t.nx <= r.x0 + r.nx AND t.y0 + t.ny <= r.y0 + r.ny AND t.z0 + t.sz <= r.z0 + r.sz""")
def tiles_in_request(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.tiles_in_request(lattices.tile_plan(d, n, 5), lattices.tile_plan(d, n, 2))


@query(f"""{_LAT}, {_TILES('p', 4)}, h AS (SELECT (z // 4) * 4 AS z0, (y // 4) * 4 AS y0, (x // 4) * 4 AS x0, count(*) AS f FROM lattice GROUP BY ALL)
SELECT CASE WHEN f = nx * ny * sz THEN 'verified' WHEN f IS NULL THEN 'missing' ELSE 'partial' END AS status, count(*) AS tiles, sum(nx * ny * sz)::BIGINT AS points FROM p LEFT JOIN h USING (z0, y0, x0) GROUP BY status""")
def tile_progress(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return lattices.tile_status(d, n, 4).groupBy("status").agg(F.count(F.lit(1)).alias("tiles"), F.sum("expected_points").alias("points"))


@query(f"""{_LAT}, b AS (SELECT z // (nz // 5) AS bz, y // 2 AS "by", x // 2 AS bx, v, pow((v - 250000) / 1e5, 2) AS s FROM lattice, size), m AS (SELECT bx, "by", bz, count(*) AS n, avg(v) AS m, sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0)) AS d, avg(s) AS q FROM b GROUP BY ALL), w AS (SELECT avg(v) AS m0, avg(s) AS q0 FROM b)
SELECT (bz*25 + "by"*5 + bx)::INTEGER AS block_id, bx::INTEGER AS bx, "by"::INTEGER AS "by", bz::INTEGER AS bz, {_r(f'bx * 2 * {TWO_PI} / 10')} AS x_begin, {_r(f'"by" * 2 * {TWO_PI} / 10')} AS y_begin, {_r(f'bz * (nz // 5) * {TWO_PI} / nz')} AS z_begin,
  n AS point_count, {_r('m')} AS mean, {_r('d', 4)} AS std, {_r('q')} AS sij_sij_mean, {_r('m / m0')} AS mean_ratio, {_r('q / q0')} AS square_ratio FROM m, w, size""")
def block_table(spark, sf_dir):
    d, n = _lattice(spark, sf_dir)
    return grids.block_table(d.withColumn("s", F.pow((F.col("v") - 250000) / 1e5, F.lit(2.0))), n, 5, "s", 2 * math.pi).withColumn("block_id", F.col("block_id").cast("int"))


def _work_points(d):
    """Lattice points with pi and a regime code from their values and places."""
    pi = (F.col("v") - 250000) / 1e5
    full, resolved = pi * (F.col("x") - 4.5), pi * (F.col("y") - 4.5) / 2
    return d.select("x", "y", "z", pi.alias("pi"), full.alias("work_full"), resolved.alias("work_resolved")).withColumn("regime", regimes.threshold_code(F.lit(0.1), F.lit(0.05)))


_CODE = """CASE WHEN a > 0.1 AND b > 0.05 AND a - b > 0.1 THEN 1 WHEN a > 0.1 AND b > 0.05 AND a - b < -0.1 THEN 2 WHEN a > 0.1 AND b < -0.05 THEN 3 WHEN a < -0.1 AND b > 0.05 THEN 4
  WHEN a < -0.1 AND b < -0.05 AND a - b > 0.1 THEN 5 WHEN a < -0.1 AND b < -0.05 AND a - b < -0.1 THEN 6 ELSE 0 END"""


def _pair_sql(pair: str, left: str, right: str) -> str:
    side = lambda codes, sign: f"sum(greatest({sign}pi, 0)) FILTER (code IN ({codes}))"
    lb, lf, rb, rf = (f"coalesce({side(c, s)}, 0)" for c in (left, right) for s in ("", "-"))
    return f"""count(*) FILTER (code IN ({left})) AS pair_{pair}_left_count, count(*) FILTER (code IN ({right})) AS pair_{pair}_right_count, {_r(f'({lb} - {rb}) / nullif({lb} + {rb}, 0)')} AS a_{pair}_backscatter,
  {_r(f'({lf} - {rf}) / nullif({lf} + {rf}, 0)')} AS a_{pair}_forward, {_r(f'(({lb} - {lf}) - ({rb} - {rf})) / nullif({lb} + {lf} + {rb} + {rf}, 0)')} AS a_{pair}_total"""


@query(f"""{_LAT}, p AS (SELECT z // (nz // 5) AS bz, y // 2 AS "by", x // 2 AS bx, (v - 250000) / 1e5 AS pi, (v - 250000) / 1e5 * (x - 4.5::double) AS a, (v - 250000) / 1e5 * (y - 4.5::double) / 2 AS b FROM lattice, size), c AS (SELECT *, {_CODE} AS code FROM p)
SELECT (bz*25 + "by"*5 + bx)::INTEGER AS block_id, bx::INTEGER AS block_x, "by"::INTEGER AS block_y, bz::INTEGER AS block_z, count(*) AS point_count, {_r('avg(pi * pi)')} AS sij_sij_mean, {_pair_sql('1_4', '1, 2', '5, 6')}, {_pair_sql('2_3', '3', '4')},
  count(*) FILTER (code <> 0) AS classified_count, count(*) FILTER (code = 0) AS uncertain_count FROM c GROUP BY bx, "by", bz""")
def regime_pair_blocks(spark, sf_dir):
    """Pair asymmetries by block, joined with a block table of squares that is checked against the blocks first."""
    d, n = _lattice(spark, sf_dir)
    points = _work_points(d)
    strain = lattices.blocks(points, n, 5).groupBy(F.col("block_id").cast("int").alias("block_id"), F.col("bx").alias("block_x"), F.col("by").alias("block_y"), F.col("bz").alias("block_z")).agg(clean(F.avg(F.col("pi") ** 2)).alias("sij_sij_mean"))
    return lattices.regime_pair_asymmetry(points, strain, n, 5).withColumn("block_id", F.col("block_id").cast("int"))


@query(_bag(f"""r AS (SELECT sqrt(avg(pi * pi)) AS rms, count(*) AS total FROM bag), d AS (SELECT pi, total, round(pi / rms, 9) AS x FROM bag, r),
k AS (SELECT 'central' AS kind, (CASE WHEN x < -3 THEN -1 WHEN x > 3 THEN 24 ELSE least(floor((x + 3) / 0.25), 23) END)::INTEGER AS bin, pi, total FROM d
  UNION ALL SELECT 'tail', (CASE WHEN abs(x) < 1 THEN 0 ELSE least(1 + floor((abs(x) - 1) / 0.25), 12) END)::INTEGER, pi, total FROM d),
g AS (SELECT kind, bin, count(*) AS n, sum(pi) AS s, sum(abs(pi)) AS a, any_value(total) AS total FROM k GROUP BY kind, bin)
SELECT kind, bin, {_r("CASE WHEN kind = 'central' THEN CASE WHEN bin BETWEEN 0 AND 23 THEN -3 + bin * 0.25::double END WHEN bin = 0 THEN 0 WHEN bin < 12 THEN 1 + (bin - 1) * 0.25::double END")} AS bin_left, n AS "count", {_r('s', 4)} AS signed_sum, {_r('a', 4)} AS abs_sum,
  {_r("CASE WHEN kind = 'central' THEN CASE WHEN bin BETWEEN 0 AND 23 THEN n / total::double / 0.25::double END WHEN bin = 0 THEN n / total::double WHEN bin < 12 THEN n / total::double / 0.25::double END")} AS density FROM g"""))
def normalized_histograms(spark, sf_dir):
    return grids.normalized_histograms(views.bag_of_points(spark, sf_dir), "pi")


@query(_bag(f"""r AS (SELECT frame, sqrt(avg(pi * pi)) AS rms FROM bag GROUP BY frame) SELECT frame::INTEGER AS frame, count(*) AS "count", {_r('avg((pi < 0)::INTEGER)')} AS forward, {_r('avg((pi > 0)::INTEGER)')} AS backscatter,
  {_r('avg((abs(pi) > rms)::INTEGER)')} AS beyond_rms, {_r('avg((abs(pi) > 2 * rms)::INTEGER)')} AS beyond_2_rms, {_r('avg(pi) / max(rms)')} AS mean_over_rms FROM bag JOIN r USING (frame) GROUP BY frame"""))
def pdf_summary(spark, sf_dir):
    return grids.pdf_summary(views.bag_of_points(spark, sf_dir), "pi")


def _cdf_sql(x: str) -> str:
    z = f"(({x} - mu) / sd / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {grids.ERF_P!r} * abs{z}))"
    series = "0"
    for a in reversed(grids.ERF_A):
        series = f"(({series} + {a!r}::double) * {t})"
    return f"((1 + sign{z} * (1 - {series} * exp(-{z} * {z}))) / 2)"


_W = 0.15
_DET = "(k * (z2 * z4 - z3 * z3) - z1 * (z1 * z4 - z2 * z3) + z2 * (z1 * z3 - z2 * z2))"
_TOP = "(k * (z2 * l2 - z3 * l1) - z1 * (z1 * l2 - z3 * l0) + z2 * (z1 * l1 - z2 * l0))"


@query(_bag(f"""d AS (SELECT CASE WHEN pi < 0 THEN 'forward' ELSE 'backscatter' END AS branch, abs(pi) AS w, log10(abs(pi) / 3e0) AS y FROM bag WHERE pi <> 0),
mm AS (SELECT branch, {', '.join(f'sum(w * pow(y, {k})) / sum(w) AS m{k}' for k in (1, 2, 3, 4))} FROM d GROUP BY branch),
m AS (SELECT branch, m1 AS mu, sqrt(m2 - m1 * m1) AS sd, (m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 15e-1) AS skew, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3 AS kurt FROM mm),
b AS (SELECT branch, least(floor((y + 5) / {_W}::double), 39)::INTEGER AS bin, sum(w) AS w FROM d WHERE y BETWEEN -5 AND 1 GROUP BY ALL),
c AS (SELECT branch, bin, w, sum(w) OVER (PARTITION BY branch ORDER BY bin) AS c, sum(w) OVER (PARTITION BY branch) AS t FROM b),
qb AS (SELECT branch, mu, sd, z, min(bin) AS bin FROM c JOIN m USING (branch), (VALUES {', '.join(f'({p}::double, {NormalDist().inv_cdf(p)!r}::double)' for p in grids.QQ_SHARES)}) x(p, z) WHERE c >= p * t GROUP BY ALL),
qq AS (SELECT branch, 1 - sum(pow(q - mu - sd * z, 2)) / (count(*) * var_pop(q)) AS qq FROM (SELECT *, -5 + (bin + 0.5::double) * {_W}::double AS q FROM qb) GROUP BY branch),
r AS (SELECT branch, mu, sd, c / t AS f, w / t / {_W}::double AS h, {_cdf_sql(f'(-5 + (bin + 1) * {_W}::double)')} AS n, exp(-0.5 * pow((-5 + (bin + 0.5::double) * {_W}::double - mu) / sd, 2)) / (sd * {math.sqrt(2 * math.pi)!r}) AS g, (-5 + (bin + 0.5::double) * {_W}::double - mu) / sd AS z FROM c JOIN m USING (branch)),
s AS (SELECT branch, any_value(mu) AS mu, any_value(sd) AS sd, count(*) AS k, max(abs(f - n)) AS worst, sqrt(avg((f - n) * (f - n))) AS rms, sum((h - g) * (h - g)) AS off, var_pop(h) AS spread, {', '.join(f'sum(pow(z, {k})) AS z{k}' for k in (1, 2, 3, 4))}, {', '.join(f'sum(ln(h) * pow(z, {k})) AS l{k}' for k in (0, 1, 2))} FROM r WHERE f BETWEEN 0.005 AND 0.995 GROUP BY branch)
SELECT branch, {_r('s.mu')} AS mean, {_r('s.sd')} AS deviation, {_r('skew')} AS skewness, {_r('kurt')} AS excess_kurtosis, {_r('qq')} AS qq_r2, k AS core_bins, {_r('worst')} AS cdf_max_error, {_r('rms')} AS cdf_rms_error, {_r('1 - off / nullif(k * spread, 0)')} AS pdf_r2, {_r(f'2 * {_TOP} / nullif({_DET}, 0)', 4)} AS curvature FROM s JOIN m USING (branch) JOIN qq USING (branch)"""))
def log_normality(spark, sf_dir):
    return grids.log_normality(views.bag_of_points(spark, sf_dir), "pi", 3.0, -5.0, 1.0, 40)


@query(_bag(f"""f AS (SELECT work_full, s_bar, -pi AS pi_les, work_full - work_resolved AS delta_w, sign(pi) * ln(1 + abs(pi) / 0.5) AS symlog_pi FROM bag)
{' UNION ALL '.join(f"SELECT '{n}' AS feature, {_r(f'min({n})')} AS min, {_r(f'max({n})')} AS max FROM f" for n in ('work_full', 's_bar', 'pi_les', 'delta_w', 'symlog_pi'))}"""))
def feature_bounds(spark, sf_dir):
    c = F.col
    return grids.feature_bounds(views.bag_of_points(spark, sf_dir), {"work_full": c("work_full"), "s_bar": c("s_bar"), "pi_les": -c("pi"), "delta_w": c("work_full") - c("work_resolved"), "symlog_pi": symlog(c("pi"), 0.5)})


@query(_bag(f"""b AS (SELECT CASE WHEN work_full >= -25 AND work_full <= 25 THEN least(floor((work_full + 25) / 5), 9)::INTEGER END AS bx, CASE WHEN pi >= -6 AND pi <= 6 THEN least(floor((pi + 6) / 1.2e0), 9)::INTEGER END AS "by" FROM bag),
c AS (SELECT bx, "by", round(count(*) / sum(count(*)) OVER () / 6, 8) AS density FROM b WHERE bx IS NOT NULL AND "by" IS NOT NULL GROUP BY ALL), l AS (SELECT bx, "by", CASE WHEN density > 0 THEN round(log10(density), 9) END AS l FROM c),
e AS (SELECT quantile_cont(l, 0.01) AS a, quantile_cont(l, 0.99) AS b FROM l) SELECT bx, "by", {_r('coalesce(greatest(0, least(1, (l - a) / nullif(b - a, 0))), -1)')} AS shade FROM l, e"""))
def density_display(spark, sf_dir):
    return grids.display_density(binning.density_2d(views.bag_of_points(spark, sf_dir), "work_full", "pi", (-25.0, 25.0, -6.0, 6.0), 10))


_WIDTHS = [2.0, 4.0, 8.0, 4.0]
_REFERENCE = [("reference", 10.0, 0.2), ("reference", 30.0, 0.9), ("reference", 100.0, 1.0)]


@query(_bag(f"""m AS (SELECT frame, -avg(pi) AS fm, avg(u2) AS eps FROM bag GROUP BY frame), w AS (SELECT DISTINCT width FROM (VALUES {', '.join(f'({w}::double)' for w in _WIDTHS)}) t(width)),
o AS (SELECT 'frame_' || frame AS series, {grids.HALF_GAIN!r} / (width * ({TWO_PI} / 64)) AS cutoff, width * ({TWO_PI} / 64) / pow(pow(1e-3, 3) / eps, 0.25) AS r, fm / nullif(eps, 0) AS p FROM m, w WHERE eps > 0
  UNION ALL SELECT s, {grids.HALF_GAIN!r} / r, r, p FROM (VALUES {', '.join(f"('{s}', {r}::double, {p}::double)" for s, r, p in _REFERENCE)}) t(s, r, p))
SELECT series, row_number() OVER (PARTITION BY series ORDER BY r)::INTEGER AS nth, {_r('cutoff', 4)} AS cutoff, {_r('cutoff', 4)} AS modes, {_r('r', 3)} AS r_over_eta, {_r('p', 3)} AS pi_over_epsilon FROM o"""))
def flux_points(spark, sf_dir):
    means = views.bag_of_points(spark, sf_dir).groupBy("frame").agg((-F.avg("pi")).alias("forward_mean_pi"), F.avg("u2").alias("epsilon"))
    return grids.flux_points(means, _WIDTHS, _REFERENCE, 64, 2 * math.pi, 1e-3)


def _fields(spark, sf_dir):
    return spectral.as_points(spectral.derived_fields(velocity(spark, sf_dir), N, SIGMA), ["divergence", "strain"])


@query(f"""{derived_sql()}, g AS (SELECT frame, sqrt(avg(divergence * divergence)) / nullif(sqrt(avg(strain)), 0) AS a, max(abs(divergence)) / nullif(sqrt(max(strain)), 0) AS b FROM fields GROUP BY frame)
SELECT frame, {_r('a')} AS rms_ratio, {_r('b')} AS max_ratio, a <= 1e-4 AS rms_passed, b <= 1e-3 AS max_passed FROM g""")
def divergence_gate(spark, sf_dir):
    return gates.divergence_gate(_fields(spark, sf_dir))


@query(f"""{derived_sql()} SELECT frame, ((p // 16 // 2) * 4 + (p // 4 % 4 // 2) * 2 + p % 4 // 2)::INTEGER AS block_id, count(*) AS point_count, {_r('sum(strain)')} AS "sum", {_r('avg(strain)')} AS mean FROM fields GROUP BY ALL""")
def strain_blocks(spark, sf_dir):
    return grids.cube_block_sums(_fields(spark, sf_dir), 4, 2, "strain")
