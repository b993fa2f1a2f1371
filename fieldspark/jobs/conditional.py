"""Queries on tails, ranges, angles of overlap sets and near-zero populations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean
from fieldspark.jobs.registry import _bag, _r, query
from fieldspark.operators import tails
from fieldspark.sources import views


def _share(x: str, a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {a} * {b} > 0 THEN (ln(abs({x})) - ln(abs({a}))) / nullif(ln(abs({b})) - ln(abs({a})), 0) ELSE ({x} - {a}) / nullif({b} - {a}, 0) END, 0)"


def _bin(x: str) -> str:
    return (f"(CASE WHEN {x} < lower THEN least(floor({_share(x, 'lo', 'lower')} * 20), 19) WHEN {x} < upper THEN 20 + least(floor(({x} - lower) / (upper - lower) * 60), 59) "
            f"ELSE 80 + least(floor({_share(x, 'upper', 'hi')} * 20), 19) END)::INTEGER")


def _plan(name: str, source: str, value: str) -> str:
    return f"""{name} AS (SELECT frame, p[1] AS lo, p[2] AS lower, p[3] AS upper, p[4] AS hi, n FROM (SELECT frame, quantile_cont({value}, [0, 0.025, 1 - 0.025, 1]) AS p, count(*) AS n FROM {source} GROUP BY frame))"""


def _edge(i: str, n: int, a: str, b: str, geometric: bool) -> str:
    line = f"{a} + ({b} - {a}) * {i} / {n}"
    return f"CASE WHEN {a} * {b} > 0 THEN {a} * pow({b} / {a}, {i} / {n}::double) ELSE {line} END" if geometric else line


def _edges(name: str, plan: str) -> str:
    at = lambda k: f"CASE WHEN i < 20 THEN {_edge(f'(i + {k})', 20, 'lo', 'lower', True)} WHEN i < 80 THEN {_edge(f'(i - 20 + {k})', 60, 'lower', 'upper', False)} ELSE {_edge(f'(i - 80 + {k})', 20, 'upper', 'hi', True)} END"
    return f"""{name} AS (SELECT *, CASE WHEN region <> 'center' AND l * r > 0 THEN sign(l) * sqrt(l * r) ELSE (l + r) / 2 END AS c FROM (
  SELECT frame, n AS total, i::INTEGER AS bin, CASE WHEN i < 20 THEN 'lower_tail' WHEN i < 80 THEN 'center' ELSE 'upper_tail' END AS region, {at(0)} AS l, {at(1)} AS r FROM {plan}, range(100) t(i)))"""


def _direction(x: str, y: str) -> str:
    return f"""{_plan(f'plan_{x}', 'bag', x)}, {_edges(f'edges_{x}', f'plan_{x}')},
by_{x} AS (SELECT frame, {_bin(x)} AS bin, count(*) AS c, avg({y}) AS m, quantile_cont({y}, [0.25, 0.75]) AS p FROM bag JOIN plan_{x} USING (frame) GROUP BY ALL),
rows_{x} AS (SELECT '{y}_given_{x}' AS direction, frame::INTEGER AS frame, bin, region, {_r('(l) + 1e-12', 9)} AS bin_left, {_r('(r) + 1e-12', 9)} AS bin_right, {_r('(e.c) + 1e-12', 9)} AS bin_center, {_r('(r - l) + 1e-12', 9)} AS bin_width, coalesce(b.c, 0)::BIGINT AS "count",
  {_r('coalesce(b.c, 0) / total')} AS volume_fraction, {_r('(m) + 1e-12', 9)} AS conditional_mean, coalesce(b.c, 0) >= 100 AS reliable, {_r('p[1]', 8)} AS range_low, {_r('p[2]', 8)} AS range_high FROM edges_{x} e LEFT JOIN by_{x} b USING (frame, bin))"""


_BOTH = f"{_direction('u2', 'q')}, {_direction('q', 'u2')}, both_ways AS (SELECT * FROM rows_u2 UNION ALL SELECT * FROM rows_q)"


def _off_ties(column: str):
    """Nine digits of a value that may lie half way between two such numbers: a nudge beyond the sums' noise decides for all engines."""
    return clean(F.col(column) + 1e-12, 9)


def _both(spark, sf_dir):
    """Tails of u2 and q, which may have no width on a small table."""
    d = tails.conditional_both(views.bag_of_points(spark, sf_dir), "u2", "q", flat_tails=True)
    return d.withColumns({c: _off_ties(c) for c in ("bin_left", "bin_right", "bin_center", "bin_width", "conditional_mean")})


@query(_bag(f"{_BOTH} SELECT * FROM both_ways"))
def conditional_tails_both(spark, sf_dir):
    return _both(spark, sf_dir)


@query(_bag(f"""{_BOTH}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY "count" DESC, bin) AS nth FROM both_ways WHERE direction = 'u2_given_q' AND region = 'center')
SELECT frame, bin, "count", bin_left, bin_right FROM k WHERE nth = 1"""))
def modal_bin(spark, sf_dir):
    return tails.modal_bin(_both(spark, sf_dir), "u2_given_q")


@query(_bag(f"""e AS (SELECT min(u2) - greatest(abs(min(u2)), abs(max(u2)), 1) * 1e-5 AS lo, (max(u2) - min(u2) + 2 * (greatest(abs(min(u2)), abs(max(u2)), 1) * 1e-5)) / 131072 AS w FROM bag),
h AS (SELECT floor((u2 - lo) / w)::INTEGER AS bin, count(*) AS n FROM bag, e GROUP BY 1), k AS (SELECT *, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM h),
g AS (SELECT share, min(bin) AS bin FROM k, (VALUES (0.025::double), (0.5::double), (0.975::double)) x(share) WHERE c >= share * t GROUP BY share)
SELECT share, {_r('lo + (bin + (share * t - (c - n)) / n) * w')} AS quantile FROM g JOIN k USING (bin), e"""))
def grid_quantiles(spark, sf_dir):
    return tails.grid_quantiles(views.bag_of_points(spark, sf_dir), "u2", [0.025, 0.5, 0.975])


@query(_bag(f"""s AS (SELECT frame, round(q / qr, 9) AS qn, round(u2 / um, 9) AS un FROM bag JOIN (SELECT frame, sqrt(avg(q * q)) AS qr, avg(u2) AS um FROM bag GROUP BY frame) USING (frame)),
e AS (SELECT max(p) AS hi FROM (SELECT round(quantile_cont(un, 0.999), 9) AS p FROM s GROUP BY frame)),
b AS (SELECT frame, least(floor(un / hi * 10), 9)::INTEGER AS bin, count(*) AS n, avg(qn) AS m FROM s, e WHERE un <= hi GROUP BY ALL), v AS (SELECT bin, CASE WHEN n >= 20 THEN m END AS m FROM b)
SELECT bin, {_r('any_value(hi)')} AS upper_edge, count(m) AS valid_frames, {_r('avg(m)', 4)} AS mean, {_r('stddev_samp(m)', 4)} AS std FROM v, e GROUP BY bin"""))
def ensemble_common_edge(spark, sf_dir):
    return tails.common_edge(views.bag_of_points(spark, sf_dir))


_OVERLAP = f"""WITH {views.VECTORS_SQL}, m AS (SELECT sqrt(avg(q * q)) AS qr, avg(u2) AS um, count(*) AS total FROM vectors),
o AS (SELECT theta, round(qn, 9) AS qn, round(un, 9) AS un, total FROM (SELECT q / qr AS qn, u2 / um AS un, total, nm, 180 - degrees(acos(greatest(-1, least(1, -q / nm)))) AS theta
  FROM (SELECT *, sqrt(u2) * sqrt(gx * gx + gy * gy + gz * gz) AS nm FROM vectors), m WHERE nm <> 0) WHERE qn > 1 AND un > 1)"""


@query(f"""{_OVERLAP} SELECT count(*) AS "count", {_r('count(*) / any_value(total)')} AS volume_fraction, {_r('avg(theta)')} AS mean_angle, {_r('avg(cos(radians(theta)))')} AS mean_cos,
{', '.join(f"{_r(f'quantile_cont(theta, {p})')} AS {n}" for p, n in ((0.025, 'p025'), (0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.975, 'p975')))}, {_r('corr(theta, qn)')} AS corr_q, {_r('corr(theta, un)')} AS corr_u2 FROM o HAVING count(*) > 0""")
def overlap_angles(spark, sf_dir):
    return tails.overlap_angles(views.vectors(spark, sf_dir))


def _angle_bins(given: str) -> str:
    return f"""e_{given} AS (SELECT quantile_cont({given}, 0.025) AS a, quantile_cont({given}, 0.975) AS b FROM o),
b_{given} AS (SELECT *, (CASE WHEN {given} < a THEN 0 WHEN {given} >= b THEN 41 ELSE 1 + least(floor(({given} - a) / (b - a) * 40), 39) END)::INTEGER AS bin FROM o, e_{given}),
r_{given} AS (SELECT '{given}' AS given, bin, count(*) AS "count", {_r('count(*) / (SELECT count(*) FROM o)')} AS fraction, {_r(f'avg({given})')} AS x_mean, {_r('avg(theta)')} AS mean_angle, {_r('avg(cos(radians(theta)))')} AS mean_cos,
  {_r('quantile_cont(theta, 0.25)')} AS p25, {_r('quantile_cont(theta, 0.75)')} AS p75 FROM b_{given} GROUP BY bin)"""


@query(f"{_OVERLAP}, {_angle_bins('qn')}, {_angle_bins('un')} SELECT * FROM r_qn UNION ALL SELECT * FROM r_un")
def overlap_angle_bins(spark, sf_dir):
    return tails.overlap_angle_bins(views.vectors(spark, sf_dir))


@query(f"""{_OVERLAP}, {_angle_bins('qn')} SELECT bin, least(floor(theta), 179)::INTEGER AS degree, count(*) AS "count" FROM b_qn WHERE bin IN (SELECT DISTINCT bin FROM b_qn ORDER BY bin LIMIT 2) GROUP BY ALL""")
def lowest_q_angles(spark, sf_dir):
    return tails.lowest_q_angles(views.vectors(spark, sf_dir))


_FEATURES = {"slow": "slow", "flat": "flat", "normal": "normal", "only_normal": "NOT slow AND NOT flat AND normal", "slow_or_flat": "slow OR flat", "slow_and_flat": "slow AND flat",
             "regular": "NOT slow AND NOT flat AND NOT normal", "weak": "amplitude < 0.1"}


@query(f"""WITH {views.VECTORS_SQL}, v AS (SELECT *, gx*gx + gy*gy + gz*gz AS g2, sqrt(u2 * (gx*gx + gy*gy + gz*gz)) AS amp FROM vectors), m AS (SELECT sqrt(avg(q * q)) AS qr, avg(u2) AS um, sqrt(avg(g2)) AS gr FROM v),
d AS (SELECT 0 AS frame, u2, g2, q, round(q / qr, 9) AS qn, round(sqrt(u2 / um), 9) AS speed, round(sqrt(g2) / gr, 9) AS gradient, round(CASE WHEN amp <> 0 THEN least(abs(q) / amp, 1) END, 9) AS cos, round(amp / qr, 9) AS amplitude FROM v, m),
{_plan('plan', 'd', 'qn')}, b AS (SELECT *, {_bin('qn')} AS bin, speed < 0.1 AS slow, gradient < 0.1 AS flat, coalesce(cos < 0.1, false) AS normal FROM d JOIN plan USING (frame)),
peak AS (SELECT bin AS peak FROM b WHERE bin BETWEEN 20 AND 79 GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1),
p AS (SELECT * FROM b LEFT JOIN peak ON true, (VALUES ('all', NULL::double), ('q<0.1', 0.1), ('q<0.05', 0.05), ('q<0.01', 0.01), ('peak', -1)) x(population, lim) WHERE lim IS NULL OR abs(qn) < lim OR (lim = -1 AND bin = peak))
SELECT population, count(*) AS "count", {', '.join(f"{_r(f'avg(({c})::INTEGER)')} AS {n}" for n, c in _FEATURES.items())}, {_r('avg(speed * speed)')} AS speed2_mean, {_r('avg(gradient * gradient)')} AS gradient2_mean, {_r('avg(cos)')} AS cos_mean,
  {_r('avg(amplitude)')} AS amplitude_mean, {_r('sqrt(avg(cos * cos))')} AS cos_rms, count(*) FILTER (q = 0) AS zero_power, count(*) FILTER (u2 = 0) AS zero_velocity, count(*) FILTER (g2 = 0) AS zero_gradient,
  {', '.join(f"{_r(f'quantile_cont({c}, {p / 100})')} AS {c}_p{p}" for c in ('speed', 'gradient', 'cos') for p in (25, 50, 75))} FROM p GROUP BY population""")
def near_zero_features(spark, sf_dir):
    return tails.near_zero_features(views.vectors(spark, sf_dir))
