"""Queries on quality gates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions.scalar import FIELDS, clean
from fieldspark.jobs.registry import _bag, _r, query
from fieldspark.operators import events, gates, lattices, regimes
from fieldspark.sources import views

_FIELDS = ", ".join(f"sum({f}) AS {f}, sum(abs({f})) AS abs_{f}" for f in FIELDS)


def _row(name: str, left: str, right: str, size: str, tolerance: float) -> str:
    return f"SELECT '{name}' AS \"check\", {_r(f'({left})::double', 3)} AS left_side, {_r(f'({right})::double', 3)} AS right_side, coalesce(abs(({left}) - ({right})) / nullif({size}, 0), 0) <= {tolerance} AS passed FROM p, w"


@query(_bag(f"""d AS (SELECT *, work_full - work_resolved AS delta_w, {regimes.REGIME_SQL} AS regime FROM bag),
k AS (SELECT regime, count(*) AS n, count(*) FILTER (pi > 0) + count(*) FILTER (pi < 0) + count(*) FILTER (pi = 0) AS signs, sum(greatest(pi, 0)) AS pos, sum(least(pi, 0)) AS neg, {_FIELDS} FROM d GROUP BY regime),
p AS (SELECT sum(n) AS r_n, sum(signs) AS signs, sum(pos) AS r_pos, sum(neg) AS r_neg, {', '.join(f'sum({f}) AS r_{f}' for f in FIELDS)} FROM k), w AS (SELECT count(*) AS n, {_FIELDS} FROM d)
{' UNION ALL '.join([_row('regime_counts', 'r_n', 'n', 'n', 0), _row('direction_counts', 'signs', 'n', 'n', 0), _row('signed_parts_of_pi', 'r_pos + r_neg', 'pi', 'abs_pi', 1e-9), _row('magnitudes_of_pi', 'r_pos - r_neg', 'abs_pi', 'abs_pi', 1e-9),
                     *[_row(f'regimes_of_{f}', f'r_{f}', f, f'abs_{f}', 1e-9) for f in FIELDS]])}"""))
def closures(spark, sf_dir):
    return gates.closures(views.bag_of_points(spark, sf_dir))


_LAT = f"WITH {views.LATTICE_SQL}, size AS (SELECT max(z) + 1 AS nz FROM lattice)"


@query(f"""{_LAT}, k AS (SELECT x, y, z, count(*) AS n, count(*) FILTER (v IS NULL OR NOT isfinite(v)) AS bad, max((x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9 AND z BETWEEN 0 AND nz - 1)::INTEGER) AS inside FROM lattice, size GROUP BY x, y, z),
r AS (SELECT count(*) FILTER (inside = 1) AS covered, count(*) FILTER (n > 1) AS repeated, coalesce(sum(bad), 0) AS nonfinite, count(*) FILTER (inside = 0) AS outside FROM k),
c AS (SELECT 'covered' AS "check", nz * 100 AS expected, covered AS found FROM r, size UNION ALL SELECT 'repeated', 0, repeated FROM r UNION ALL SELECT 'nonfinite', 0, nonfinite FROM r UNION ALL SELECT 'outside', 0, outside FROM r)
SELECT "check", expected::BIGINT AS expected, found::BIGINT AS found, expected = found AS passed FROM c""")
def lattice_preflight(spark, sf_dir):
    d = views.lattice(spark, sf_dir)
    return gates.preflight(d, lattices.extent(d))


@query(f"""{_LAT}, t AS (SELECT (x // 4) * 4 AS x0, (y // 4) * 4 AS y0, (z // 4) * 4 AS z0, v FROM lattice)
SELECT x0::INTEGER AS x0, y0::INTEGER AS y0, z0::INTEGER AS z0, count(*) AS "count", min(v) AS "min", max(v) AS "max", {_r('avg(v)', 8)} AS mean, {_r('sqrt(avg(v * v))', 4)} AS rms FROM t GROUP BY ALL""")
def lattice_validation(spark, sf_dir):
    tile = lambda a: (F.floor(F.col(a) / 4) * 4).cast("int").alias(f"{a}0")
    v = F.col("v")
    return gates.require_finite(views.lattice(spark, sf_dir), "v").groupBy(*[tile(a) for a in "xyz"]).agg(
        F.count(F.lit(1)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), clean(F.avg(v), 8).alias("mean"), clean(F.sqrt(F.avg(v * v)), 4).alias("rms"))


@query(f"""WITH {views.VECTORS_SQL}, u AS (SELECT vec_id, frame, ux, uy, uz FROM vectors), g AS (SELECT vec_id, gx, gy, gz FROM vectors), j AS (SELECT frame, -(ux*gx + uy*gy + uz*gz) AS q, ux*ux + uy*uy + uz*uz AS u2 FROM u JOIN g USING (vec_id))
SELECT frame, count(*) AS "count", {_r('sqrt(avg(q * q))')} AS q_rms, {_r('avg(u2)')} AS u2_mean FROM j GROUP BY frame""")
def joined_power(spark, sf_dir):
    """Power from a velocity table and a gradient table, joined by place; both are cut from embeddings."""
    v = views.vectors(spark, sf_dir)
    d = gates.joined_by_place(v.select("vec_id", "frame", "ux", "uy", "uz"), v.select("vec_id", "gx", "gy", "gz"), ["vec_id"])
    q, u2 = -sum(F.col(f"u{a}") * F.col(f"g{a}") for a in "xyz"), sum(F.col(f"u{a}") * F.col(f"u{a}") for a in "xyz")
    return d.groupBy("frame").agg(F.count(F.lit(1)).alias("count"), clean(F.sqrt(F.avg(q * q))).alias("q_rms"), clean(F.avg(u2)).alias("u2_mean"))


@query(_bag("""s AS (SELECT frame, q / nullif(qr, 0) AS qn, u2 / nullif(um, 0) AS un FROM bag JOIN (SELECT frame, sqrt(avg(q*q)) AS qr, avg(u2) AS um FROM bag GROUP BY frame) USING (frame))
SELECT frame::INTEGER AS frame, alpha, beta, count(*) AS own_count, count(*) AS other_count, true AS passed FROM s, (VALUES (0.5::double), (1.0::double), (1.5::double)) x(alpha), (VALUES (1.0::double), (1.5::double), (2.0::double)) y(beta) WHERE qn > alpha AND un > beta GROUP BY ALL"""))
def overlap_crosscheck(spark, sf_dir):
    """Counts of the nested regions against those of the overlap table: both must tell the same."""
    d = views.bag_of_points(spark, sf_dir)
    alphas, betas = [0.5, 1.0, 1.5], [1.0, 1.5, 2.0]
    regions = events.nested_regions(d, alphas, betas).where("alpha is not null and beta is not null")
    table = events.overlap(d, alphas, betas).where("intersection_count > 0").withColumnRenamed("intersection_count", "count")
    return gates.matching_counts(regions, table, ["frame", "alpha", "beta"], "count")
