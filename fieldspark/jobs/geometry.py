"""Queries on blocks with ghost layers, voxel surfaces, hash trees, chosen planes and stored measures, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean
from fieldspark.jobs.grids import _LAT, _lattice
from fieldspark.jobs.registry import _bag, _r, query
from fieldspark.operators import gates, halo, lattices, long_lattice, surfaces
from fieldspark.operators.long_lattice import Gain
from fieldspark.sources import shared, views

_BLOCK = {"z": 7, "y": 4, "x": 3}  # ragged along all axes
_STEPS = "(VALUES (-2, 1e0), (-1, -8e0), (1, 8e0), (2, -1e0)) s(k, w)"


@query(f"""{_LAT}, t AS (
  SELECT x, y, (z - k + nz) % nz AS z, w * v AS gz, 0e0 AS gy, 0e0 AS gx FROM lattice, size, {_STEPS}
  UNION ALL SELECT x, (y - k + 10) % 10, z, 0e0, w * v, 0e0 FROM lattice, {_STEPS} UNION ALL SELECT (x - k + 10) % 10, y, z, 0e0, 0e0, w * v FROM lattice, {_STEPS})
SELECT z::INTEGER AS z, y::INTEGER AS y, x::INTEGER AS x, {', '.join(f"{_r(f'sum({g})', 3)} AS {g}" for g in ('gx', 'gy', 'gz'))} FROM t GROUP BY ALL""")
def fd4_block_gradient(spark, sf_dir):
    """All axes of the gradient from one shuffle of blocks with two ghost layers."""
    d, n = _lattice(spark, sf_dir)
    lengths = {a: n[a] / 12 for a in "zyx"}  # so that a step is 1/12
    return halo.block_gradient(d, n, _BLOCK, lengths).select("z", "y", "x", *[clean(F.col(g), 3).alias(g) for g in ("gx", "gy", "gz")])


_RING = "[(0, 0), (1, 0), (1, 1), (0, 1)]"


@query(f"""{_LAT}, c AS (SELECT z, y, x FROM lattice WHERE v > 400000),
sides AS (SELECT * FROM (VALUES (0, 0, -1, 0, 0), (0, 1, 1, 0, 0), (1, 0, 0, -1, 0), (1, 1, 0, 1, 0), (2, 0, 0, 0, -1), (2, 1, 0, 0, 1)) s(axis, side, dz, dy, dx)),
f AS (SELECT row_number() OVER () AS face, axis, side, z, y, x FROM (SELECT c.*, axis, side, c.z + dz AS nz, c.y + dy AS ny, c.x + dx AS nx FROM c, sides) a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.z = a.nz AND c.y = a.ny AND c.x = a.nx)),
corners AS (SELECT face, k, z + CASE axis WHEN 0 THEN side ELSE u END AS z, y + CASE axis WHEN 1 THEN side WHEN 0 THEN u ELSE v END AS y, x + CASE axis WHEN 2 THEN side ELSE v END AS x
  FROM f, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) r(k, u, v)),
named AS (SELECT face, k, (z * 1000 + y) * 1000 + x AS p FROM corners),
lines AS (SELECT a.face, least(a.p, b.p) AS a, greatest(a.p, b.p) AS b, CASE WHEN (a.k, b.k) = (0, 2) THEN 2 ELSE 1 END AS uses FROM named a JOIN named b ON a.face = b.face AND (b.k = (a.k + 1) % 4 OR (a.k, b.k) = (0, 2))),
edges AS (SELECT a, b, sum(uses) AS uses FROM lines GROUP BY a, b)
SELECT (SELECT count(*) FROM f) AS faces, (SELECT count(DISTINCT p) FROM named) AS vertices, (SELECT 2 * count(*) FROM f)::BIGINT AS triangles, count(*) AS edges, count(*) FILTER (uses % 2 = 0) AS closed_edges, count(*) FILTER (uses > 2) AS shared_edges,
  (SELECT count(*) FROM c)::DOUBLE AS enclosed FROM edges""")
def voxel_surface(spark, sf_dir):
    """Counts of the welded surface of all cells above a limit; the enclosed volume follows from its triangles alone."""
    d, _ = _lattice(spark, sf_dir)
    vertices, mesh = surfaces.surface(d.where("v > 400000"))
    edges = surfaces.edge_counts(mesh)
    m = mesh.agg(F.count(F.lit(1)).alias("triangles"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") % 2 == 0).alias("closed_edges"), F.count_if(F.col("uses") > 2).alias("shared_edges"))
    one = m.join(e).join(vertices.agg(F.count(F.lit(1)).alias("vertices"))).join(surfaces.enclosed_volume(vertices, mesh))  # one row each
    return one.select((F.col("triangles") / 2).cast("bigint").alias("faces"), "vertices", "triangles", "edges", "closed_edges", "shared_edges", clean(F.col("enclosed"), 3).alias("enclosed"))


_LINES = "string_agg(z || ',' || y || ',' || x || ',' || printf('%.2f', v), ';' ORDER BY z, y, x)"


@query(f"""WITH RECURSIVE {_LAT[5:]}, leaves AS (SELECT (z // 8)::INTEGER AS tz, (y // 4)::INTEGER AS ty, (x // 4)::INTEGER AS tx, count(*) AS points, sha256({_LINES}) AS hash FROM lattice GROUP BY ALL),
levels AS (SELECT CASE WHEN m = 0 THEN 0 ELSE floor(log2(m))::INTEGER + 1 END AS top FROM (SELECT greatest(max(tz), max(ty), max(tx)) AS m FROM leaves)),
tree AS (SELECT 0 AS level, * FROM leaves UNION ALL
  SELECT level + 1, (tz // 2)::INTEGER, (ty // 2)::INTEGER, (tx // 2)::INTEGER, sum(points)::BIGINT, sha256(string_agg(hash, ',' ORDER BY tz, ty, tx)) FROM tree, levels WHERE level < top GROUP BY level, tz // 2, ty // 2, tx // 2)
SELECT level, tz, ty, tx, points, hash FROM tree""")
def tile_hash_tree(spark, sf_dir):
    """sha256 of each tile's values in order, combined upward to one hash of the lattice."""
    d, _ = _lattice(spark, sf_dir)
    leaves = halo.tile_hashes(d, {"z": 8, "y": 4, "x": 4}, text=F.format_string("%.2f", "v"))
    return halo.hash_tree(leaves)


_WIDTH = 1.5
_TURN = f"{2 * math.pi!r}"


def _kernels(axis: str, n: str) -> str:
    """soft and slope of a periodic axis of n points as sums over its waves: what a point d steps back adds."""
    k = f"(CASE WHEN 2 * k > {n} THEN k - {n} ELSE k END)"
    return f"""k_{axis} AS MATERIALIZED (SELECT d, sum(exp(-5e-1 * pow({_WIDTH} * {_TURN} * {k} / {n}, 2)) * cos({_TURN} * k * d / {n})) / any_value({n}) AS soft,
  -sum(CASE WHEN 2 * k = {n} THEN 0 ELSE {k} END * sin({_TURN} * k * d / {n})) / any_value({n}) AS slope FROM size, (SELECT unnest(range({n})) AS k FROM size), (SELECT unnest(range({n})) AS d FROM size) GROUP BY d)"""


def _along(axis: str, n: str, source: str, kernel: str, column: str, out: str) -> str:
    others = ", ".join(f"s.{a}" for a in "zyx" if a != axis)
    return f"SELECT {others}, r.i::INTEGER AS {axis}, sum({kernel} * s.{column}) AS {out} FROM {source} s, size, (SELECT unnest(range({n})) AS i FROM size) r JOIN k_{axis} ON d = (r.i - s.{axis} + {n}) % {n} GROUP BY {others}, r.i"


@query(f"""{_LAT}, {_kernels('x', '10')}, {_kernels('y', '10')}, {_kernels('z', 'nz')},
sx AS MATERIALIZED ({_along('x', '10', 'lattice', 'soft', 'v', 'v')}), sy AS MATERIALIZED ({_along('y', '10', 'sx', 'soft', 'v', 'v')}), sz AS ({_along('z', 'nz', 'sy', 'soft', 'v', 'soft')}),
dx AS ({_along('x', '10', 'lattice', 'slope', 'v', 'gx')}), dy AS ({_along('y', '10', 'lattice', 'slope', 'v', 'gy')}), dz AS ({_along('z', 'nz', 'lattice', 'slope', 'v', 'gz')})
SELECT x, y, z, v, {', '.join(f'{_r(c, 1)} AS {c}' for c in ('soft', 'gx', 'gy', 'gz'))} FROM lattice JOIN sz USING (x, y, z) JOIN dx USING (x, y, z) JOIN dy USING (x, y, z) JOIN dz USING (x, y, z)""")
def lattice_spectra(spark, sf_dir):
    """A Gaussian filter and the spectral gradient of a lattice with sides of different lengths, beside its values, in three shuffles."""
    d, n = _lattice(spark, sf_dir)
    wanted = {"soft": Gain("v", None, "gaussian", _WIDTH), **{f"g{a}": Gain("v", a) for a in "xyz"}}
    out = long_lattice.spectral_columns(d, {a: n[a] for a in "xyz"}, wanted, carry=["v"])
    return out.select("x", "y", "z", "v", *[clean(F.col(c), 1).alias(c) for c in wanted])


_AT = {"x": [0, 3, 7], "y": [5], "z": [1, 2, 4000]}


@query(f"{_LAT} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS index, x, y, z, v FROM lattice WHERE {a} IN ({', '.join(map(str, ks))})" for a, ks in _AT.items()))
def chosen_planes(spark, sf_dir):
    d, _ = _lattice(spark, sf_dir)
    return lattices.planes_at(d, _AT)


_LIMITS = {"strict": {"identity_residual": 1e-4, "net_ratio": 0.01, "nonfinite": 0.0}, "loose": {"identity_residual": 1e-2, "identity_worst": 1e-6, "net_ratio": 50.0}}


@query(_bag(f"""d AS (SELECT *, work_full - work_resolved + pi - s_bar AS r FROM bag),
a AS (SELECT frame, coalesce(sqrt(avg(r * r)) / nullif(sqrt(avg(work_full * work_full) + avg(work_resolved * work_resolved) + avg(pi * pi) + avg(s_bar * s_bar)), 0), 0) AS identity_residual, max(abs(r)) AS identity_worst, abs(sum(s_bar)) / nullif(abs(sum(pi)), 0) AS net_ratio, (count(*) FILTER (NOT isfinite(pi)))::double AS nonfinite FROM d GROUP BY frame),
m AS (UNPIVOT a ON identity_residual, identity_worst, net_ratio, nonfinite INTO NAME measure VALUE value),
l AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{k}', {v!r}::double)" for s, x in _LIMITS.items() for k, v in x.items())}) t(rules, measure, "limit"))
SELECT rules, frame::INTEGER AS frame, measure, {_r('value')} AS value, "limit", value <= "limit" AS passed FROM m JOIN l USING (measure)"""))
def judged_measures(spark, sf_dir):
    """Measures of each frame, stored once and judged under two sets of limits without another scan of the points."""
    measures = shared.stored(gates.frame_measures(views.bag_of_points(spark, sf_dir)), "measures")
    sets = [gates.judge(measures, x).withColumn("rules", F.lit(name)) for name, x in _LIMITS.items()]
    return sets[0].unionByName(sets[1]).select("rules", "frame", "measure", clean(F.col("value")).alias("value"), "limit", "passed")
