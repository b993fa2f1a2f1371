"""SQL of operators on the cubes of embeddings, and velocities made of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldspark.operators import spectral
from fieldspark.sources import views

SIGMA = 1.25
N = 4  # side of the cubes in embeddings


def _list(values) -> str:
    return "[" + ", ".join(f"{x:.17e}" for x in values) + "]"


def _axis(name: str, source: str, axis: str, kernel: list[float], columns: dict[str, str]) -> str:
    place = ", ".join(f"r.i::INTEGER AS {a}" if a == axis else f"s.{a}" for a in "zyx")
    group = ", ".join("r.i" if a == axis else f"s.{a}" for a in "zyx")
    sums = ", ".join(f"sum({_list(kernel)}[((r.i - s.{axis} + {N}) % {N}) + 1] * s.{c}) AS {out}" for out, c in columns.items())
    return f"{name} AS MATERIALIZED (SELECT s.frame, {place}, {sums} FROM {source} s, range({N}) r(i) GROUP BY s.frame, {group})"


_DERIVE = spectral.derivative_kernel(N, 2 * math.pi)
_SMOOTH = spectral.gaussian_kernel(N, SIGMA)


def _gauss(name: str, source: str, columns: dict[str, str]) -> str:
    same = {c: c for c in columns}
    return ", ".join([_axis(f"{name}_1", source, "x", _SMOOTH, columns), _axis(f"{name}_2", f"{name}_1", "y", _SMOOTH, same), _axis(name, f"{name}_2", "z", _SMOOTH, same)])



def velocity(spark, sf_dir):
    """Three neighbouring cubes as the components of one velocity; an incomplete last one goes."""
    d = views.cubes(spark, sf_dir).groupBy(F.floor(F.col("frame") / 3).alias("frame")).agg(
        *[F.max(F.when(F.col("frame") % 3 == k, F.col("cube"))).alias(f"u{a}") for k, a in enumerate("xyz")])
    return d.where("ux is not null and uy is not null and uz is not null")


def derived_sql() -> str:
    pairs = [(i, j) for i in "xyz" for j in "xyz"]
    upper = ["xx", "xy", "xz", "yy", "yz", "zz"]
    t = lambda i, j: "t" + "".join(sorted(i + j))
    join = "USING (frame, z, y, x)"
    steps = [views.CUBES_SQL,
             "v AS MATERIALIZED (SELECT frame // 3 AS frame, z, y, x, max(v) FILTER (frame % 3 = 0) AS ux, max(v) FILTER (frame % 3 = 1) AS uy, max(v) FILTER (frame % 3 = 2) AS uz FROM cells GROUP BY ALL HAVING count(*) = 3)",
             *[_axis(f"g{j}", "v", j, _DERIVE, {f"g{i}{j}": f"u{i}" for i in "xyz"}) for j in "xyz"],
             f"r AS MATERIALIZED (SELECT *, {', '.join('+'.join(f'u{j}*g{i}{j}' for j in 'xyz') + f' AS a{i}' for i in 'xyz')}, {', '.join(f'u{p[0]}*u{p[1]} AS p{p}' for p in upper)} FROM v JOIN gx {join} JOIN gy {join} JOIN gz {join})",
             _gauss("f", "r", {**{f"e{i}": f"u{i}" for i in "xyz"}, **{f"ga{i}": f"a{i}" for i in "xyz"}, **{f"q{p}": f"p{p}" for p in upper}}),
             f"w AS MATERIALIZED (SELECT *, {', '.join(f'q{p} - e{p[0]}*e{p[1]} AS t{p}' for p in upper)} FROM f)",
             *[_axis(f"h{j}", "w", j, _DERIVE, {f"h{i}{j}": f"e{i}" for i in "xyz"}) for j in "xyz"],
             f"m AS MATERIALIZED (SELECT *, {', '.join('+'.join(f'e{i}*{t(i, j)}' for i in 'xyz') + f' AS f{j}' for j in 'xyz')} FROM w)",
             *[_axis(f"s{j}", "m", j, _DERIVE, {f"s{j}": f"f{j}"}) for j in "xyz"]]
    wr = "+".join(f"e{i}*e{j}*h{i}{j}" for i, j in pairs)
    pi = "+".join(f"{t(i, j)}*h{i}{j}" for i, j in pairs)
    ss = "+".join(f"(g{i}{j}+g{j}{i})*(g{i}{j}+g{j}{i})/4" for i, j in pairs)
    steps.append(f"""fields AS MATERIALIZED (SELECT w.frame, w.z*16 + w.y*4 + w.x AS p, ex*gax + ey*gay + ez*gaz AS work_full, {wr} AS work_resolved, {pi} AS pi, sx.sx + sy.sy + sz.sz AS s_bar,
      gxx + gyy + gzz AS divergence, {ss} AS strain FROM w JOIN r {join} JOIN hx {join} JOIN hy {join} JOIN hz {join} JOIN sx {join} JOIN sy {join} JOIN sz {join})""".replace("w.z*16 + w.y*4 + w.x", "z*16 + y*4 + x").replace("w.frame", "frame"))
    return "WITH " + ", ".join(steps)
