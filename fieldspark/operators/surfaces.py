"""Surfaces of voxel regions: exposed faces as triangles over welded, densely numbered vertices (X12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.sources.shared import numbered

AXES = ("z", "y", "x")


def faces(cells: DataFrame) -> DataFrame:
    """axis, side (0 low, 1 high), z, y, x: the sides of cells without a neighbour there; no wrapping, so the edge is outside.

    cells: distinct z, y, x.  One join: a cell meets the side that its neighbour offers.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.lit(s).alias("side")) for k in range(3) for s in (0, 1)])).alias("s")
    d = cells.select(*AXES, sides).select(*AXES, "s.axis", "s.side")
    step = F.when(F.col("side") == 0, -1).otherwise(1)
    across = [F.when(F.col("axis") == k, F.col(a) + step).otherwise(F.col(a)).alias(f"n{a}") for k, a in enumerate(AXES)]
    there = cells.select(*[F.col(a).alias(f"n{a}") for a in AXES])
    return d.select("*", *across).join(there, [f"n{a}" for a in AXES], "left_anti").select("axis", "side", *AXES)


def _corner(k: int, u: int, v: int) -> list:
    """Corner (u, v) of a face across axis k, as z, y, x: the two other axes keep their order."""
    free = [a for a in range(3) if a != k]
    return [F.col(a) + (F.col("side") if j == k else F.lit(u if j == free[0] else v)) for j, a in enumerate(AXES)]


def triangles(found: DataFrame) -> DataFrame:
    """face (axis, side, z, y, x), t (0 or 1) and corners a, b, c as structs (z, y, x): two triangles a face, wound so that the normal points outward."""
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    point = lambda u, v: F.when(F.col("axis") == 0, F.struct(*[c.cast("int").alias(a) for c, a in zip(_corner(0, u, v), AXES, strict=True)])).when(
        F.col("axis") == 1, F.struct(*[c.cast("int").alias(a) for c, a in zip(_corner(1, u, v), AXES, strict=True)])).otherwise(F.struct(*[c.cast("int").alias(a) for c, a in zip(_corner(2, u, v), AXES, strict=True)]))
    d = found.select("*", *[point(u, v).alias(f"p{k}") for k, (u, v) in enumerate(ring)])
    # With coordinates x, y, z the ring runs against the outward normal on the high sides across z and x and the low side across y.
    forward = (F.col("side") == 1) == (F.col("axis") == 1)
    pair = lambda t, b, c: F.struct(F.lit(t).alias("t"), F.col("p0").alias("a"), F.when(forward, F.col(b)).otherwise(F.col(c)).alias("b"), F.when(forward, F.col(c)).otherwise(F.col(b)).alias("c"))
    return d.select("axis", "side", *AXES, F.explode(F.array(pair(0, "p1", "p2"), pair(1, "p2", "p3"))).alias("r")).select("axis", "side", *AXES, "r.*")


def surface(cells: DataFrame, stride: int = 1, full: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices: index, x, y, z; triangles: a, b, c as indices) of a region's surface.

    Corners that faces share are one vertex; indices are dense from 0.  stride: grid steps of a cell;
    full: sizes of the grid, which the last cells do not pass.  Cells are centred on their points.
    """
    corners = triangles(faces(cells.select(*AXES).distinct()))
    ends = corners.select(F.explode(F.array("a", "b", "c")).alias("p")).select("p.*").distinct()
    indexed = numbered(ends, "index")

    def at(a: str):
        place = F.col(a) * stride - F.lit(0.5)
        return F.least(place, F.lit(full[a] - 0.5)) if full else place

    vertices = indexed.select("index", *[at(a).alias(a) for a in ("x", "y", "z")])
    out = corners.select("a", "b", "c")
    for k in "abc":
        out = out.join(indexed.select(F.struct(*AXES).alias(k), F.col("index").alias(f"{k}_index")), k)
    return vertices, out.select(*[F.col(f"{k}_index").alias(k) for k in "abc"])


def edge_counts(mesh: DataFrame) -> DataFrame:
    """a, b (a < b), uses: how many triangles have each edge; an even number everywhere means that the surface is closed."""
    ends = F.explode(F.array(*[F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) for u, v in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    return mesh.select(ends).select("e.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"))


def enclosed_volume(vertices: DataFrame, mesh: DataFrame) -> DataFrame:
    """One row, enclosed: the volume within a closed surface by its outward triangles, sums of a . (b x c) / 6."""
    d = mesh
    for k in "abc":
        d = d.join(vertices.select(F.col("index").alias(k), *[F.col(a).alias(f"{k}{a}") for a in ("x", "y", "z")]), k)
    at = F.col
    cross = {"x": at("by") * at("cz") - at("bz") * at("cy"), "y": at("bz") * at("cx") - at("bx") * at("cz"), "z": at("bx") * at("cy") - at("by") * at("cx")}
    return d.agg((F.coalesce(F.sum(sum(at(f"a{a}") * c for a, c in cross.items())), F.lit(0.0)) / 6).alias("enclosed"))
