"""Dense lattices: slices, sampling, blocks, stencils, seams, faces, tiles: F8, F10-F12, G8, G11, G34, S24, S27, X9, X10, X12, J3, J7-J10, W2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, normalized_difference, ratio

AXES = ("x", "y", "z")


def extent(points: DataFrame) -> dict[str, int]:
    r = points.agg(*[(F.max(a) + 1).alias(a) for a in AXES]).first()
    return {a: r[a] or 0 for a in AXES}


def planes(points: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The three middle planes, a point on several of them once for each."""
    flags = F.filter(F.array(*[F.when(F.col(a) == sizes[a] // 2, F.lit(p)) for a, p in zip(AXES, ("yz", "xz", "xy"), strict=True)]), lambda p: p.isNotNull())
    near = (F.col("x") == sizes["x"] // 2) | (F.col("y") == sizes["y"] // 2) | (F.col("z") == sizes["z"] // 2)
    return points.where(near).select(F.explode(flags).alias("plane"), *AXES, "v")


def planes_at(points: DataFrame, at: dict[str, list[int]]) -> DataFrame:
    """axis, index, x, y, z, v: the planes at chosen indices of each axis, a point on several of them once for each; one scan.

    An axis may be left out; an index beyond the lattice gives no points.
    """
    here = [(a, F.col(a).isin(*ks)) for a, ks in at.items() if ks]
    if not here:
        raise ValueError("no plane is asked for")
    flags = F.filter(F.array(*[F.when(c, F.struct(F.lit(a).alias("axis"), F.col(a).alias("index"))) for a, c in here]), lambda p: p.isNotNull())
    on_any = here[0][1]
    for _, c in here[1:]:
        on_any = on_any | c
    return points.where(on_any).select(F.explode(flags).alias("p"), *AXES, "v").select("p.axis", "p.index", *AXES, "v")


def sampled(points: DataFrame, stride: int = 2) -> DataFrame:
    """Every stride-th point from 0 on each axis, renumbered."""
    keep = (F.col("x") % stride == 0) & (F.col("y") % stride == 0) & (F.col("z") % stride == 0)
    return points.where(keep).select(*[(F.floor(F.col(a) / stride)).cast("int").alias(a) for a in AXES], "v")


def blocks(points: DataFrame, sizes: dict[str, int], divisions: int) -> DataFrame:
    """points with bx, by, bz and block_id; every axis must divide evenly."""
    if any(n % divisions for n in sizes.values()):
        raise ValueError("the divisions must divide each axis")
    at = {a: F.floor(F.col(a) / (sizes[a] // divisions)).cast("int") for a in AXES}
    return points.select("*", *[at[a].alias(f"b{a}") for a in AXES], (at["z"] * divisions * divisions + at["y"] * divisions + at["x"]).alias("block_id"))


def block_moments(points: DataFrame, sizes: dict[str, int], divisions: int) -> DataFrame:
    """Sum, mean, population deviation, extremes and rank (by mean, then id) of each block."""
    v = F.col("v")
    d = blocks(points, sizes, divisions).groupBy("block_id", "bx", "by", "bz").agg(
        F.count(F.lit(1)).alias("point_count"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))).alias("d"))
    rank = F.row_number().over(Window.orderBy("m", "block_id"))  # divisions ** 3 rows
    return d.select("block_id", "bx", "by", "bz", "point_count", clean(F.col("s"), 3).alias("sum"), clean(F.col("m"), 7).alias("mean"), clean(F.col("d"), 3).alias("std"), "min", "max", rank.cast("bigint").alias("rank"))


def pair_asymmetry(points: DataFrame, sizes: dict[str, int], divisions: int, centre: float) -> DataFrame:
    """Sums above and below a centre in each block, and their normalised difference."""
    up, down = F.greatest(F.col("v") - centre, F.lit(0.0)), F.greatest(centre - F.col("v"), F.lit(0.0))
    d = blocks(points, sizes, divisions).groupBy("block_id").agg(F.sum(up).alias("a"), F.sum(down).alias("b"))
    return d.select("block_id", clean(F.col("a"), 3).alias("above"), clean(F.col("b"), 3).alias("below"), clean(normalized_difference(F.col("a"), F.col("b"))).alias("asymmetry"))


#: Regime codes of each pair, left and right: 1+ and 1- against 4+ and 4-, 2 against 3; code 0 is uncertain.
REGIME_PAIRS = {"1_4": ((1, 2), (5, 6)), "2_3": ((3,), (4,))}


def regime_pair_asymmetry(points: DataFrame, strain: DataFrame, sizes: dict[str, int], divisions: int) -> DataFrame:
    """Asymmetries of pi between the regimes of each pair, by block, with the block's strain.

    points have x, y, z, pi and regime (code 0 to 6), strain has one row (block_id, block_x, block_y,
    block_z, sij_sij_mean) for each block; a missing, repeated or misplaced block, or a pi that is
    not finite, is an error.  Asymmetries are null where nothing is to be compared.
    """
    d = blocks(points, sizes, divisions)
    side = lambda a: {"x": F.lit(1), "y": F.lit(divisions), "z": F.lit(divisions * divisions)}[a]
    right_place = F.lit(True)
    for a in AXES:
        right_place = right_place & (F.col(f"block_{a}") == F.floor(F.col("block_id") / side(a)) % divisions)
    blocks_found = F.countDistinct(F.when(right_place & F.col("block_id").between(0, divisions ** 3 - 1), F.col("block_id")))
    checked = strain.agg(F.count(F.lit(1)).alias("n"), blocks_found.alias("good")).first()
    if checked["n"] != divisions ** 3 or checked["good"] != divisions ** 3:
        raise ValueError("strain must have each block once, at its own coordinates")
    finite = F.col("pi").isNotNull() & ~F.isnan("pi") & (F.abs("pi") != float("inf"))
    pi = F.when(finite, F.col("pi")).otherwise(F.raise_error(F.lit("pi is not finite")).cast("double"))
    named = {f"{pair}_{end}": F.col("regime").isin(*codes) for pair, ends in REGIME_PAIRS.items() for end, codes in zip(("left", "right"), ends, strict=True)}
    sums = [x for k, c in named.items() for x in (
        F.count_if(c).alias(f"{k}_count"), F.sum(F.when(c, F.greatest(pi, F.lit(0.0))).otherwise(0.0)).alias(f"{k}_backscatter"), F.sum(F.when(c, F.greatest(-pi, F.lit(0.0))).otherwise(0.0)).alias(f"{k}_forward"))]
    # pi is checked in every row, uncertain ones too.
    by = d.groupBy("block_id").agg(F.count(pi).alias("point_count"), *sums).join(strain, "block_id")
    out = []
    for pair in REGIME_PAIRS:
        lb, lf, rb, rf = (F.col(f"{pair}_{end}_{way}") for end in ("left", "right") for way in ("backscatter", "forward"))
        out += [F.col(f"{pair}_left_count").alias(f"pair_{pair}_left_count"), F.col(f"{pair}_right_count").alias(f"pair_{pair}_right_count"),
                clean(normalized_difference(lb, rb)).alias(f"a_{pair}_backscatter"), clean(normalized_difference(lf, rf)).alias(f"a_{pair}_forward"),
                clean(ratio((lb - lf) - (rb - rf), lb + lf + rb + rf)).alias(f"a_{pair}_total")]
    covered = sum(F.col(f"{k}_count") for k in named)
    return by.select("block_id", "block_x", "block_y", "block_z", "point_count", "sij_sij_mean", *out, covered.alias("classified_count"), (F.col("point_count") - covered).alias("uncertain_count"))


def stencil(points: DataFrame, axis: str, size: int, weights: dict[int, float], out: str) -> DataFrame:
    """sum of weight(k) * v(position + k), periodic, in scatter form: each point gives its few terms, one shuffle."""
    terms = F.explode(F.array(*[F.struct(F.lit(-k).alias("k"), F.lit(w).alias("w")) for k, w in weights.items()]))
    moved = points.select(*AXES, "v", terms.alias("t"))
    target = F.pmod(F.col(axis) + F.col("t.k"), F.lit(size)).cast("int")
    return moved.select(*[target.alias(a) if a == axis else F.col(a) for a in AXES], (F.col("t.w") * F.col("v")).alias("term")).groupBy(*AXES).agg(F.sum("term").alias(out))


def fd4(points: DataFrame, axis: str, size: int, step: float) -> DataFrame:
    """Fourth-order periodic derivative along an axis: each line of points is sorted once and wraps around.

    A line with a missing or repeated point is an error.
    """
    line = Window.partitionBy(*[a for a in AXES if a != axis])
    w, whole = line.orderBy(axis), line.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.col(axis)

    def at(k: int):
        """v at position + k, from the other end of the line where that lies outside it."""
        inner = F.lead("v", k).over(w) if k > 0 else F.lag("v", -k).over(w)
        out = inner
        for p in range(size - k, size) if k > 0 else range(-k):
            out = F.when(place == p, F.nth_value("v", (p + k) % size + 1).over(whole)).otherwise(out)
        return out

    complete = (F.count(F.lit(1)).over(whole) == size) & (F.row_number().over(w) - 1 == place)
    value = (at(-2) - 8 * at(-1) + 8 * at(1) - at(2)) / (12 * step)
    checked = F.when(complete, value).otherwise(F.raise_error(F.lit("a line of the lattice has missing or repeated points")).cast("double"))
    return points.select(*AXES, checked.alias(f"d{axis}"))


def fd2_open(points: DataFrame, axis: str, step: float) -> DataFrame:
    """Second-order derivative of a line with ends (one-sided of second order there)."""
    w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    v, a1, a2, b1, b2 = F.col("v"), F.lead("v", 1).over(w), F.lead("v", 2).over(w), F.lag("v", 1).over(w), F.lag("v", 2).over(w)
    d = F.when(b1.isNull(), -1.5 * v + 2 * a1 - 0.5 * a2).when(a1.isNull(), 1.5 * v - 2 * b1 + 0.5 * b2).otherwise((a1 - b1) / 2)
    return points.select(*AXES, (d / step).alias(f"d{axis}"))


def seams(points: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rms step across the periodic seam and across the first inner pair of planes, per axis."""
    out = None
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        n = sizes[axis]
        w = {k: F.max(F.when(F.col(axis) == k, F.col("v"))) for k in (0, 1, n - 1)}
        lines = points.where(F.col(axis).isin(0, 1, n - 1)).groupBy(*others).agg(w[0].alias("v0"), w[1].alias("v1"), w[n - 1].alias("vn"))
        rms = lambda a, b: F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2))
        row = lines.agg(clean(rms("v0", "vn"), 3).alias("seam_rms"), clean(rms("v1", "v0"), 3).alias("inner_rms")).select(F.lit(axis).alias("axis"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def exposed_faces(points: DataFrame, limit: float) -> DataFrame:
    """Faces of cells above limit whose neighbour on that side is not, by direction (no wrapping)."""
    cells = points.where(F.col("v") > limit).select(*AXES)
    sides = [(dx, dy, dz) for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    side = F.explode(F.array(*[F.struct(F.lit(f"{'+' if sum(s) > 0 else '-'}{AXES[[abs(c) for c in s].index(1)]}").alias("side"), *[F.lit(c).alias(f"d{a}") for a, c in zip(AXES, s, strict=True)]) for s in sides]))
    faces = cells.select(*AXES, side.alias("s")).select("s.side", *[(F.col(a) + F.col(f"s.d{a}")).alias(f"n{a}") for a in AXES])
    inner = cells.select(*[F.col(a).alias(f"n{a}") for a in AXES])
    return faces.join(inner, ["nx", "ny", "nz"], "left_anti").groupBy("side").agg(F.count(F.lit(1)).alias("faces"))


def overlays(points: DataFrame, a_limit: float, b_limit: float) -> DataFrame:
    """Sizes of A only, B only, both and neither: A above a_limit, B on an even plane above b_limit."""
    a, b = F.col("v") > a_limit, (F.col("z") % 2 == 0) & (F.col("v") > b_limit)
    name = F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("neither")
    return points.groupBy(name.alias("region")).agg(F.count(F.lit(1)).alias("count"))


def tile_plan(points: DataFrame, sizes: dict[str, int], tile: int) -> DataFrame:
    """Tiles that cover the lattice, the last of an axis ragged: key, origin and shape."""
    spark = points.sparkSession
    out = spark.range(-(-sizes["z"] // tile)).select((F.col("id") * tile).cast("int").alias("z0"))
    for a in ("y", "x"):
        out = out.withColumn(f"{a}0", F.explode(F.sequence(F.lit(0), F.lit(max(sizes[a] - 1, 0)), F.lit(tile))))
    shape = [F.least(F.lit(tile), F.lit(sizes[a]) - F.col(f"{a}0")).cast("int").alias(f"n{a}") for a in AXES]
    key = F.format_string("x%04d_y%04d_z%04d", "x0", "y0", "z0")
    return out.select(key.alias("tile_key"), "x0", "y0", "z0", *shape)


def tiles_in_request(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """(request_key, tile_key) for each tile that lies wholly in a request; both as from tile_plan.

    Requests are regular, so a tile's only candidate follows from its origin by division: a join by key.
    """
    width = requests.agg(*[F.max(f"n{a}").alias(a) for a in AXES]).first()
    r = requests.select(F.col("tile_key").alias("request_key"), *[F.col(f"{a}0").alias(f"r_{a}0") for a in AXES], *[F.col(f"n{a}").alias(f"r_n{a}") for a in AXES])
    t = tiles.withColumns({f"r_{a}0": (F.floor(F.col(f"{a}0") / (width[a] or 1)) * (width[a] or 1)).cast("int") for a in AXES})
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(f"{a}0") + F.col(f"n{a}") <= F.col(f"r_{a}0") + F.col(f"r_n{a}"))
    return t.join(r, [f"r_{a}0" for a in AXES]).where(inside).select("request_key", "tile_key")


def tile_status(points: DataFrame, sizes: dict[str, int], tile: int) -> DataFrame:
    """Plan against data: each tile verified if it holds exactly its points, else partial or missing."""
    at = lambda a: (F.floor(F.col(a) / tile) * tile).cast("int")
    have = points.groupBy(*[at(a).alias(f"{a}0") for a in AXES]).agg(F.count(F.lit(1)).alias("found"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s"))
    d = tile_plan(points, sizes, tile).join(have, ["x0", "y0", "z0"], "left")
    wanted = F.col("nx") * F.col("ny") * F.col("nz")
    status = F.when(F.col("found") == wanted, "verified").when(F.col("found").isNull(), "missing").otherwise("partial")
    return d.select("tile_key", wanted.cast("bigint").alias("expected_points"), F.coalesce("found", F.lit(0)).alias("found"), status.alias("status"), "lo", "hi", clean(F.col("s"), 3).alias("sum"))


def halo_dependencies(points: DataFrame, sizes: dict[str, int], tile: int, halo: int = 2) -> DataFrame:
    """For each tile of the z axis that holds data, the tiles its halo needs (periodic)."""
    n, last = sizes["z"], -(-sizes["z"] // tile)
    have = points.select(F.floor(F.col("z") / tile).cast("int").alias("tile")).distinct()
    reach = F.sequence(F.col("tile") * tile - halo, F.least((F.col("tile") + 1) * tile, F.lit(n)) - 1 + halo)
    needs = F.array_distinct(F.transform(reach, lambda z: F.floor(F.pmod(z, F.lit(n)) / tile).cast("int")))
    return have.where(F.col("tile") < last).select("tile", F.explode(needs).alias("needs"))
