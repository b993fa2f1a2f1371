"""Blocks with ghost layers: one shuffle gives each block all its stencils need (X9, D10), with signatures of what it depends on; hash trees over tiles (S15, T5, G33)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def _places(blocks: Column, at: Column, width: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(b.cast("int").alias("b"), (at - b * width).cast("int").alias("p")))


def _ghosts(near: Column, axis: str, own: dict[str, Column], size: int, width: int) -> Column:
    """The places of near that lie beyond their block, as places of all axes."""
    beyond = F.filter(near, lambda s: (s["p"] < 0) | (s["p"] >= F.least(F.lit(width), size - s["b"] * width)))
    return F.transform(beyond, lambda s: F.struct(*[(s if k == axis else own[k]).alias(k) for k in AXES]))


def _near(axis: str, size: int, width: int, halo: int) -> Column:
    """[(block, place in it)] of each block of an axis that needs a point, its own first; places beyond the block are its ghosts."""
    found = []
    turns = math.ceil(halo / size)
    for turn in (0, *(t for k in range(1, turns + 1) for t in (-k, k))):
        at = F.col(axis) + turn * size
        clamped = lambda p: F.greatest(F.least(F.floor(p / width), F.lit((size - 1) // width)), F.lit(0))
        blocks = F.sequence(clamped(at - halo), clamped(at + halo))
        found.append(F.filter(_places(blocks, at, width), lambda s: (s["p"] >= -halo) & (s["p"] < F.least(F.lit(width), size - s["b"] * width) + halo)))
    return F.concat(*found)


def _own(axis: str, width: int) -> Column:
    return F.struct(F.floor(F.col(axis) / width).cast("int").alias("b"), (F.col(axis) % width).cast("int").alias("p"))


def with_halo(points: DataFrame, sizes: dict[str, int], block: dict[str, int], halo: int, values: list[str]) -> DataFrame:
    """A row for each block that needs a point: bz, by, bx, pz, py, px, values; places count from the block's first point.

    Ghosts lie in a block's direct continuation along each axis, `halo` deep, periodic; corners are left out.
    """
    own = {a: _own(a, block[a]) for a in AXES}
    spots = [F.array(F.struct(*[own[a].alias(a) for a in AXES])), *(_ghosts(_near(a, sizes[a], block[a], halo), a, own, sizes[a], block[a]) for a in AXES)]
    d = points.select(*values, F.explode(F.concat(*spots)).alias("s"))
    return d.select(*[F.col(f"s.{a}.b").alias(f"b{a}") for a in AXES], *[F.col(f"s.{a}.p").alias(f"p{a}") for a in AXES], *values)


#: The fourth-order central difference, times 12 steps.
FD4 = {-2: 1.0, -1: -8.0, 1: 8.0, 2: -1.0}


def block_gradient(points: DataFrame, sizes: dict[str, int], block: dict[str, int], lengths: dict[str, float], only: DataFrame | None = None) -> DataFrame:
    """z, y, x, gx, gy, gz: the periodic fourth-order gradient of v along all axes, from one shuffle of blocks with two ghost layers.

    Last blocks may be ragged.  A place that is missing or repeated, or a v that is not finite, is an
    error.  lengths: of the box by axis.  only: (bz, by, bx) of the blocks to be done; others are not shuffled.
    """
    halo = 2
    if any(block[a] < 1 for a in AXES):
        raise ValueError("blocks must have a point in each direction")
    d = with_halo(points, sizes, block, halo, ["v"])
    if only is not None:
        d = d.join(only.select(*[f"b{a}" for a in AXES]).distinct(), [f"b{a}" for a in AXES], "left_semi")

    def gradient(rows: pd.DataFrame) -> pd.DataFrame:
        at = [int(rows[f"b{a}"].iloc[0]) for a in AXES]
        shape = [min(block[a], sizes[a] - b * block[a]) for a, b in zip(AXES, at, strict=True)]
        outer = [n + 2 * halo for n in shape]
        place = np.ravel_multi_index([rows[f"p{a}"].to_numpy() + halo for a in AXES], outer)
        hits = np.bincount(place, minlength=math.prod(outer))
        cube = np.full(math.prod(outer), np.nan)
        cube[place] = rows.v.to_numpy()
        core = [slice(halo, halo + n) for n in shape]
        cube, hits = cube.reshape(outer), hits.reshape(outer)
        needed = np.zeros(outer, bool)
        for k, n in enumerate(outer):
            needed[tuple(slice(0, n) if j == k else s for j, s in enumerate(core))] = True
        if (hits[needed] != 1).any():
            raise ValueError(f"block {at} has missing or repeated points")
        if not np.isfinite(cube[needed]).all():
            raise ValueError(f"block {at} has values that are not finite")
        out = {}
        for k, a in enumerate(AXES):
            parts = [w * cube[tuple(slice(s.start + o, s.stop + o) if j == k else s for j, s in enumerate(core))] for o, w in FD4.items()]
            out[f"g{a}"] = (sum(parts[1:], parts[0]) / (12 * lengths[a] / sizes[a])).ravel()
        places = np.indices(shape, np.int32)
        for k, a in enumerate(AXES):
            out[a] = (places[k] + at[k] * block[a]).ravel()
        return pd.DataFrame(out)[["z", "y", "x", "gx", "gy", "gz"]]

    return d.groupBy(*[f"b{a}" for a in AXES]).applyInPandas(gradient, "z int, y int, x int, gx double, gy double, gz double")


def _axis_needs(spark: SparkSession, axis: str, size: int, width: int, tile: int, halo: int) -> DataFrame:
    """(block, first place of a tile) of an axis: the tiles that a block and its ghosts touch."""
    reach = F.sequence(F.col("b") * width - halo, F.least((F.col("b") + 1) * width, F.lit(size)) - 1 + halo)
    origins = F.array_distinct(F.transform(reach, lambda p: (F.floor(F.pmod(p, F.lit(size)) / tile) * tile).cast("int")))
    return spark.range(-(-size // width)).select(F.col("id").cast("int").alias("b")).select(F.col("b").alias(f"b{axis}"), F.explode(origins).alias(f"{axis}0"))


def block_needs(spark: SparkSession, sizes: dict[str, int], block: dict[str, int], tile: dict[str, int], halo: int = 2) -> DataFrame:
    """bz, by, bx, tile_key: the producer's tiles that intersect each block and its periodic halo, by axis and then all combinations."""
    parts = [_axis_needs(spark, a, sizes[a], block[a], tile[a], halo) for a in AXES]
    d = parts[0].join(F.broadcast(parts[1]), how="cross").join(F.broadcast(parts[2]), how="cross")  # a few thousand rows by axis at most
    return d.select(*[f"b{a}" for a in AXES], F.format_string("x%04d_y%04d_z%04d", "x0", "y0", "z0").alias("tile_key"))


def block_signatures(needs: DataFrame, checksums: DataFrame) -> DataFrame:
    """bz, by, bx, signature of each block all of whose tiles (tile_key, sha) are published: a hash of their keys and checksums in order."""
    by = needs.join(checksums.select("tile_key", "sha"), "tile_key", "left").groupBy(*[f"b{a}" for a in AXES])
    d = by.agg(F.count_if(F.col("sha").isNull()).alias("absent"), F.array_sort(F.collect_list(F.struct("tile_key", "sha"))).alias("of"))
    text = F.array_join(F.transform("of", lambda s: F.concat(s["tile_key"], F.lit(":"), s["sha"])), ",")
    return d.where("absent = 0").select(*[f"b{a}" for a in AXES], F.sha2(text, 256).alias("signature"))


def stale_blocks(signatures: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks whose signature is not the one they were last computed under."""
    keys = [f"b{a}" for a in AXES]
    return signatures.join(done.select(*keys, "signature"), [*keys, "signature"], "left_anti").select(*keys)


# --- hash trees ---------------------------------------------------------------------------------


def tile_hashes(points: DataFrame, tile: dict[str, int], value: str = "v", text: Column | None = None) -> DataFrame:
    """level 0 of a hash tree: tz, ty, tx, points, hash: sha256 over a tile's places and values in order.

    text: how a value is written, by default in 17 significant digits, so any other double changes the
    hash; null has a text of its own.  A tile's points are the only ones a task holds together.
    """
    written = text if text is not None else F.format_string("%.16e", F.col(value).cast("double"))
    line = F.concat_ws(",", *AXES, F.coalesce(written, F.lit("null")))
    at = [F.floor(F.col(a) / tile[a]).cast("int").alias(f"t{a}") for a in AXES]
    d = points.select(*at, F.struct(*AXES).alias("place"), line.alias("line")).groupBy("tz", "ty", "tx").agg(F.count(F.lit(1)).alias("points"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("all"))
    return d.select(F.lit(0).alias("level"), "tz", "ty", "tx", "points", F.sha2(F.array_join(F.col("all.line"), ";"), 256).alias("hash"))


def hash_tree(leaves: DataFrame) -> DataFrame:
    """All levels: level, tz, ty, tx, points, hash.  A node holds the hashes of up to 2 x 2 x 2 below it, in order; the last level is one node."""
    top = leaves.agg(F.max(F.greatest("tz", "ty", "tx")).alias("m")).first()["m"] or 0
    out = level = leaves
    for k in range(1, top.bit_length() + 1):
        below = F.array_sort(F.collect_list(F.struct("tz", "ty", "tx", "hash")))
        level = level.groupBy(*[F.floor(F.col(f"t{a}") / 2).cast("int").alias(f"n{a}") for a in AXES]).agg(F.sum("points").alias("points"), below.alias("x"))
        level = level.select(F.lit(k).alias("level"), *[F.col(f"n{a}").alias(f"t{a}") for a in AXES], "points", F.sha2(F.array_join(F.col("x.hash"), ","), 256).alias("hash"))
        out = out.unionByName(level)
    return out


def changed_tiles(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """tz, ty, tx of level 0 whose hashes differ or are on one side only, found by descending from the top: a level joins only what differs above it."""
    top = max(ours.agg(F.max("level")).first()[0] or 0, theirs.agg(F.max("level")).first()[0] or 0)
    keys, going = ["tz", "ty", "tx"], None
    for level in range(top, -1, -1):
        pick = lambda d, n, level=level: d.where(F.col("level") == level).select(*keys, F.col("hash").alias(n))
        a, b = pick(ours, "a"), pick(theirs, "b")
        if going is not None:
            up = [F.floor(F.col(k) / 2).cast("int") for k in keys]
            under = lambda d: d.join(going, [u == F.col(f"up_{k}") for u, k in zip(up, keys, strict=True)], "left_semi")  # noqa: E731, B023
            a, b = under(a), under(b)
        differ = a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)
        going = differ.select(*[F.col(k).alias(f"up_{k}") for k in keys])
        if level and not differ.limit(1).count():
            return differ.where("false")
    return differ
