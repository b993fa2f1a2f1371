"""Field views over the tables: bags of points, dense lattices, vectors, and cubes in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bag_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as unordered points: work_full, work_resolved, pi, s_bar, q, u2 and frame."""
    d = table(spark, sf_dir, "lineitem")
    wf = F.col("l_quantity") - 25
    wr = (F.col("l_discount") - F.lit(0.05)) * 100
    pi = (F.col("l_extendedprice") - 50000) / F.lit(1e4)
    return d.select(
        wf.alias("work_full"), wr.alias("work_resolved"), pi.alias("pi"), (wf - wr + pi).alias("s_bar"),
        pi.alias("q"), (wf * wf / 100).alias("u2"), F.year("l_shipdate").alias("frame"),
    )


BAG_SQL = """bag AS (
  SELECT l_quantity - 25 AS work_full, (l_discount - 0.05::double) * 100 AS work_resolved,
         (l_extendedprice - 50000) / 1e4 AS pi,
         l_quantity - 25 - (l_discount - 0.05::double) * 100 + (l_extendedprice - 50000) / 1e4 AS s_bar,
         (l_extendedprice - 50000) / 1e4 AS q, (l_quantity - 25) * (l_quantity - 25) / 100 AS u2,
         year(l_shipdate) AS frame
  FROM lineitem)"""


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a dense lattice 10 x 10 x nz with the value v."""
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.floor(i / 100).cast("int").alias("z"), (F.floor(i / 10) % 10).cast("int").alias("y"), (i % 10).cast("int").alias("x"),
        F.col("o_totalprice").alias("v"))


LATTICE_SQL = """lattice AS (
  SELECT (o_orderkey // 100)::INTEGER AS z, ((o_orderkey // 10) % 10)::INTEGER AS y, (o_orderkey % 10)::INTEGER AS x,
         o_totalprice AS v FROM orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points with a velocity u, a pressure gradient g, the power q and u2."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("frame"), *[e(k).alias(n) for k, n in enumerate(("ux", "uy", "uz", "gx", "gy", "gz"), 1)])
    return d.withColumn("q", -(F.col("ux") * F.col("gx") + F.col("uy") * F.col("gy") + F.col("uz") * F.col("gz"))).withColumn("u2", F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))


VECTORS_SQL = """vectors AS (
  SELECT *, -(ux*gx + uy*gy + uz*gz) AS q, ux*ux + uy*uy + uz*uz AS u2 FROM (
    SELECT vec_id, label AS frame, embedding[1]::double AS ux, embedding[2]::double AS uy, embedding[3]::double AS uz,
           embedding[4]::double AS gx, embedding[5]::double AS gy, embedding[6]::double AS gz FROM embeddings))"""


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one periodic 4 x 4 x 4 cube of doubles in each row: frame, cube (z-major)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("cube"))


CUBES_SQL = """cells AS (
  SELECT vec_id AS frame, (i - 1)::INTEGER AS p, ((i - 1) // 16)::INTEGER AS z, (((i - 1) // 4) % 4)::INTEGER AS y, ((i - 1) % 4)::INTEGER AS x,
         embedding[i]::double AS v
  FROM embeddings, range(1, 65) r(i))"""
