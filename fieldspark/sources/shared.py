"""Tables in the folder that the driver and all executors share, and dense numbers without a sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where one machine runs everything, a temporary folder stands in for it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fieldspark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet to the shared folder and read again, so nothing after it computes it anew."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with dense numbers from 0 in a column `name`: rows are counted where they lie, and each partition starts after those before it.

    The driver gets a row for each partition; no row moves.
    """
    bits = 33  # of a row's place within its partition, in monotonically_increasing_id
    kept = stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, bits).cast("int")
    counts = sorted(tuple(r) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start bigint"))
    dense = F.col("__start") + F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    return kept.withColumn("__part", part).join(offsets, "__part").withColumn(name, dense).select(*df.columns, name)
