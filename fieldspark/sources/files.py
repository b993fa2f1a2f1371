"""Files in and out: NumPy arrays, CSV with required columns, JSON reports, cut-outs in canonical form, sizes ahead of a run: S4, S5, S16, S18, S20-S22, A2."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators.gates import require_finite

#: Rows of one Arrow batch.
_ROWS = 1 << 16


def read_npy(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Points of 3-D arrays in .npy files, or of one array of .npz files: file, z, y, x, v.

    Each file is one task's work and its values leave it in small batches.  An array of another
    dimension, or a missing key, fails.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                loaded = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                array = loaded if isinstance(loaded, np.ndarray) else loaded[key]
                if array.ndim != 3:
                    raise ValueError(f"{name} has {array.ndim} dimensions, not 3")
                flat = np.ascontiguousarray(array).reshape(-1)
                for lo in range(0, len(flat), _ROWS):
                    at = np.arange(lo, min(lo + _ROWS, len(flat)))
                    z, y, x = (k.astype(np.int32) for k in np.unravel_index(at, array.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(z), pa.array(y), pa.array(x), pa.array(flat[at].astype(np.float64))], ["file", "z", "y", "x", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(batches, "file string, z int, y int, x int, v double")


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV with a header under a schema; missing columns are an error before any row is read, bad rows while they are."""
    found = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in found]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    d = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return d.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in found if c in kinds])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; single puts a small table into one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def read_reports(spark: SparkSession, pattern: str, schema: str, **equal) -> DataFrame:
    """JSON reports, one object in each file, under a schema: those whose fields have the given values, with their path."""
    d = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())
    for column, value in equal.items():
        d = d.where(F.col(column) == F.lit(value))
    return d


def canonical_cutout(values: DataFrame, components: dict[int, str]) -> DataFrame:
    """(z, y, x, c, v) rows -> one row per place with a column for each component; a value that is missing or not finite fails."""
    wide = values.groupBy("z", "y", "x").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in components.items()])
    return require_finite(wide, *components.values())


def sub_block(points: DataFrame, origin: dict[str, int], shape: dict[str, int]) -> DataFrame:
    """The points of a block, with places counted from its origin."""
    d = points
    for a, lo in origin.items():
        d = d.where(F.col(a).between(lo, lo + shape[a] - 1))
    return d.withColumns({a: (F.col(a) - lo).cast("int") for a, lo in origin.items()})


def resource_plan(spark: SparkSession, sizes: dict[str, int], fields: dict[str, tuple[int, int]], frames: int, widths: int, bytes_each: int = 4) -> DataFrame:
    """Sizes ahead of a run: field, components, stride, points, bytes over all frames and filter widths.

    fields: components and sampling stride of each; an odd size keeps its first index, so it rounds up.
    """
    rows = [(n, c, s) for n, (c, s) in fields.items()]
    points = F.lit(1).cast("bigint")
    for n in sizes.values():
        points = points * F.ceil(F.lit(n) / F.col("stride")).cast("bigint")
    d = spark.createDataFrame(rows, "field string, components int, stride int").withColumn("points", points)
    return d.withColumn("bytes", F.col("points") * F.col("components") * bytes_each * frames * widths)
