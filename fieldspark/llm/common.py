"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that the text contracts name, as a character class.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir of the session.

    A temporary folder stands in for it in local mode only, where one machine runs everything;
    elsewhere a session without the setting is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fieldspark-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again.

    Unlike a checkpoint it keeps columns apart, so later scans read only what they need.
    The folder is appended to paths, for a caller that deletes it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.parquet(path)


def with_row_keys(df: DataFrame, name: str) -> DataFrame:
    """df with a column `name` of distinct longs, written to the shared checkpoint folder and read again.

    A row's key is drawn once, so every later scan sees the same one.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int):
    """Within it, Arrow batches on their way to Python hold about `most` bytes or one row (default: 64 MB or 10,000 rows).

    The JVM writes a batch outside its heap, and Python reads it whole.  It holds for queries that run within, not
    for DataFrames that are only made there.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{most}b")


def short_shuffles(spark: SparkSession):
    """Within it, shuffle files of a query go when the query ends, not when the driver happens to collect its garbage.

    For jobs of many small queries: each of their shuffles leaves two files or more a task.  A DataFrame
    made within and run twice computes its shuffles again.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_row(id_col: str, key: str):
    """What orders rows of a group: by id, null last, then by row key."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(key).alias("key"))


def crc_bucket(id_col: str, parts: int):
    """crc32 of the id's decimal text, modulo parts; null ids fall into bucket 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(parts), F.lit(0))


def sha256_hex(column):
    return F.sha2(column, 256)


def runs_of_rows(lengths: list[int | None], most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows): runs of rows with at most `most` characters together, or one row."""
    at = chars = 0
    for row, length in enumerate(lengths):
        if row > at and chars + (length or 0) > most:
            yield at, row - at
            at, chars = row, 0
        chars += length or 0
    if at < len(lengths):
        yield at, len(lengths) - at
