"""Incremental follow-up of a producer's tiles: T1-T3, T5, as Structured Streaming.

A file source watches the tile folder.  Each micro-batch upserts the newest checksum of its
tiles, finds the output tiles whose whole halo is now present and whose dependencies differ
from those last computed, and appends their results.  State lives in Parquet tables in the
state folder, so a restart goes on where it stopped and repeats nothing that is current.
Each micro-batch has a folder of its own, which a repeated batch overwrites; every so many
batches the newest row of each tile becomes a snapshot, and only what came after it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE_SCHEMA = "tile int, sha string, total double"
RESULT_SCHEMA = "tile int, signature string, total double"
#: Micro-batches between two snapshots.
SNAPSHOT_EVERY = 20


class _Table:
    """Rows by epoch in `changes/epoch=N`, and snapshots of the newest rows in `snapshots/upto=N`."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _numbers(self, folder: str) -> list[int]:
        """Epochs of the folders that are whole."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if fs.exists(path(s.getPath(), "_SUCCESS")))

    def put(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/epoch={epoch}")

    def read(self) -> DataFrame:
        """The newest row of each tile, with its epoch."""
        snapshots = self._numbers("snapshots")
        after = snapshots[-1] if snapshots else -1
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/changes/epoch={e}").withColumn("epoch", F.lit(e).cast("bigint")) for e in self._numbers("changes") if e > after]
        if snapshots:
            parts.append(self.spark.read.schema(f"{self.schema}, epoch bigint").parquet(f"{self.path}/snapshots/upto={after}"))
        out = self.spark.createDataFrame([], f"{self.schema}, epoch bigint")
        for part in parts:
            out = out.unionByName(part)
        return _latest(out)

    def snapshot(self, epoch: int) -> None:
        self.read().write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={epoch}")


def _latest(rows: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("epoch")))
    return rows.withColumn("newest", newest).where("newest = 1").drop("newest")


def ready_tiles(present: DataFrame, needs: DataFrame) -> DataFrame:
    """Output tiles with all needed tiles present: tile, signature of the dependencies, their total.

    present: tile, sha, total; needs: tile, needs (one row per dependency).
    """
    have = present.select(F.col("tile").alias("needs"), "sha", "total")
    d = needs.join(have, "needs", "left").groupBy("tile").agg(
        F.count_if(F.col("sha").isNull()).alias("absent"), F.array_sort(F.collect_list(F.struct("needs", "sha"))).alias("from"), F.sum("total").alias("total"))
    return d.where("absent = 0").select("tile", F.sha2(F.to_json("from"), 256).alias("signature"), "total")


def follow(spark: SparkSession, tiles_path: str, needs: DataFrame, state_path: str, available_now: bool = True, snapshot_every: int = SNAPSHOT_EVERY):
    """Start the query; `current` has the results."""
    tiles, results = _Table(spark, f"{state_path}/tiles", TILE_SCHEMA), _Table(spark, f"{state_path}/results", RESULT_SCHEMA)

    def step(batch: DataFrame, epoch: int) -> None:
        tiles.put(_newest_of_batch(batch), epoch)
        done = results.read().select("tile", "signature")
        fresh = ready_tiles(tiles.read(), needs).join(done, ["tile", "signature"], "left_anti")
        results.put(fresh, epoch)
        if epoch and epoch % snapshot_every == 0:
            tiles.snapshot(epoch)
            results.snapshot(epoch)

    stream = spark.readStream.schema(TILE_SCHEMA).parquet(tiles_path)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def _newest_of_batch(batch: DataFrame) -> DataFrame:
    """One row per tile; of several in one batch the one with the greatest checksum, so a repeated batch gives the same."""
    return batch.groupBy("tile").agg(F.max_by(F.struct("sha", "total"), "sha").alias("r")).select("tile", "r.sha", "r.total")


def current(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest result of each tile."""
    return _Table(spark, f"{state_path}/results", RESULT_SCHEMA).read()
