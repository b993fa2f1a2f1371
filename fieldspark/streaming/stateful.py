"""Follow-up with state by output tile: transformWithState holds what each tile has of its dependencies, and timers tell of tiles that wait too long (T1, T2).

A publication is sent to the output tiles that need it; each holds the newest checksum and total of its
dependencies in a map state, computes when all are there and their signature is a new one, and sets a
timer while it waits.  State lives in the checkpoint, so a restart goes on where it stopped, and no
table of earlier results is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fieldspark.streaming.follow import TILE_SCHEMA

#: status: computed, or stalled for a tile whose dependencies made no progress for the timeout.
RESULT_SCHEMA = "tile int, status string, signature string, total double, present int, wanted int"
#: The state store that keeps these kinds of state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def signature(parts: list[tuple[int, str]]) -> str:
    """Of dependencies and their checksums, in order."""
    return hashlib.sha256(",".join(f"{n}:{sha}" for n, sha in sorted(parts)).encode()).hexdigest()


class _Tile(StatefulProcessor):
    """One output tile: its dependencies so far, what it was last computed under, and the timer of its wait."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "needs int", "sha string, total double")
        self.done = handle.getValueState("done", "signature string")
        self.wait = handle.getValueState("wait", "timer bigint, wanted int")

    def _row(self, tile: int, status: str, sign: str | None, total: float | None, present: int, wanted: int) -> pd.DataFrame:
        return pd.DataFrame({"tile": [tile], "status": [status], "signature": [sign], "total": [total], "present": [present], "wanted": [wanted]})

    def _clear_timer(self) -> None:
        if self.wait.exists():
            self.handle.deleteTimer(self.wait.get()[0])
            self.wait.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted, changed = 0, False
        for batch in rows:
            # Of several publications of one tile in a batch the greatest checksum counts, so that a repeated batch gives the same.
            for needs, sha, total, n in batch.sort_values("sha")[["needs", "sha", "total", "wanted"]].itertuples(index=False):
                wanted = int(n)
                known = self.parts.getValue((int(needs),)) if self.parts.containsKey((int(needs),)) else None
                if known is None or known[0] != sha:
                    self.parts.updateValue((int(needs),), (sha, float(total)))
                    changed = True
        if not changed:
            return
        parts = [(k[0], v[0], v[1]) for k, v in self.parts.iterator()]
        self._clear_timer()
        if len(parts) < wanted:
            at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(at)
            self.wait.update((at, wanted))
            return
        sign = signature([(n, sha) for n, sha, _ in parts])
        if not self.done.exists() or self.done.get()[0] != sign:
            self.done.update((sign,))
            yield self._row(key[0], "computed", sign, sum(t for _, _, t in sorted(parts)), len(parts), wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wanted = self.wait.get()[1] if self.wait.exists() else 0
        self.wait.clear()
        yield self._row(key[0], "stalled", None, None, sum(1 for _ in self.parts.iterator()), wanted)

    def close(self) -> None:
        pass


def results(spark: SparkSession, tiles_path: str, needs: DataFrame, timeout_ms: int = 1_800_000) -> DataFrame:
    """A stream of RESULT_SCHEMA rows.  needs: tile, needs, one row for each dependency of an output tile."""
    wanted = needs.groupBy("tile").agg(F.count(F.lit(1)).cast("int").alias("wanted"))
    fan = needs.join(wanted, "tile").select("tile", "needs", "wanted")
    published = spark.readStream.schema(TILE_SCHEMA).parquet(tiles_path).select(F.col("tile").alias("needs"), "sha", "total")
    each = published.join(fan, "needs").select("tile", "needs", "sha", "total", "wanted")
    return each.groupBy("tile").transformWithStateInPandas(_Tile(timeout_ms), outputStructType=RESULT_SCHEMA, outputMode="Update", timeMode="ProcessingTime")


def follow(spark: SparkSession, tiles_path: str, needs: DataFrame, state_path: str, timeout_ms: int = 1_800_000, every: str = "1 second") -> StreamingQuery:
    """Starts the query: its rows go to `results` under state_path, one folder for each micro-batch with rows, which a repeated batch overwrites.

    Timers need batches without data too, so the query runs until it is stopped; see stop_when.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def put(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{state_path}/results/epoch={epoch}")

    writer = results(spark, tiles_path, needs, timeout_ms).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state_path}/checkpoint")
    return writer.trigger(processingTime=every).start()


def stop_when(query: StreamingQuery, stop, every_s: float = 0.5, timeout_s: float | None = None) -> bool:
    """Waits until the query ends, or stop() says so or the time is over, and then stops it; True if it ended by itself."""
    waited = 0.0
    while not query.awaitTermination(every_s):
        waited += every_s
        if stop() or (timeout_s is not None and waited >= timeout_s):
            query.stop()
            return False
    return True


def current(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest row of each tile, with its epoch."""
    d = spark.read.schema(f"{RESULT_SCHEMA}, epoch bigint").parquet(f"{state_path}/results")
    newest = d.groupBy("tile").agg(F.max_by(F.struct(*[c for c in d.columns if c != "tile"]), "epoch").alias("r"))
    return newest.select("tile", "r.*")
