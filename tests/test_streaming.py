from pathlib import Path

from pyspark.sql import functions as F

from fieldspark.streaming import follow, stateful


def test_follow_computes_ready_tiles_once_and_again_after_a_change(spark, tmp_path):
    tiles, state = str(tmp_path / "tiles"), str(tmp_path / "state")
    needs = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)], "tile int, needs int")

    def publish(rows):
        spark.createDataFrame(rows, follow.TILE_SCHEMA).coalesce(1).write.mode("append").parquet(tiles)
        follow.follow(spark, tiles, needs, state, snapshot_every=2).awaitTermination(120)
        return {r["tile"]: r["total"] for r in follow.current(spark, state).collect()}

    assert publish([(0, "a", 1.0), (1, "b", 2.0)]) == {0: 3.0}
    assert publish([(2, "c", 4.0)]) == {0: 3.0, 1: 7.0}
    versions = spark.read.parquet(state + "/results/changes").count()
    assert versions == 2
    assert publish([(1, "b2", 5.0)]) == {0: 6.0, 1: 10.0}
    assert publish([(0, "a", 1.0)]) == {0: 6.0, 1: 10.0}  # nothing changed, so nothing is computed
    assert spark.read.parquet(state + "/results/changes").count() == 4
    assert spark.read.parquet(state + "/tiles/snapshots/upto=2").count() == 3
    assert publish([(2, "c2", 1.0)]) == {0: 6.0, 1: 7.0}


def _publisher(spark, tmp_path, timeout_ms=600_000):
    tiles, state = str(tmp_path / "tiles"), str(tmp_path / "state")
    needs = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)], "tile int, needs int")

    def now(status="computed"):
        if not Path(state, "results").exists():
            return {}
        return {r["tile"]: r["total"] if status == "computed" else (r["present"], r["wanted"]) for r in stateful.current(spark, state).where(F.col("status") == status).collect()}

    def publish(rows, want, status="computed"):
        """Each call is a restart of the query, which is stopped once it shows what is wanted."""
        spark.createDataFrame(rows, follow.TILE_SCHEMA).coalesce(1).write.mode("append").parquet(tiles)
        query = stateful.follow(spark, tiles, needs, state, timeout_ms)
        assert not stateful.stop_when(query, lambda: now(status) == want, 0.5, 60)
        assert now(status) == want

    return publish, state


def test_state_outlives_restarts_and_only_changed_tiles_are_computed(spark, tmp_path):
    publish, state = _publisher(spark, tmp_path)
    publish([(0, "a", 1.0), (1, "b", 2.0)], {0: 3.0})
    publish([(0, "a", 1.0), (2, "c", 4.0)], {0: 3.0, 1: 7.0})
    publish([(1, "b2", 5.0)], {0: 6.0, 1: 10.0})
    row = stateful.current(spark, state).where("tile = 1").first()
    assert row["signature"] == stateful.signature([(0, "a"), (1, "b2"), (2, "c")])
    assert (row["present"], row["wanted"]) == (3, 3)
    assert spark.read.parquet(state + "/results").where("status = 'computed'").count() == 4  # tile 0 was not computed again for an equal checksum


def test_a_tile_that_waits_too_long_is_stalled_and_computed_later(spark, tmp_path):
    publish, _ = _publisher(spark, tmp_path, 1500)
    publish([(0, "a", 1.0)], {0: (1, 2), 1: (1, 3)}, "stalled")
    publish([(1, "b", 2.0), (2, "c", 4.0)], {0: 3.0, 1: 7.0})
