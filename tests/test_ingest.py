import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from fieldspark.sources import ingest, results


@pytest.fixture
def store(spark, tmp_path):
    return results.Store(spark, str(tmp_path / "results"))


def plan_of(spark, n=12, rows=50):
    return spark.range(n).select(F.col("id").cast("int").alias("tile"), F.lit(rows).cast("bigint").alias("rows"))


def source(asked=None, short=(), broken=(), nan=()):
    """Rows of tiles; `short` tiles lack a row, `nan` ones hold a NaN; any `broken` tile fails the job."""

    def read(tiles):
        mine = [r["tile"] for r in tiles.collect()]
        if asked is not None:
            asked.append(sorted(mine))
        if set(mine) & set(broken):
            raise OSError("the source does not answer")
        d = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("k"))
        d = d.where(~(F.col("tile").isin(list(short) or [-1]) & (F.col("k") == 3)))
        bad = F.col("tile").isin(list(nan) or [-1]) & (F.col("k") == 5)
        return d.withColumn("v", F.when(bad, F.lit(math.nan)).otherwise(F.sin(F.col("tile") * 100 + F.col("k"))))

    return read


def test_an_ingest_asks_only_for_what_is_missing(spark, store):
    plan, asked = plan_of(spark), []
    job = ingest.Ingest(store, "tiles", ("tile",), ("v",))
    with pytest.raises(ingest.Incomplete) as error:
        job.run(plan, source(asked, short=[2], nan=[7]), attempts=2)
    assert asked == [list(range(12)), [2, 7]]
    assert {r["tile"]: r["status"] for r in error.value.states.collect()} == {2: "short", 7: "invalid"}
    assert job.rows(plan).select("tile").distinct().count() == 10
    got = job.run(plan, source(asked), attempts=2)
    assert asked[2:] == [[2, 7]]
    want = source()(plan)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() == 600
    assert job.run(plan, source(asked), attempts=2).count() == 600 and len(asked) == 3
    assert {r["status"] for r in job.states(plan).collect()} == {"verified"}


def test_a_batch_that_fails_costs_only_its_own_tiles(spark, store):
    plan, asked = plan_of(spark), []
    job = ingest.Ingest(store, "tiles", ("tile",))
    with pytest.raises(ingest.Incomplete):
        job.run(plan, source(asked, broken=[4]), attempts=1, batches=4)
    lost = next(a for a in asked if 4 in a)
    assert len(asked) > 1 and sorted(r["tile"] for r in job.pending(plan).collect()) == lost
    again = []
    assert job.run(plan, source(again), batches=4).count() == 600 and sorted(sum(again, [])) == lost
    with pytest.raises(ZeroDivisionError):  # other errors end the run
        ingest.Ingest(store, "other", ("tile",)).run(plan, lambda tiles: 1 / 0)


@pytest.mark.parametrize("step", ["rows", "ledger"])
def test_a_run_cut_off_leaves_nothing_that_counts(spark, store, monkeypatch, step):
    plan = plan_of(spark, 4)
    job = ingest.Ingest(store, "tiles", ("tile",))

    def cut(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "rows":
            m.setattr(ingest.Observation, "get", property(cut))  # rows are written, the check is not done
        else:
            m.setattr(job.store, "_fs", cut)  # the verdicts are written, not published
        with pytest.raises(KeyboardInterrupt):
            job._write(plan, source(), "run")
    assert job.history(plan).count() == 0 and job.pending(plan).count() == 4
    assert job.run(plan, source()).count() == 200


def test_odd_plans(spark, store):
    plan = plan_of(spark, 3)
    with pytest.raises(ValueError):
        ingest.Ingest(store, "a", ("tile",)).run(plan.unionByName(plan.limit(1)), source())
    twice = lambda tiles: source()(tiles).unionByName(source()(tiles).where("tile = 1"))
    with pytest.raises(ingest.Incomplete) as error:
        ingest.Ingest(store, "b", ("tile",)).run(plan, twice, attempts=1)
    assert [(r["tile"], r["status"]) for r in error.value.states.collect()] == [(1, "long")]
    with pytest.raises(ValueError):
        ingest.Ingest(store, "c", ("tile",)).run(plan.where("tile > 9"), source())
    names = [ingest.run_id(datetime(2024, 5, d, 6, 7, 8, tzinfo=UTC)) for d in (9, 10)]
    assert names == sorted(names) and names[0] == "20240509T060708Z"


def test_a_ladder_of_results_is_merged_and_opened_with_its_labels(spark, store):
    points = spark.range(1000).select(F.col("id").alias("k"))
    for w in (2, 4, 8):
        store.write(points.withColumn("v", F.sin(F.col("k") * w)), f"w{w}", "one-input")
    ingest.publish_ladder(store, "ladder", {2: "w2", 4: "w4"})
    assert set(ingest.publish_ladder(store, "ladder", {8: "w8"})["members"]) == {"2", "4", "8"}
    rows = ingest.open_ladder(store, "ladder", "width")
    got = {r["width"]: r for r in ingest.shares_by(rows, "width", "v").collect()}
    for w in (2.0, 4.0, 8.0):
        v = [math.sin(k * w) for k in range(1000)]
        rms = math.sqrt(sum(x * x for x in v) / 1000)
        r = got[w]
        assert r["count"] == 1000 and r["rms"] == pytest.approx(rms) and r["mean_over_rms"] == pytest.approx(sum(v) / 1000 / rms)
        assert r["below"] == pytest.approx(sum(x < 0 for x in v) / 1000) and r["beyond_1_rms"] == pytest.approx(sum(abs(x) > rms for x in v) / 1000)
    store.write(points.withColumn("v", F.cos("k")), "foreign", "another-input")
    with pytest.raises(ValueError):
        ingest.publish_ladder(store, "ladder", {16: "foreign"})
    assert ingest.open_ladder(store, "ladder", "width").count() == 3000
    store.write(points.withColumn("v", F.cos("k")), "w4", "another-input")
    with pytest.raises(ValueError):
        ingest.open_ladder(store, "ladder", "width")


def test_a_frame_is_reused_or_made_and_a_chain_is_made_anew(spark, store, tmp_path):
    plan, asked = plan_of(spark, 4), []
    make = lambda rows: rows.groupBy("tile").agg(F.round(F.sum("v"), 6).alias("total"))
    one = ingest.single_frame(store, "frame", "h1", plan, source(asked), make, ("tile",), ("v",))
    assert one.count() == 4 and len(asked) == 1
    assert ingest.single_frame(store, "frame", "h1", plan, source(asked), make, ("tile",), ("v",)).count() == 4 and len(asked) == 1
    store.write(store.open("frame").agg(F.round(F.sum("total"), 4).alias("all")), "sum", "h1", ("frame",))
    other = results.Store(spark, str(tmp_path / "anew"))
    makers = {"frame": lambda s: make(source()(plan)), "sum": lambda s: s.open("frame").agg(F.round(F.sum("total"), 4).alias("all"))}
    states = lambda d: [(r["name"], r["outcome"]) for r in d.orderBy("nth").collect()]
    assert states(ingest.rebuild(store, other, "sum", makers)) == [("frame", "planned"), ("sum", "planned")] and other.manifest("sum") is None
    assert states(ingest.rebuild(store, other, "sum", makers, True)) == [("frame", "equal"), ("sum", "equal")]
    third = results.Store(spark, str(tmp_path / "third"))
    makers["frame"] = lambda s: make(source(short=[1])(plan))
    assert states(ingest.rebuild(store, third, "sum", makers, True))[0] == ("frame", "differs")
    with pytest.raises(ValueError):
        ingest.rebuild(store, third, "sum", {"sum": makers["sum"]})
    with pytest.raises(ValueError):
        ingest.rebuild(store, store, "sum", makers)
