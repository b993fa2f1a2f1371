import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators import lattices
from fieldspark.sources import files, results


@pytest.fixture
def store(spark, tmp_path):
    return results.Store(spark, str(tmp_path / "results"))


def lattice(spark, n=6, seed=1.0):
    return spark.range(n ** 3).select((F.floor(F.col("id") / (n * n))).cast("int").alias("z"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), (F.sin(F.col("id") * seed)).alias("v"))


def test_a_result_is_written_once_and_opened_when_complete(spark, store):
    d = lattice(spark)
    got = store.write(d, "one", "hash-a")
    assert got.exceptAll(d).count() == 0 and got.count() == 216
    before = store.manifest("one")
    assert before["rows"] == 216 and before["fields"]["v"]["nonfinite"] == 0
    assert store.write(lattice(spark, seed=2.0), "one", "hash-a").exceptAll(d).count() == 0  # same input: nothing is written
    store.write(lattice(spark, seed=2.0), "one", "hash-b")
    assert store.manifest("one")["content_hash"] != before["content_hash"]
    store.open("one", verify=True)


def test_an_unfinished_or_changed_result_is_not_opened(spark, store):
    d = lattice(spark)
    d.write.parquet(f"{store.root}/half/data")
    with pytest.raises(ValueError):
        store.open("half")
    store.write(d, "whole")
    lattice(spark, seed=3.0).write.mode("append").parquet(f"{store.root}/whole/{store.manifest('whole')['folder']}")
    with pytest.raises(ValueError):
        store.open("whole", verify=True)
    other = store.manifest("whole") | {"version": 99}
    store._put(f"{store.root}/whole/manifest.json", json.dumps(other))
    with pytest.raises(ValueError):
        store.open("whole")


def test_content_hash_ignores_order_and_counts_repeats(spark):
    d = lattice(spark)
    base = results.content_metadata(d)["content_hash"]
    assert results.content_metadata(d.repartition(5).orderBy(F.desc("v")))["content_hash"] == base
    assert results.content_metadata(d.unionByName(d.limit(1)).unionByName(d.limit(1)))["content_hash"] != base
    assert results.content_metadata(d.where("v > 9"))["rows"] == 0


def test_content_hash_tells_where_nulls_are(spark):
    kind = "a int, b int"
    one, other = (results.content_metadata(spark.createDataFrame([row], kind))["content_hash"] for row in ((None, 5), (5, None)))
    assert one != other
    assert results.content_metadata(spark.createDataFrame([(None, None)], kind))["content_hash"] != results.content_metadata(spark.createDataFrame([], kind))["content_hash"]


def _same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("step", ["parents", "input", "read back", "rename", "manifest"])
def test_a_write_that_fails_leaves_the_former_result(spark, store, monkeypatch, step):
    d = lattice(spark)
    store.write(d, "one", "hash-a")
    new, parents, failure = lattice(spark, seed=2.0), (), OSError
    if step == "parents":
        parents, failure = ("nobody",), ValueError
    if step == "input":
        new, failure = new.withColumn("v", F.when(F.col("z") == 5, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v"))), Exception
    if step == "read back":
        real = store._rows
        monkeypatch.setattr(store, "_rows", lambda place, schema: real(place, schema).where("z > 0"))
    if step == "rename":
        monkeypatch.setattr(store, "_replace", lambda part, place: (_ for _ in ()).throw(OSError("rename")))
    if step == "manifest":
        monkeypatch.setattr(store, "_put", lambda path, text: (_ for _ in ()).throw(OSError("manifest")))
    with pytest.raises(failure):
        store.write(new, "one", "hash-b", parents)
    monkeypatch.undo()
    assert _same_rows(store.open("one", verify=True), d)
    assert store.manifest("one")["input_hash"] == "hash-a"
    store.write(new if step != "input" else lattice(spark, seed=2.0), "one", "hash-b")
    assert _same_rows(store.open("one", verify=True), lattice(spark, seed=2.0))
    store.tidy("one")
    assert _same_rows(store.open("one", verify=True), lattice(spark, seed=2.0))
    assert store.tidy("one") == []


def test_bucketed_results_join_without_a_shuffle(spark, store):
    keys = ("z", "y", "x")
    d = lattice(spark)
    more = {"a": d.withColumnRenamed("v", "a"), "b": d.withColumn("b", F.col("v") * 2).drop("v"), "c": d.withColumn("c", F.col("v") + 1).drop("v")}
    for name, rows in more.items():
        store.write(rows.repartition(3), name, "in", bucket_by=keys, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = store.composite(["a", "b", "c"], list(keys))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        by = both.groupBy(*keys).agg(F.sum("a").alias("s"))  # what is grouped by the keys needs no shuffle either
        assert "Exchange" not in by._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 216 and both.where("b <> 2 * a or c <> a + 1").count() == 0
        # A session that does not know the tables yet finds the buckets in the manifests.
        other = results.Store(spark.newSession(), store.root)
        for name in more:
            spark.sql(f"DROP TABLE {store._table(store.manifest(name)['folder'])}")
        again = other.composite(["a", "b"], list(keys))
        again.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        assert again.count() == 216
        store.write(d.withColumn("a", F.col("v") * 3).drop("v"), "a", "in2", bucket_by=keys, buckets=4)
        store.write(d.withColumn("a", F.col("v") * 4).drop("v"), "a", "in3", bucket_by=keys, buckets=4)
        assert store.open("a", verify=True).agg(F.sum("a")).first()[0] == pytest.approx(4 * d.agg(F.sum("v")).first()[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_readers_of_the_former_version_go_on(spark, store):
    former = store.write(lattice(spark), "one", "a")
    store.write(lattice(spark, seed=2.0), "one", "b", partition_by=("z",))
    assert _same_rows(former, lattice(spark))
    assert _same_rows(store.open("one", verify=True), lattice(spark, seed=2.0))


def test_the_input_is_computed_once(spark, store):
    met = spark.sparkContext.accumulator(0)

    def count(it):
        for batch in it:
            met.add(batch.num_rows)
            yield batch

    store.write(lattice(spark).mapInArrow(count, "z int, y int, x int, v double"), "one", "a")
    assert met.value == 216


def test_a_parent_written_again_with_the_same_rows_breaks_no_chain(spark, store):
    store.write(lattice(spark), "base")
    store.write(lattice(spark), "derived", parents=("base",))
    store.write(lattice(spark), "base")
    store.check_chain("derived")


def test_chain_catalog_and_composite(spark, store):
    d = lattice(spark)
    assert store.catalog().count() == 0
    store.write(d, "base", "in")
    store.write(d.withColumn("w", F.col("v") * 2).drop("v"), "derived", "in", parents=("base",), note="sigma 2")
    store.check_chain("derived")
    assert {r["name"]: r["rows"] for r in store.catalog().collect()} == {"base": 216, "derived": 216}
    assert results.select_one(store.catalog(), note="sigma 2") == "derived"
    for bad in ({"note": "none"}, {"input_hash": "in"}):
        with pytest.raises(ValueError):
            results.select_one(store.catalog(), **bad)
    both = store.composite(["base", "derived"], ["z", "y", "x"])
    assert both.columns == ["z", "y", "x", "v", "w"] and both.where("w <> 2 * v").count() == 0
    store.write(lattice(spark, seed=5.0), "base", "in2")
    with pytest.raises(ValueError):
        store.check_chain("derived")
    with pytest.raises(ValueError):
        store.composite(["base", "derived"], ["z", "y", "x"])


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", "pending", 1), ("b", "verified", 2)], "tile_key string, status string, at int")
    changes = spark.createDataFrame([("a", "verified", 3), ("b", "failed", 1), ("c", "pending", 1), ("c", "verified", 1)][:3], ledger.schema)
    merged = results.upsert(ledger, changes, ["tile_key"], "at")
    assert {tuple(r) for r in merged.collect()} == {("a", "verified", 3), ("b", "verified", 2), ("c", "pending", 1)}
    plan = lattices.tile_plan(spark.range(1), {"x": 4, "y": 4, "z": 4}, 2)
    some = plan.limit(3).select("tile_key", F.lit("verified").alias("status"), F.lit(1).alias("at"))
    assert results.pending(plan, some, "tile_key").count() == 5


def test_schema_is_fixed():
    s = results.lattice_schema({"pi": T.FloatType()})
    assert s.simpleString() == "struct<z:int,y:int,x:int,pi:float>" and not s["z"].nullable


def test_arrays(spark, tmp_path):
    a = np.random.default_rng(4).normal(size=(3, 40, 50))
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", p=a[:2], q=a)
    got = files.read_npy(spark, str(tmp_path / "a.npy")).toPandas()
    assert len(got) == a.size and np.array_equal(got.sort_values(["z", "y", "x"]).v.to_numpy(), a.ravel())
    assert files.read_npy(spark, str(tmp_path / "b.npz"), "p").count() == 4000
    np.save(tmp_path / "flat.npy", a.ravel())
    with pytest.raises(Exception, match="dimensions"):
        files.read_npy(spark, str(tmp_path / "flat.npy")).count()


def test_csv_and_reports(spark, tmp_path):
    path = str(tmp_path / "blocks")
    files.write_csv(spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "block_id int, mean double, extra string"), path, single=True)
    d = files.read_csv(spark, path, "block_id int, mean double", ["block_id", "mean"])
    assert d.dtypes == [("block_id", "int"), ("mean", "double")] and {tuple(r) for r in d.collect()} == {(1, 0.5), (2, None)}
    with pytest.raises(ValueError, match="strain"):
        files.read_csv(spark, path, "block_id int", ["block_id", "strain"])
    for k, status in enumerate(("complete", "staged")):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "report.json").write_text(json.dumps({"status": status, "global": {"pi": k + 0.5}}, indent=1))
    got = files.read_reports(spark, str(tmp_path / "r*" / "report.json"), "status string, global struct<pi:double>", status="complete").collect()
    assert [r["global"]["pi"] for r in got] == [0.5] and got[0]["path"].endswith("r0/report.json")


def test_cutouts(spark):
    rows = [(z, 0, 0, c, float(10 * z + c)) for z in range(3) for c in range(2)]
    d = spark.createDataFrame(rows, "z int, y int, x int, c int, v double")
    assert {tuple(r) for r in files.canonical_cutout(d, {0: "ux", 1: "uy"}).collect()} == {(z, 0, 0, 10.0 * z, 10.0 * z + 1) for z in range(3)}
    with pytest.raises(Exception, match="uy is not finite"):
        files.canonical_cutout(d.where("not (z = 1 and c = 1)"), {0: "ux", 1: "uy"}).collect()
    block = files.sub_block(lattice(spark), {"x": 2, "y": 0, "z": 3}, {"x": 2, "y": 6, "z": 1})
    assert block.count() == 12 and block.agg(F.min("x"), F.max("x"), F.max("z")).first()[:] == (0, 1, 0)


def test_sizes_ahead_of_a_run(spark):
    got = {r["field"]: r["bytes"] for r in files.resource_plan(spark, {"x": 5, "y": 4, "z": 4}, {"pi": (1, 1), "gradient": (9, 2)}, 2, 3).collect()}
    assert got == {"pi": 80 * 4 * 6, "gradient": 12 * 9 * 4 * 6}
