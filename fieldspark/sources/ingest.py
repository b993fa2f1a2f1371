"""Resumable ingest of planned tiles, batches of results over a ladder, and rebuilding a chain of results: S6, S26, S29, K4, A5, A8.

An ingest is a folder of batches.  A batch's rows are written first, read again and judged tile by tile;
then its ledger part names the tiles that are whole.  Rows count only through the ledger, so a run that is
cut off at any step leaves nothing behind that a reader sees, and the next run asks only for what is missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.sources.results import Store, canonical


def run_id(now: datetime | None = None) -> str:
    """A name of a run from its time in UTC; names in order are in time's order."""
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")


class Incomplete(RuntimeError):
    """Tiles are missing after all attempts; `states` is the table of them."""

    def __init__(self, name: str, missing: int, states: DataFrame):
        super().__init__(f"{name}: {missing} tiles are missing")
        self.states = states


class Ingest:
    """An ingest of a plan (keys, `rows`: how many rows a tile has) into the store's folder `name`.

    keys identify a tile in the plan, and in the rows that are read.  finite: columns that may hold neither
    null nor NaN nor an infinite value in a verified tile.
    """

    def __init__(self, store: Store, name: str, keys: tuple[str, ...], finite: tuple[str, ...] = ()):
        self.store, self.spark, self.keys, self.finite = store, store.spark, keys, finite
        self.root = f"{store.root}/{name}"
        self.name = name

    def _ledger_schema(self, plan: DataFrame) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
        return ", ".join([*(f"`{k}` {kinds[k]}" for k in self.keys), "status string, found bigint, bad bigint, run string, batch string"])

    def history(self, plan: DataFrame) -> DataFrame:
        """Every verdict on a tile of any run: keys, status (verified, short, long, invalid), found, bad, run, batch."""
        kinds = self._ledger_schema(plan)
        if not self.store._exists(f"{self.root}/ledger"):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{self.root}/ledger")

    def verified(self, plan: DataFrame) -> DataFrame:
        """Keys and batch of verified tiles, each once: the first batch that has it counts."""
        done = self.history(plan).where("status = 'verified'")
        return done.groupBy(*self.keys).agg(F.min_by("batch", F.struct("run", "batch")).alias("batch"))

    def states(self, plan: DataFrame) -> DataFrame:
        """The plan with each tile's status: verified, the last verdict on it, or `planned` where it was never read."""
        seen = self.history(plan).groupBy(*self.keys).agg(
            F.max_by("status", F.struct(F.col("status") == "verified", "run", "batch")).alias("status"), F.count(F.lit(1)).alias("verdicts"))
        out = plan.join(seen, list(self.keys), "left")
        return out.withColumn("status", F.coalesce("status", F.lit("planned"))).withColumn("verdicts", F.coalesce("verdicts", F.lit(0)))

    def pending(self, plan: DataFrame) -> DataFrame:
        return plan.join(self.verified(plan).select(*self.keys), list(self.keys), "left_anti")

    def _write(self, todo: DataFrame, read: Callable[[DataFrame], DataFrame], run: str) -> None:
        """One batch: rows, then their check, then the ledger part that makes them count."""
        batch = f"{run}-{uuid.uuid4().hex[:12]}"
        place = f"{self.root}/rows/batch={batch}"
        rows, seen = read(todo), Observation()
        order_free = lambda d: F.sum(F.xxhash64(*d.columns, *[F.col(f"`{c}`").isNull() for c in d.columns]).cast("decimal(38,0)"))
        rows.observe(seen, F.count(F.lit(1)).alias("n"), order_free(rows).alias("sum")).write.parquet(place)
        back = self.spark.read.schema(rows.schema).parquet(place)
        bad = F.lit(False)
        for c in self.finite:
            bad |= F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
        tiles = back.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("found"), F.count_if(bad).alias("bad"), order_free(back).alias("sum"))
        tiles.write.parquet(f"{self.root}/checks/batch={batch}")
        tiles = self.spark.read.parquet(f"{self.root}/checks/batch={batch}")
        total = tiles.agg(F.sum("found").alias("n"), F.sum("sum").alias("sum")).first()
        if (total["n"] or 0, total["sum"]) != (seen.get["n"], seen.get["sum"]):
            raise OSError(f"{self.name}: what was read back of {batch} differs from what was written")
        found, want = F.coalesce("found", F.lit(0)), F.col("rows")
        verdict = F.when(found < want, "short").when(found > want, "long").when(F.col("bad") > 0, "invalid").otherwise("verified")
        judged = todo.select(*self.keys, "rows").join(tiles, list(self.keys), "left").select(
            *self.keys, verdict.alias("status"), found.alias("found"), F.coalesce("bad", F.lit(0)).alias("bad"), F.lit(run).alias("run"), F.lit(batch).alias("batch"))
        part = f"{self.root}/parts/{batch}"
        judged.write.parquet(part)
        fs, source = self.store._fs(part)
        _, ledger = self.store._fs(f"{self.root}/ledger")
        fs.mkdirs(ledger)
        _, target = self.store._fs(f"{self.root}/ledger/{batch}")
        if not fs.rename(source, target):
            raise OSError(f"{self.name}: the ledger part of {batch} was not published")

    def run(self, plan: DataFrame, read: Callable[[DataFrame], DataFrame], attempts: int = 3, batches: int = 1, retry: tuple[type[Exception], ...] = (OSError, PySparkException)) -> DataFrame:
        """Reads what is missing of the plan until all of it is verified, at most `attempts` times; the rows.

        read takes tiles of the plan and gives their rows, keys among the columns.  The missing tiles are
        divided by a hash of their keys into `batches`, and a batch that fails with one of `retry` costs only
        its own rows.  Raises Incomplete if tiles are missing after the last attempt; a later run goes on from there.
        """
        if plan.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"{self.name}: the plan has a tile twice")
        for _ in range(attempts):
            left = self.pending(plan).select(*self.keys, "rows")
            held = f"{self.root}/asked/{uuid.uuid4().hex}"  # fixed while the ledger grows
            left.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(batches)).cast("int")).write.partitionBy("part").parquet(held)
            asked = self.spark.read.schema(T.StructType([*left.schema.fields, T.StructField("part", T.IntegerType())])).parquet(held)
            parts = sorted(r["part"] for r in asked.select("part").distinct().collect())  # at most `batches`
            if not parts:
                break
            for part in parts:
                try:
                    self._write(asked.where(F.col("part") == part).drop("part"), read, run_id())
                except retry as error:
                    print(f"{self.name}: batch {part} of {batches} failed: {str(error).splitlines()[0][:200]}")
        missing = self.pending(plan).count()
        if missing:
            raise Incomplete(self.name, missing, self.states(plan).where("status <> 'verified'"))
        return self.rows(plan)

    def rows(self, plan: DataFrame) -> DataFrame:
        """The rows of the plan's verified tiles, each tile from one batch.

        Batches without a faulty or repeated tile are read as they are; only the others are joined with the ledger.
        """
        good = self.verified(plan).join(plan.select(*self.keys), list(self.keys), "left_semi")
        judged = self.history(plan).groupBy("batch").agg(F.count(F.lit(1)).alias("judged"))
        sizes = good.groupBy("batch").agg(F.count(F.lit(1)).alias("good")).join(judged, "batch").collect()  # a row for each batch
        whole = [r["batch"] for r in sizes if r["good"] == r["judged"]]
        some = [r["batch"] for r in sizes if r["good"] != r["judged"]]
        if not sizes:
            raise ValueError(f"{self.name} has no verified tile")
        open_ = lambda names: self.spark.read.option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/batch={n}" for n in names])
        parts = [open_(whole)] if whole else []
        if some:
            parts.append(open_(some).join(good, [*self.keys, "batch"], "left_semi"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.drop("batch")


def publish_ladder(store: Store, name: str, members: dict[str, str]) -> dict:
    """Names results of one input under labels (filter widths, frames) as one batch; labels named before stay unless named anew.

    All members, old and new, must be complete, of one input and with the same columns, or nothing changes.
    """
    path = f"{store.root}/{name}/ladder.json"
    known = json.loads(store._get(path))["members"] if store._exists(path) else {}
    merged = {k: v["result"] for k, v in known.items()} | {str(k): v for k, v in members.items()}
    if not merged:
        raise ValueError(f"{name}: no members")
    of = {k: store._complete(v) for k, v in merged.items()}
    for what in ("input_hash", "columns"):
        if len({canonical({what: m[what]}) for m in of.values()}) > 1:
            raise ValueError(f"{name}: members differ in {what}")
    out = {"name": name, "input_hash": next(iter(of.values()))["input_hash"], "members": {k: {"result": v, "sha256": store._seal(v), "rows": of[k]["rows"]} for k, v in merged.items()}}
    store._put(path, canonical(out))
    return out


def open_ladder(store: Store, name: str, label: str, kind: str = "double") -> DataFrame:
    """The members of a batch one below the other, with their label as a column; a member changed since is an error."""
    members = json.loads(store._get(f"{store.root}/{name}/ladder.json"))["members"]
    out = None
    for value, m in sorted(members.items()):
        if store._seal(m["result"]) != m["sha256"]:
            raise ValueError(f"{m['result']} has changed since {name} named it")
        rows = store.open(m["result"]).withColumn(label, F.lit(value).cast(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def shares_by(rows: DataFrame, label: str, value: str, limits: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Per label (a filter width): count, rms, shares below and above zero and beyond multiples of the rms, mean over rms.

    The rms of a label comes first; then one pass, combined before the shuffle.
    """
    v = F.col(value)
    rms = rows.groupBy(label).agg(F.sqrt(F.avg(v * v)).alias("rms"))
    d = rows.join(rms, label)
    share = lambda c: F.avg(c.cast("double"))
    beyond: list[Column] = [share(F.abs(v) > k * F.col("rms")).alias(f"beyond_{k:g}_rms") for k in limits]
    return d.groupBy(label).agg(F.count(F.lit(1)).alias("count"), F.max("rms").alias("rms"), share(v < 0).alias("below"), share(v > 0).alias("above"), *beyond,
                                F.try_divide(F.avg(v), F.max("rms")).alias("mean_over_rms"))


def single_frame(store: Store, name: str, input_hash: str, plan: DataFrame, read: Callable[[DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame],
                 keys: tuple[str, ...], finite: tuple[str, ...] = (), **how) -> DataFrame:
    """The result of one frame: opened if it is complete for this input, else ingested, verified, made and written."""
    known = store.manifest(name)
    if known and input_hash and known["input_hash"] == input_hash:
        return store.open(name)
    rows = Ingest(store, f"{name}-tiles", keys, finite).run(plan, read, **how)
    return store.write(make(rows), name, input_hash)


def rebuild_order(store: Store, name: str) -> list[str]:
    """A result and all that it was made from, parents first, each once; a circle is an error."""
    order: list[str] = []

    def visit(n: str, under: tuple[str, ...]) -> None:
        if n in under:
            raise ValueError(f"{n} was made from itself")
        if n not in order:
            for parent in store._complete(n)["parents"]:
                visit(parent["name"], (*under, n))
            order.append(n)

    visit(name, ())
    return order


def rebuild(store: Store, into: Store, name: str, makers: dict[str, Callable[[Store], DataFrame]], execute: bool = False) -> DataFrame:
    """Makes a result and its parents anew in another root; one row for each: nth, name, outcome.

    outcome is `planned` without execute, else `equal` or `differs`, by content hash.  A maker gets the new
    store, in which its parents are already; the old root is only read.  A missing maker is an error ahead of any work.
    """
    if into.root == store.root:
        raise ValueError("a result is made anew in another root")
    order = rebuild_order(store, name)
    if lacking := [n for n in order if n not in makers]:
        raise ValueError(f"no makers for {lacking}")
    out = []
    for nth, n in enumerate(order):
        outcome = "planned"
        if execute:
            old = store._complete(n)
            into.write(makers[n](into), n, old["input_hash"], tuple(p["name"] for p in old["parents"]), old["sampling"], old["note"])
            outcome = "equal" if into.manifest(n)["content_hash"] == old["content_hash"] else "differs"
        out.append((nth, n, outcome))
    return store.spark.createDataFrame(out, "nth int, name string, outcome string")
