"""Verified result tables: staged writes with a content hash, manifests, resume, discovery, composites and a ledger: S8, S10-S13, S15, S19, S23, S25, S28-S30, J11, A4, A6, A7, F16, K5, K6.

A result is a folder of versions, each with its rows as Parquet, and `manifest.json`, which names the
version that holds.  A version is written, read again and compared before the manifest is replaced in one
rename, so a reader sees the former result or the new one and a write that fails at any step changes
nothing.  Hashes and extremes come from one grouped pass over the rows, whatever their order, and those
of the written side from the write itself; only the manifest, one row, passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the layout of a result folder; others are not opened.
VERSION = 2
MANIFEST_SCHEMA = "name string, version int, folder string, status string, input_hash string, content_hash string, rows bigint, columns array<struct<name:string,type:string>>, bucket_by array<string>, buckets int, parents array<struct<name:string,sha256:string>>, sampling int, note string"


def lattice_schema(fields: dict[str, T.DataType]) -> T.StructType:
    """The fixed schema of a lattice table: places, then fields."""
    return T.StructType([*(T.StructField(a, T.IntegerType(), False) for a in "zyx"), *(T.StructField(n, t, True) for n, t in fields.items())])


def _measures(df: DataFrame) -> list:
    """What content_metadata is made of, as aggregates of one pass."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,))]
    # A hash skips nulls, so where they are is hashed too.
    row = F.xxhash64(*df.columns, *[F.col(f"`{c}`").isNull() for c in df.columns])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    # Equal rows cancel in the exclusive or; the sum tells how often they occur.
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).alias("sum"),
            *[x for c in numbers for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(~finite(c)).alias(f"bad_{c}"))]]


def _metadata(schema: T.StructType, r) -> dict:
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, (T.NumericType,))]
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    return {"rows": r["rows"], "content_hash": hashlib.sha256(f"{kinds}|{r['rows']}|{r['xor']}|{r['sum']}".encode()).hexdigest(),
            "fields": {c: {"min": r[f"min_{c}"], "max": r[f"max_{c}"], "nonfinite": r[f"bad_{c}"]} for c in numbers}}


def content_metadata(df: DataFrame) -> dict:
    """rows, content_hash (of all rows, whatever their order and partitioning) and min, max and non-finite count of each number."""
    return _metadata(df.schema, df.agg(*_measures(df)).first())


def canonical(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Store:
    """Results under one root of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _put(self, path: str, text: str) -> None:
        """Writes beside the place and renames over it, so a reader sees the whole former text or the whole new one."""
        fs, p = self._fs(path)
        _, part = self._fs(f"{path}.part-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._replace(part, p)

    def _replace(self, part, place) -> None:
        jvm = self.spark._jvm
        modes = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        modes[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, place, modes)

    def _get(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def manifest(self, name: str) -> dict | None:
        path = f"{self.root}/{name}/manifest.json"
        return json.loads(self._get(path)) if self._exists(path) else None

    def write(self, df: DataFrame, name: str, input_hash: str = "", parents: tuple[str, ...] = (), sampling: int = 1, note: str = "", partition_by: tuple[str, ...] = (), bucket_by: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
        """Writes a result and opens it; one that is complete and has the same input hash is opened as it is.

        Parents are looked up first.  The rows go to a new version, are read again and compared by content
        hash, and only then does the manifest name them; until then, and after any failure, the former result
        is what opens.  The input is computed once: its hash is observed while it is written.

        bucket_by, buckets: rows are dealt out by these columns and sorted by them, once; results with the
        same buckets join on them without a shuffle.
        """
        known = self.manifest(name)
        if known and input_hash and known["input_hash"] == input_hash and known["version"] == VERSION:
            return self.open(name)
        above = [{"name": p, "sha256": self._seal(p)} for p in parents]
        folder = f"v-{uuid.uuid4().hex}"
        place = f"{self.root}/{name}/{folder}"
        seen = Observation()
        if bucket_by:
            # Dealt out ahead, so that a bucket is one file and its sort order holds.
            dealt = df.observe(seen, *_measures(df)).repartition(buckets, *bucket_by)
            dealt.write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).format("parquet").option("path", place).saveAsTable(self._table(folder))
        else:
            df.observe(seen, *_measures(df)).write.partitionBy(*partition_by).parquet(place)
        want, back = _metadata(df.schema, seen.get), self._rows(place, df.schema)
        if content_metadata(back) != want:
            raise OSError(f"{name}: what was read back differs from what was written")
        self._put(f"{self.root}/{name}/manifest.json", canonical({
            "name": name, "version": VERSION, "folder": folder, "status": "complete", "input_hash": input_hash, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields],
            "bucket_by": list(bucket_by), "buckets": buckets, "parents": above, "sampling": sampling, "note": note, **want}))
        self.tidy(name, keep=[folder, *([known["folder"]] if known and "folder" in known else [])])
        return self.open(name)

    def _rows(self, place: str, schema) -> DataFrame:
        d = self.spark.read.schema(schema).parquet(place)
        return d.select(*(schema.names if isinstance(schema, T.StructType) else d.columns))

    def tidy(self, name: str, keep: list[str] | None = None) -> list[str]:
        """Deletes versions that are neither published nor kept (write keeps the one before for its readers); their names."""
        known = self.manifest(name)
        stay = {known["folder"]} if keep is None and known else set(keep or [])
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in stay]
        for path in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(path.getName())}")
            fs.delete(path, True)
        return sorted(path.getName() for path in gone)

    @staticmethod
    def _table(folder: str) -> str:
        """The session's name for a bucketed version; a version's folder is unique."""
        return f"result_{folder.replace('-', '_')}"

    def _bucketed(self, known: dict) -> DataFrame:
        """A bucketed version as a table, made known to this session if it is not."""
        table = self._table(known["folder"])
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{c['name']}` {c['type']}" for c in known["columns"])
            keys = ", ".join(f"`{c}`" for c in known["bucket_by"])
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {known['buckets']} BUCKETS LOCATION '{self.root}/{known['name']}/{known['folder']}'")
        return self.spark.table(table)

    def _seal(self, name: str) -> str:
        """Hash of a complete result's manifest but for where its rows lie."""
        return sha256(canonical({k: v for k, v in self._complete(name).items() if k != "folder"}))

    def _complete(self, name: str) -> dict:
        known = self.manifest(name)
        if not known or known["status"] != "complete":
            raise ValueError(f"{name} is not complete")
        if known["version"] != VERSION:
            raise ValueError(f"{name} has another version")
        return known

    def open(self, name: str, verify: bool = False) -> DataFrame:
        """The rows of a complete result under the schema of its manifest; verify compares their content hash too."""
        known = self._complete(name)
        d = self._bucketed(known) if known.get("buckets") else self.spark.read.schema(", ".join(f"`{c['name']}` {c['type']}" for c in known["columns"])).parquet(f"{self.root}/{name}/{known['folder']}")
        d = d.select(*[c["name"] for c in known["columns"]])
        if verify and content_metadata(d)["content_hash"] != known["content_hash"]:
            raise ValueError(f"{name} differs from its manifest")
        return d

    def check_chain(self, name: str) -> None:
        """Raises if a result, or one that it was made from, has changed since."""
        for parent in self._complete(name)["parents"]:
            if self._seal(parent["name"]) != parent["sha256"]:
                raise ValueError(f"{parent['name']} has changed since {name} was made")
            self.check_chain(parent["name"])

    def catalog(self) -> DataFrame:
        """One row per result with a manifest: its fields but the extremes; none for an empty root."""
        if not self._exists(self.root):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        fs, p = self._fs(self.root)
        if not [s for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest.json"))]:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/*/manifest.json")

    def composite(self, names: list[str], keys: list[str]) -> DataFrame:
        """The columns of several complete results of one input side by side; the first result that has a name gives it.

        Results that are bucketed by the keys in one way are joined bucket by bucket, without a shuffle.
        """
        known = [self._complete(n) for n in names]
        if len({(k["input_hash"], k["sampling"]) for k in known}) > 1:
            raise ValueError("the results are of different inputs or samplings")
        out = self.open(names[0])
        for n in names[1:]:
            more = self.open(n)
            out = out.join(more.select(*keys, *[c for c in more.columns if c not in out.columns]), keys)
        return out


def select_one(catalog: DataFrame, **equal) -> str:
    """The name of the one result whose columns have the given values; none or several are an error."""
    d = catalog
    for column, value in equal.items():
        d = d.where(F.col(column) == F.lit(value))
    found = [r["name"] for r in d.select("name").orderBy("name").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} result for {equal}")
    return found[0]


def upsert(ledger: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """ledger with changes merged in: for each key the row with the greatest `order`, a change before a known row of the same."""
    rows = ledger.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*ledger.columns), F.struct(F.col(order), F.col("__new"))).alias("r"))
    return newest.select("r.*")


def pending(plan: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of a plan that the ledger does not have as verified."""
    return plan.join(ledger.where("status = 'verified'").select(key), key, "left_anti")
