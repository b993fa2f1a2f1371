"""Prefix trie of conversations: ternary search trees over turn ids, one for each range of sequences.

Turns become ids, conversations sequences of ids, equal sequences one row with a count.  Rows are
sorted and dealt out by range; a task builds a ternary search tree of each run of neighbouring rows,
middle rows first, and walks it without recursion.  Only nodes on the path of a run's first or last
row can go on in another run.  These are merged by depth along the order of the runs, with what a
junction counts twice taken off; all others are final where they are found.

Sequences longer than a segment are cut into segments: the node where a segment ends is the root of
the next segment's tries, so a row is bounded however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import cut_lineage, shuffle_partitions, stored

#: Conversations of one base, and the hash's range, which bounds a shared head.
FAMILY, HEADS = 5, 9


def encoded(turns: DataFrame, hash_bits: int = 56) -> DataFrame:
    """conv_id, turn, id, bytes: one id for each distinct (role, text), equal only for equal contents.

    The id is the content's hash followed by an ordinal of 8 bits among contents of one hash; more
    than 256 of these are an error.  hash_bits below 56 is for tests.
    """
    d = turns.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    d = d.withColumn("h", F.shiftrightunsigned(F.xxhash64("role", "text"), 64 - hash_bits))
    contents = d.select("h", "role", "text").distinct()
    shared = cut_lineage(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"))
    ordinal = F.lit(0)
    if not shared.isEmpty():
        order = Window.partitionBy("h").orderBy("role", "text")
        apart = contents.join(shared, "h", "left_semi").withColumn("ordinal", F.row_number().over(order) - 1)
        d = d.join(apart, ["h", "role", "text"], "left")
        many = F.raise_error(F.lit("more than 256 contents share a hash")).cast("int")
        ordinal = F.when(F.col("ordinal") > 255, many).otherwise(F.coalesce("ordinal", F.lit(0)))
    return d.select("conv_id", "turn", F.shiftleft("h", 8).bitwiseOR(ordinal.cast("bigint")).alias("id"), F.octet_length("text").alias("bytes"))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with a number from 0 within each key, in the given order, without a task that holds a whole key.

    Rows are dealt out by range of (key, order); the driver gets one row for each partition.
    """
    tag = F.spark_partition_id().alias("__part")
    parts = shuffle_partitions(rows.sparkSession)
    sort = [F.col(key), *[F.col(c).asc_nulls_first() for c in order]]
    # Within a partition every row but those of its first key starts a key of its own there.
    kind = rows.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in it:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            new = np.append(True, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            at = np.arange(len(keys)) - start
            if last is not None and keys[0] == last:
                at[:np.argmax(new[1:]) + 1 if new[1:].any() else len(keys)] += seen
            last, seen = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_rows = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(batches, f"{schema}, {name} bigint")
    d = stored(sorted_rows.withColumn("__part", tag), "numbered")
    ends = d.groupBy("__part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(name, F.struct(key, name)).alias("top")).orderBy("__part").collect()
    carried, before = [], (None, 0)
    for r in ends:
        more = before[1] if before[0] == r["first"] else 0
        carried.append((r["__part"], r["first"], more))
        before = (r["last"], r["top"] + 1 + (more if r["first"] == r["last"] else 0))
    table = F.broadcast(d.sparkSession.createDataFrame(carried, f"__part int, __first {kind}, __more bigint"))
    number = F.col(name) + F.when(F.col(key) == F.col("__first"), F.col("__more")).otherwise(F.lit(0))
    return d.join(table, "__part").withColumn(name, number).select(*rows.columns, name)


def rebuilt(turns: DataFrame, hash_bits: int = 56) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 0, id, bytes) for each rebuilt turn, and conv_id of every conversation."""
    c = F.col("conv_id")
    head = F.crc32(c.cast("string")) % HEADS
    own = numbered(encoded(turns, hash_bits), "conv_id", ["turn", "id"], "at")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    heads = own.where((F.col("at") < HEADS - 1) & (c % FAMILY == 0)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "bytes"))).alias("head"))
    based = convs.select("conv_id", head.alias("h"), (c - c % FAMILY).alias("base")).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    based = cut_lineage(based.select("conv_id", "h", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<at:bigint,id:bigint,bytes:int>>)")), F.lit(1), F.col("h").cast("int")).alias("head")))
    front = based.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.id", "t.bytes")
    back = own.where(F.col("at") >= head).join(based.select("conv_id", "h", F.size("head").alias("k")), "conv_id")
    back = back.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "id", "bytes")
    return front.unionByName(back), based.select("conv_id")


class Tree:
    """A ternary search tree of id sequences in flat lists; node 0 stands above all."""

    def __init__(self):
        self.key, self.less, self.more, self.down = [0], [-1], [-1], [-1]
        self.up, self.size, self.count, self.first, self.end = [-1], [0], [0], [None], [None]

    def _child(self, node: int, key: int, size: int) -> int:
        """The node of a turn id below a node, made if it is not there."""
        at, link, of = self.down[node], self.down, node
        while at >= 0:
            if key == self.key[at]:
                return at
            link, of = (self.less, at) if key < self.key[at] else (self.more, at)
            at = link[of]
        link[of] = len(self.key)
        for values, v in ((self.key, key), (self.less, -1), (self.more, -1), (self.down, -1), (self.up, node), (self.size, size), (self.count, 0), (self.first, None), (self.end, None)):
            values.append(v)
        return len(self.key) - 1

    def add(self, ids: list, sizes: list, row: int, count: int, first: int) -> None:
        node = 0
        for key, size in zip(ids, sizes, strict=True):
            node = self._child(node, key, size)
        self.count[node], self.first[node], self.end[node] = count, first, row

    def path(self, ids: list) -> list[int]:
        out = [0]
        for key in ids:
            out.append(self._child(out[-1], key, 0))
        return out

    def totals(self, below: list) -> tuple[list, list, list]:
        """Children, leaves and saved bytes of every node; counts and smallest members are summed in place.

        A node comes after the one above it, so one walk from the last to the first meets every subtree
        before its top.  below: for each row (children, leaves, saved) of what hangs under its end, or None.
        """
        n = len(self.key)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for node in range(n - 1, 0, -1):
            row = self.end[node]
            if row is not None and below[row] is not None:
                more = below[row]
                children[node] += more[0]
                leaves[node] += more[1]
                saved[node] += more[2]
            if not children[node]:
                leaves[node] = 1
            saved[node] += (self.count[node] - 1) * self.size[node]
            top = self.up[node]
            children[top] += 1
            leaves[top] += leaves[node]
            saved[top] += saved[node]
            self.count[top] += self.count[node]
            if self.first[top] is None or self.first[node] < self.first[top]:
                self.first[top] = self.first[node]
        return children, leaves, saved


def _middle_first(n: int) -> Iterator[int]:
    """0..n-1, the middle of each range before its halves."""
    waiting = [(0, n)]
    while waiting:
        lo, hi = waiting.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            waiting += [(mid + 1, hi), (lo, mid)]


_NODES = "part int, run int, kind string, depth int, conv_id bigint, up_conv bigint, up_spine boolean, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends_key bigint, prefix bigint, ids array<bigint>, last array<bigint>, sizes array<int>"


def _tries(rows: DataFrame, run_turns: int) -> DataFrame:
    """Nodes of each run of sorted rows, and a row of kind edge for each run.

    rows: prefix, ids, sizes, n, first, ends_key, below, with the prefix as the first of ids.  kind: inner
    (final), left or right (on the path of the run's first or, only, last row; left where both), edge
    (the run's first and last ids).
    """

    def emit(part: int, run: int, held: list) -> pa.RecordBatch:
        tree = Tree()
        for k in _middle_first(len(held)):
            r = held[k]
            tree.add(r["ids"], r["sizes"], k, r["n"], r["first"])
        below = [(b["n_children"], b["n_leaves"], b["saved"]) if (b := r["below"]) else None for r in held]
        children, leaves, saved = tree.totals(below)
        left, right = tree.path(held[0]["ids"]), tree.path(held[-1]["ids"])
        kind = ["inner"] * len(tree.key)
        for k in right:
            kind[k] = "right"
        for k in left:
            kind[k] = "left"
        depth, prefix = [0] * len(tree.key), [0] * len(tree.key)
        for k in range(1, len(tree.key)):
            depth[k] = depth[tree.up[k]] + 1
            prefix[k] = tree.key[k] if depth[k] == 1 else prefix[tree.up[k]]
        some = range(1, len(tree.key))
        n = len(tree.key)  # nodes but the top, and the edge
        key_of = [held[e]["ends_key"] if (e := tree.end[k]) is not None else None for k in some]
        columns = [[part] * n, [run] * n, [*(kind[k] for k in some), "edge"], [*(depth[k] for k in some), 0], [*(tree.first[k] for k in some), None], [*(tree.first[tree.up[k]] for k in some), None],
                   [*(kind[tree.up[k]] != "inner" for k in some), None], [*(tree.count[k] for k in some), None], [*(children[k] for k in some), None], [*(leaves[k] for k in some), None],
                   [*(saved[k] for k in some), None], [*key_of, None], [*(prefix[k] for k in some), None], [*[None] * (n - 1), held[0]["ids"]], [*[None] * (n - 1), held[-1]["ids"]], [*[None] * (n - 1), held[0]["sizes"]]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in _NODES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, turns, part = 0, [], 0, 0
        for batch in it:
            for r in batch.to_pylist():
                if held and turns + len(r["ids"]) > run_turns:
                    yield emit(part, run, held)
                    run, held, turns = run + 1, [], 0
                part = r["part"]
                held.append(r)
                turns += len(r["ids"])
        if held:
            yield emit(part, run, held)

    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, "ids").sortWithinPartitions("ids").withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(batches, _NODES)


def _merged(found: DataFrame) -> DataFrame:
    """depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_key, prefix of every node over all runs."""
    runs = Window.orderBy("part", "run")  # one row for each run
    edges = found.where("kind = 'edge'").select("part", "run", F.lag("last").over(runs).alias("before"), "ids", "sizes")
    common = F.aggregate(F.zip_with("before", "ids", lambda a, b: a.eqNullSafe(b)), F.lit(0), lambda n, same: F.when(same & (n >= 0), n + 1).when(n >= 0, -n - 1).otherwise(n), lambda n: F.when(n < 0, -n - 1).otherwise(n))
    meets = edges.withColumn("common", F.when(F.col("before").isNull(), 0).otherwise(common))
    # The last row of the run before, a prefix of the first row here, was no leaf after all.
    meets = cut_lineage(meets.select("part", "run", "sizes", "common", (F.size("before") == F.col("common")).alias("inner_end")))
    depth = F.explode(F.sequence(F.lit(1), F.col("common"))).alias("depth")
    below = F.aggregate(F.slice("sizes", F.col("depth"), F.col("common") - F.col("depth") + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
    zero = F.lit(0).cast("bigint")
    junctions = meets.where("common > 0").select("part", "run", "sizes", "common", "inner_end", depth).select(
        "part", "run", "depth", F.lit(1).alias("side"), F.when(F.col("depth") < F.col("common"), -1).otherwise(0).cast("bigint").alias("n_children"),
        F.when(F.col("inner_end"), -1).otherwise(0).cast("bigint").alias("n_leaves"), below.alias("saved"))
    junctions = junctions.select("part", "run", "depth", "side", F.lit(None).cast("bigint").alias("conv_id"), zero.alias("n_convs"), "n_children", "n_leaves", "saved", F.lit(None).cast("bigint").alias("ends_key"), F.lit(None).cast("bigint").alias("prefix"))

    spine = found.where("kind in ('left', 'right')").withColumn("side", F.when(F.col("kind") == "left", 1).otherwise(2))
    spine = cut_lineage(spine.join(meets.select("part", "run", "common"), ["part", "run"]).withColumn("new", (F.col("side") != 1) | (F.col("depth") > F.col("common"))))
    along = Window.partitionBy("depth").orderBy("part", "run", "side")  # two rows for each run
    chained = cut_lineage(spine.withColumn("chain", F.sum(F.col("new").cast("int")).over(along)))
    places = chained.select("part", "run", "depth", "side", "chain")
    sums = ["conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_key", "prefix"]
    parts = chained.select("depth", "chain", *sums).unionByName(junctions.join(places, ["part", "run", "depth", "side"]).select("depth", "chain", *sums))
    whole = cut_lineage(parts.groupBy("depth", "chain").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends_key").alias("ends_key"), F.max("prefix").alias("prefix")))
    # What each run's path nodes are called over all runs, for the nodes below them.
    named = cut_lineage(places.join(whole.select("depth", "chain", "conv_id"), ["depth", "chain"]))
    of_chain = chained.groupBy("depth", "chain").agg(F.min(F.struct("part", "run", "side")).alias("at"))
    tops = of_chain.select("depth", "chain", "at.part", "at.run", "at.side")
    up = named.select("part", "run", (F.col("depth") + 1).alias("depth"), F.col("side").alias("up_side"), F.col("conv_id").alias("up_name"))
    # A right node's parent is right where the paths have parted, else left.
    lefts, rights = up.where("up_side = 1").drop("up_side"), up.where("up_side = 2").select("part", "run", "depth", F.col("up_name").alias("right_name"))
    roofed = tops.join(lefts, ["part", "run", "depth"], "left").join(rights, ["part", "run", "depth"], "left")
    parent = F.when(F.col("side") == 2, F.coalesce("right_name", "up_name")).otherwise(F.col("up_name"))
    spines = whole.join(roofed.select("depth", "chain", parent.alias("parent_conv_id")), ["depth", "chain"])
    inner = found.where("kind = 'inner'")
    plain = inner.where("not up_spine").withColumn("parent_conv_id", F.col("up_conv"))
    # Below a path node: its name by its member in this run.
    local = chained.select("part", "run", (F.col("depth") + 1).alias("depth"), "chain", F.col("conv_id").alias("up_conv")).join(whole.select((F.col("depth") + 1).alias("depth"), "chain", F.col("conv_id").alias("parent_conv_id")), ["depth", "chain"])
    hung = inner.where("up_spine").join(local.drop("chain"), ["part", "run", "depth", "up_conv"], "left")  # a prefix has no parent here
    out = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_key", "prefix"]
    return plain.select(*out).unionByName(hung.select(*out)).unionByName(spines.select(*out))


def _ends(members: DataFrame) -> DataFrame:
    """(ends_key, conv_id) rows -> ends_key, sha256 of the ids in ascending order, comma-joined.

    Ids are dealt out by range and leave each task as pieces of text, so the task that hashes a key
    streams few rows and holds one of them.
    """
    parts = shuffle_partitions(members.sparkSession)

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in it:
            keys, ids, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ends_key", "conv_id", "part"))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            out = [(keys[a], part[a], number + k, ",".join(map(str, ids[a:b].tolist()))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            number += len(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["ends_key", "part", "number", "ids"])

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in it:
            done: list = []
            for k, text in zip(batch.column("ends_key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.string())], ["ends_key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], ["ends_key", "ends_sha256"])

    order = ["ends_key", "conv_id"]
    texts = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).mapInArrow(pieces, "ends_key bigint, part int, number bigint, ids string")
    return texts.repartition(parts, "ends_key").sortWithinPartitions("ends_key", "part", "number").mapInArrow(hashes, "ends_key bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, segment: int = 256, run_turns: int = 1 << 16, hash_bits: int = 56) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text.  Turns are ordered by turn, null first, those of one turn by their
    content's id; null role and text are empty; repeated rows are turns of their own.  Rows without a
    conv_id belong to no conversation and are left out.  An empty table gives no rows; extra columns are
    ignored.  segment: turns of a row; run_turns: turns of one search tree.
    """
    rows, convs = rebuilt(turns, hash_bits)
    cells = rows.groupBy("conv_id", F.floor(F.col("depth") / segment).cast("int").alias("level")).agg(F.array_sort(F.collect_list(F.struct("depth", "id", "bytes"))).alias("x"))
    cells = cells.select("conv_id", "level", F.col("x.id").alias("ids"), F.col("x.bytes").alias("sizes"))
    lasts = cells.groupBy("conv_id").agg(F.max("level").alias("last"))
    none = [F.expr(f"cast(array() as array<{k}>)") for k in ("bigint", "int")]
    # A conversation without a turn has an empty first segment.
    all_cells = convs.join(cells, "conv_id", "left").join(lasts, "conv_id", "left").select(
        "conv_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("ids", none[0]).alias("ids"), F.coalesce("sizes", none[1]).alias("sizes"))
    cells = stored(all_cells, "segments")
    top = cells.agg(F.max("level")).first()[0]
    if top is None:
        return turns.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")

    # Downwards: equal segments under one node are one row, whose smallest member names the node at its end.
    levels, members, at = [], [], cells.where("level = 0").withColumn("prefix", F.lit(0).cast("bigint"))
    for level in range(top + 1):
        ends = F.col("last") == level
        distinct = at.groupBy("prefix", "ids", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.min(F.when(ends, F.col("conv_id"))).alias("ends_key"), F.count_if(ends).alias("enders"))
        levels.append(distinct := stored(distinct, f"level{level}"))
        named = distinct.where("enders > 1 or n > enders").select("prefix", "ids", "first", "ends_key", "enders")
        joined = at.join(named, ["prefix", "ids"])
        members.append(joined.where(ends & (F.col("enders") > 1)).select("ends_key", "conv_id"))
        if level < top:
            on = joined.where(~ends).select("conv_id", F.col("first").alias("prefix"))
            at = cut_lineage(cells.where(F.col("level") == level + 1).join(on, "conv_id"))

    # Upwards: what hangs under the end of a segment comes from the tries of the next.
    nodes, below = [], None
    for level in range(top, -1, -1):
        d = levels[level]
        d = d.join(below, "first", "left") if below is not None else d.withColumn("below", F.lit(None).cast("struct<n_children:bigint,n_leaves:bigint,saved:bigint>"))
        d = d.select(F.concat(F.array("prefix"), "ids").alias("ids"), F.concat(F.array(F.lit(0)), "sizes").alias("sizes"), "n", "first", "ends_key", "below")
        found = _merged(stored(_tries(d, run_turns), "tries"))
        found = stored(found, "nodes")
        nodes.append(found.where("depth > 1" if level else "true").withColumn("depth", F.col("depth") - 1 + level * segment).withColumn("top", F.lit(level > 0) & (F.col("depth") == level * segment + 1)))
        below = found.where("depth = 1").select(F.col("prefix").alias("first"), F.struct("n_children", "n_leaves", "saved").alias("below"))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    shared = members[0]
    for more in members[1:]:
        shared = shared.unionByName(more)
    one = F.sha2(F.coalesce(F.col("ends_key").cast("string"), F.lit("")), 256)
    out = out.join(_ends(shared), "ends_key", "left")
    # The node above a later segment's first turn is named by the prefix.
    parent = F.when(F.col("top"), F.col("prefix")).otherwise(F.col("parent_conv_id"))
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", one).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 bit by bit over the decimal digits; every prefix of every conversation is a list.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS seq FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, seq, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 9 AS h FROM own
), whole AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq FROM hashed a LEFT JOIN own b ON b.conv_id = a.base
), prefixes AS (
  SELECT conv_id, seq, d, seq[1:d] AS p FROM whole, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d) AS ends FROM prefixes GROUP BY p, d
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), each AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * octet_length(encode(n.p[n.d].text)) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids k ON k.p = n.p
), under AS (
  SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM each, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1
)
SELECT e.conv_id, e.d::BIGINT AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM each e JOIN under t ON t.p = e.p LEFT JOIN nodes u ON e.d > 0 AND u.p = e.p[1:e.d - 1]
"""
