"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Item sizes are whole numbers up to the capacity, so the instance is a histogram of at most
`capacity` entries, whatever the number of documents.  The driver works on that histogram:
sets that provably dominate every alternative are fixed in bulk, the rest is packed by
best fit in decreasing order (bins of equal residual are one entry).  Spark then ranks the
pieces of each size in salted buckets and joins them with the plan's runs of slots, a table
whose size the capacity bounds.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.bpe import codec
from fieldspark.llm.common import cut_lineage, documents, shuffle_partitions

CAPACITY = 2048
END = 0
#: Pieces that one salted bucket of a length ranks, about, until there is a bucket for each shuffle partition.
BUCKET_ROWS = 200


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids followed by END.

    Only documents longer than capacity are cut, and all pieces but the first are full.
    A null text is one piece, the END alone.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, True)
        for batch in it:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(own.packed_all(batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Stock:
    """How many items of each size are left."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.remove(size)

    def at_most(self, size: int, without: Counter) -> int | None:
        """The largest size left that is not over `size`, beside the items of `without`."""
        at = bisect_right(self.sizes, size) - 1
        while at >= 0 and self.counts[self.sizes[at]] <= without[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, many: int, without: Counter, above: int = 0) -> list[int]:
        out: list[int] = []
        for s in self.sizes[bisect_right(self.sizes, above):]:
            out += [s] * min(many - len(out), self.counts[s] - without[s])
            if len(out) == many:
                break
        return out

    def best_pair(self, room: int, without: Counter) -> int:
        """The largest sum of two items that is not over room, or 0."""
        best, hi = 0, bisect_right(self.sizes, room) - 1
        lo = 0
        left = lambda s: self.counts[s] - without[s]
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room:
                hi -= 1
                continue
            if left(a) > 0 and left(b) > (a == b):
                best = max(best, a + b)
            elif left(b) <= 0:
                hi -= 1
                continue
            elif a == b:
                break
            lo += 1
        return best


def dominating(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with an item of size j that dominates all feasible sets with it, or None.

    A set dominates another if the other's items can be grouped so that each group fits
    into one item of the first.  Then some optimal packing has a bin of just that set.
    """
    own, room = Counter([j]), capacity - j
    few = stock.smallest(3, own)
    if not few or few[0] > room:
        return (j,)
    k = stock.at_most(room, own)
    if k == room or len(few) == 1 or few[0] + few[1] > room:
        return (j, k)
    if len(few) == 3 and sum(few) <= room:
        return None
    if k >= stock.best_pair(room, own):
        return (j, k)
    both = own + Counter([k])
    b = stock.at_most(room - k, both)
    if b is not None:
        larger = stock.smallest(2, own, above=b)
        if len(larger) < 2 or sum(larger) > room:
            return (j, k, b)
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Sets that are fixed for good, as (how many, sizes), and the counts that remain."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed:
        changed = False
        for j in stock.sizes[::-1]:
            while j in stock.counts and (found := dominating(stock, j, capacity)):
                need = Counter(found)
                times = min(stock.counts[s] // n for s, n in need.items())
                for s, n in need.items():
                    stock.take(s, n * times)
                fixed.append((times, found))
                changed = True
    return fixed, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit in decreasing order: (bins, [(size, items in each bin)]) for bins that are alike."""
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    residuals: list[int] = []
    full = []

    def put(residual: int, bins: int, content: list[tuple[int, int]]) -> None:
        if not bins:
            return
        if residual == 0:
            full.append((bins, content))
            return
        if residual not in open_bins:
            open_bins[residual] = []
            residuals.insert(bisect_left(residuals, residual), residual)
        open_bins[residual].append((bins, content))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(residuals, size)
            if at == len(residuals):
                residual, content, each = capacity, [], capacity // size
                bins = -(-left // each)
            else:
                residual = residuals[at]
                bins, content = open_bins[residual].pop()
                if not open_bins[residual]:
                    del open_bins[residual]
                    residuals.pop(at)
                each = residual // size
            whole, rest = min(bins, left // each), 0
            if whole < bins:
                rest = left - whole * each
                if rest:
                    put(residual - rest * size, 1, [*content, (size, rest)])
                put(residual, bins - whole - (rest > 0), content)
            put(residual - each * size, whole, [*content, (size, each)])
            left -= whole * each + rest
    return full + [x for group in open_bins.values() for x in group]


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots: (size, first rank, end rank, first sequence, items in a bin, offset of the first)."""
    fixed, rest = reduce(counts, capacity)
    bins = [(n, sorted(Counter(s).items(), reverse=True)) for n, s in fixed] + best_fit(rest, capacity)
    used: Counter = Counter()
    out, sequence = [], 0
    for n, content in bins:
        offset = 0
        for size, each in content:
            out.append((size, used[size], used[size] + n * each, sequence, each, offset))
            used[size] += n * each
            offset += size * each
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Places in a sequence are gapless from 0.  Null and empty texts are a piece of one id.
    Rows with repeated or null ids are packed one by one; an empty table gives no rows;
    other columns are ignored.
    """
    rows = cut_lineage(pieces(docs, id_col, text_col, capacity, path))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = slots(counts, capacity)
    spark = docs.sparkSession
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "size bigint, lo bigint, hi bigint, first bigint, each bigint, at bigint")
    buckets = max(1, min(shuffle_partitions(spark), sum(counts.values()) // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = rows.groupBy("length", "bucket").count()
    before = each.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("size")).cast("bigint").alias("offset"),
    )


def op4_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
