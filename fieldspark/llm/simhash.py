"""Near-duplicate detection: 64-bit SimHash fingerprints linked through Golay-code fuzzy keys.

A fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ
in three bits at most, then either one segment is equal and another differs in one bit
at most, or each segment differs in exactly one bit.  Keys follow these two cases: an
equal segment joined with a codeword index of another (34 bits), and codeword indices
of all three (36 bits).  A difference of one bit flips a segment's parity, so segments
of even parity emit all codewords within distance 4 and odd ones only the nearest: the
two always meet.  Candidates are verified by counting differing bits.

Only distinct fingerprints take part.  Within a key, each first links to the key's least
one; what these stars have already joined is never compared again, so a large group of
near copies does not give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldspark.llm.common import cut_lineage, documents, first_row, short_shuffles, shuffle_partitions, small_batches, stored, with_row_keys
from fieldspark.llm.components import connected_components
from fieldspark.llm.golay import codeword_indices
from fieldspark.llm.shingle_links import joined_components

SEED = 42
BITS_APART = 3
#: (first bit, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
_BLOCK = 1 << 15
#: Bytes of a batch of texts on its way to Python.
BATCH_BYTES = 1 << 22


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the space-joined shingles of a text, repeats included; 0 without a word.

    Words are runs other than [\\x20\\x09-\\x0D] after lower-casing A-Z; a text of fewer
    words than size is one shingle.  A bit is 1 if set in over half the XXH64 hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:at + _BLOCK].tolist(), ends[at:at + _BLOCK].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, fp bigint")


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For an array of uint64 fingerprints: (row, key) pairs; rows within BITS_APART share a key."""
    n = len(prints)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    lists = []
    for part in parts:
        nearest, near = codeword_indices(part)
        near = near.copy()
        near[(np.bitwise_count(part) & 1) == 1, 1:] = -1
        lists.append(near)
    rows, keys = [], []

    def emit(tag: int, value: np.ndarray, good: np.ndarray) -> None:
        row, *_ = np.nonzero(good)
        rows.append(row)
        keys.append(value[good] | (tag << 40))

    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        emit(tag, (parts[i][:, None] << 12) | lists[j], lists[j] >= 0)
    a, b, c = lists[0][:, :, None, None], lists[1][:, None, :, None], lists[2][:, None, None, :]
    emit(6, ((a << 24) | (b << 12) | c).reshape(n, -1), ((a >= 0) & (b >= 0) & (c >= 0)).reshape(n, -1))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, fp, comp) -> (key, node, fp, comp), a row for each key."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, keys = fuzzy_keys(part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *part.take(pa.array(rows)).columns], ["key", "node", "fp", "comp"])

    return nodes.select("node", "fp", "comp").mapInArrow(batches, "key bigint, node bigint, fp bigint, comp bigint")


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(nodes: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """Components of distinct fingerprints (node, fp) -> (node, component) of those with a link."""
    # A fingerprint becomes some 46 keys, so its small table is dealt to all tasks first.
    nodes = cut_lineage(nodes.select("node", "fp").repartition(shuffle_partitions(nodes.sparkSession), "node"))
    keyed = _keyed(nodes.withColumn("comp", F.col("node")))
    # Stars: a key's least node, by a grouped minimum that is combined before the shuffle.
    least = cut_lineage(keyed.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    least = least.select("key", F.col("least.node").alias("to"), F.col("least.fp").alias("to_fp"))
    stars = keyed.join(least, (keyed["key"] == least["key"]) & (F.col("node") != F.col("to")) & (_apart("fp", "to_fp") <= apart))
    stars = stars.groupBy("node").agg(F.collect_set("to").alias("tos")).select(F.col("node").alias("a"), F.explode("tos").alias("b"))
    stars = cut_lineage(stars)
    joined = connected_components(stars)
    # What is left: pairs within a key whose ends the stars have not joined.
    known = nodes.join(joined.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keyed = _keyed(cut_lineage(known.repartition(shuffle_partitions(nodes.sparkSession), "node")))
    sizes = keyed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"))
    main = cut_lineage(main.where("comps > 1").select("key", "main"))
    mixed = cut_lineage(keyed.join(main, "key"))
    a = mixed.where("comp <> main").select("key", F.col("node").alias("a"), F.col("fp").alias("a_fp"), F.col("comp").alias("a_comp"))
    b = mixed.select(F.col("key").alias("b_key"), F.col("node").alias("b"), F.col("fp").alias("b_fp"), F.col("comp").alias("b_comp"))
    pairs = a.join(b, (F.col("key") == F.col("b_key")) & (F.col("a_comp") != F.col("b_comp")) & (_apart("a_fp", "b_fp") <= apart))
    between = cut_lineage(pairs.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct())
    return connected_components(stars.unionByName(between))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", apart: int = BITS_APART) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in `apart` (3 at most) bits or fewer;
    component_id is the smallest doc_id reachable, itself included.  Null, empty and blank
    texts have fingerprint zero and are linked like any other.  Repeated ids are kept as
    rows.  Rows with a null id link others, but never name a component: one of null ids alone
    has a null component_id.  An empty table gives no rows.
    """
    if not 0 <= apart <= BITS_APART:
        raise ValueError("the keys find differences of three bits at most")
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    # Each distinct fingerprint is a node; `least` is its smallest id, null if it has null ids alone.
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("least")))
    linked = near_links(nodes.select(F.col("fp").alias("node"), "fp"), apart)
    # A repeated doc_id may be the smallest of two fingerprints, whose rows then meet in one component.
    same = nodes.where("least is not null").groupBy("least").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b < last")
    same = cut_lineage(nodes.join(same, "least").select(F.col("fp").alias("a"), "b").where("a <> b"))
    if not same.isEmpty():
        linked = connected_components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same))
    grouped = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    grouped = cut_lineage(grouped)
    named = cut_lineage(grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each component of linked rows.

    Rows are linked as near_duplicates links documents, or if their sets of 5-word shingles
    have a Jaccard of 0.8 or more (shingle_links).  Each row stands for itself: a repeated id
    joins no components, and rows with a null id are linked too.  The row with the smallest
    id stays, a null id sorting last.
    """
    with short_shuffles(docs.sparkSession), small_batches(docs.sparkSession, BATCH_BYTES):
        keyed = with_row_keys(docs, "__row")
        prints = near_duplicates(keyed, "__row", text_col).select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
        rows = keyed.select(F.col("__row").alias("row"), F.col(text_col).alias("text"))
        linked = joined_components(rows, stored(prints, "prints")).select(F.col("row").alias("__row"), "comp")
    kept = linked.join(keyed.select("__row", F.col(id_col).alias("id")), "__row").groupBy("comp").agg(F.min(first_row("id", "__row")).alias("first"))
    return keyed.join(kept.select(F.col("first.key").alias("__row")), "__row", "left_semi").select(*docs.columns)


def op1_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
