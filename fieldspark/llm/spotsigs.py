"""Document fingerprints by SpotSigs.

The anchors are the most frequent words of the whole corpus.  A spot is an anchor with the
chain of the next content words; a document's fingerprint is the sorted set of its spots'
32-bit hashes, in hexadecimal.  Likeness is the Jaccard coefficient of two sets.  The
similarity join splits sets by length so that only equal or neighbouring partitions can
hold similar sets, indexes each set under its rarest spots only, and verifies.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldspark.llm.common import documents, shuffle_partitions

WORD = re.compile(r"\w+")
ANCHORS, CHAIN = 100, 2
#: Rows of one neighbourhood bucket, about, until there are so many buckets for each shuffle partition.
BUCKET_ROWS, BUCKETS = 1_000, 8
#: Ids drawn for each bucket to find the buckets' edges.
DRAWN = 20
#: What a null id is sorted as.
NULL_ID = -(1 << 63)
_KEPT = 300_000


def anchor_words(docs: DataFrame, text_col: str = "text", how_many: int = ANCHORS) -> list[str]:
    """The most frequent words over all rows (ties: the first in alphabetical order)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for batch in it:
            for text in batch.column(0):
                found.update(WORD.findall((text.as_py() or "").lower()))
                if len(found) > _KEPT:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    words = docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(how_many).collect()]


class Spotter:
    """Sets of spot hashes, in a Python worker."""

    def __init__(self, anchors: list[str], chain: int = CHAIN):
        self.anchors, self.chain = frozenset(anchors), chain
        self.codes: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """A hash whose last bit marks anchors."""
        if (code := self.codes.get(word)) is None:
            if len(self.codes) > _KEPT:
                self.codes.clear()
            code = self.codes[word] = xxh64_intdigest(word) & ~1 | (word in self.anchors)
        return code

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct uint32 hashes.  A text with words but no spot has one, of all its
        words; one with characters but no word has one, of the text; an empty one has none."""
        words = WORD.findall(text.lower())
        codes = np.array([self._code(w) for w in words], np.uint64)
        is_anchor = (codes & np.uint64(1)).astype(bool)
        content, anchors = np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor)
        first = np.searchsorted(content, anchors)
        good = first + self.chain <= len(content)
        mixed, first = codes[anchors[good]].copy(), first[good]
        for k in range(self.chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[content[first + k]]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        spots = np.unique((mixed >> np.uint64(32)).astype(np.uint32))
        if not len(spots) and text:
            spots = np.array([xxh64_intdigest(" ".join(words) if words else text) >> 32], np.uint32)
        return spots


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets; two empty sets are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def as_text(spots: np.ndarray) -> str:
    return spots.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and n_spots of every whole text; null counts as empty."""
    anchors = anchor_words(docs, text_col) if anchors is None else anchors

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(anchors, chain)
        for batch in it:
            sets = [spotter(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int32())], ["doc_id", "fingerprint", "n_spots"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, fingerprint string, n_spots int")


def similar_sets(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b with jaccard >= threshold, membership doc_id -> rep) of distinct fingerprints.

    prints has doc_id and fingerprint.  rep is the smallest doc_id with a fingerprint; equal
    fingerprints are never paired, the membership tells them.  Empty sets have no partner.
    """
    reps = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    member = prints.join(reps, "fingerprint").select("doc_id", "rep")
    width = math.log(1 / threshold) if threshold < 1 else 1.0
    spots = F.regexp_extract_all("fingerprint", F.lit(".{8}"), F.lit(0))
    sets = reps.where(F.length("fingerprint") > 0).select("rep", F.array_distinct(spots).alias("spots"))
    each = sets.select("rep", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    rarity = each.groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rarity, "spot").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("ranked"))
    ranked = ranked.select("rep", "n", F.floor(F.log(F.col("n").cast("double")) / width).cast("int").alias("part"),
                           F.transform("ranked", lambda x: x["spot"]).alias("spots"))
    prefix = F.slice("spots", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    keyed = ranked.withColumn("key", F.explode(prefix))
    a = keyed.select(F.col("key"), F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("spots").alias("a_spots"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    b = keyed.select(F.col("key"), F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("spots").alias("b_spots"), "part")
    near = a.join(b, ["key", "part"]).where((F.col("a") != F.col("b")) & (F.least("a_n", "b_n") >= F.lit(threshold) * F.greatest("a_n", "b_n") - 1e-9))
    common = F.size(F.array_intersect("a_spots", "b_spots"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (common / (F.col("a_n") + F.col("b_n") - common)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= threshold).distinct(), member


def bucket_edges(drawn: list[int], many: int) -> list[tuple[int, int]]:
    """About many - 1 edges (id, hash) between sorted drawn ids; an id drawn for several edges is divided by hash."""
    picked = Counter(drawn[len(drawn) * k // many] for k in range(1, many)) if drawn else Counter()
    return sorted((i, NULL_ID + (1 << 64) * k // n) for i, n in picked.items() for k in range(n))


def neighbourhoods(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of neighbours by (id, hash of the text): bucket, extra, id, hash, packed (a compressed text).

    The rows of a bucket's least id are also sent to the bucket before it, as extra rows (those
    of the first bucket to the last one), so each text moves once and every row finds the
    next one beside it.  Edges come from a sample of the ids; any edges give the same.  There
    are BUCKETS edges for each shuffle partition at most, so what the driver and the tasks
    hold does not grow with the rows, and rows of one frequent id are spread by their hashes.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    many = max(1, min(total // BUCKET_ROWS, BUCKETS * shuffle_partitions(docs.sparkSession)))
    drawn = docs.select(key).sample(fraction=min(1.0, DRAWN * many / total), seed=1).collect() if many > 1 else []
    edges = bucket_edges(sorted(r["id"] for r in drawn), many)
    bucket_of = lambda ids, hashes: [bisect_right(edges, x) for x in zip(ids, hashes, strict=True)]

    def least(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in it:
            ids, hashes = (batch.column(k).to_pylist() for k in range(2))
            for n, i in zip(bucket_of(ids, hashes), ids, strict=True):
                if i < found.get(n, 1 << 63):
                    found[n] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "id"])

    # Texts are read for this only if an id is divided.
    divided = any(h != NULL_ID for _, h in edges)
    least_ids = docs.select(key, (F.xxhash64(text) if divided else F.lit(0).cast("bigint")).alias("hash")).mapInArrow(least, "bucket int, id bigint")
    firsts = sorted((r["bucket"], r["id"]) for r in least_ids.groupBy("bucket").agg(F.min("id").alias("id")).collect())
    before = {n: (first, firsts[k - 1][0]) for k, (n, first) in enumerate(firsts)}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in it:
            ids, hashes = (batch.column(k).to_pylist() for k in range(2))
            out: list[tuple] = []
            for n, i, h, text in zip(bucket_of(ids, hashes), ids, hashes, batch.column(2), strict=True):
                packed = squeeze(text.as_py().encode())
                out.append((n, 0, i, h, packed))
                if i == before[n][0]:
                    out.append((before[n][1], 1, i, h, packed))
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "extra", "id", "hash", "packed"])

    rows = docs.select(key, F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(batches, "bucket int, extra int, id bigint, hash bigint, packed binary")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the next document's, in ascending doc_id, the first following the last.  Null
    counts as empty; a null id comes first; rows of one id are ordered by a hash of their
    text.  An empty table gives no rows; other columns are ignored.
    """
    anchors = anchor_words(docs, text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(anchors, chain)
        open_up = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None
        for batch in it:
            out = []
            for bucket, extra, i, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if extra and last is None:
                    continue  # more rows of the id that begins the next bucket
                text = open_up(packed).decode()
                own = spotter(text)
                if last is not None and last[0] == bucket:
                    out.append(_compared(last, text, own, spotter))
                last = None if extra else (bucket, i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = neighbourhoods(docs, id_col, text_col)
    spread = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "extra", "id", "hash")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spread.mapInArrow(batches, schema)


def _compared(last: tuple, after: str, after_spots: np.ndarray, spotter: Spotter) -> tuple:
    _, i, text, own = last
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    spots = spotter(edited)
    return (None if i == NULL_ID else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(spots), likeness(own, spots), likeness(own, after_spots))


def op5_fingerprints(spark, sf_dir):
    return edited_likeness(documents(spark, sf_dir))
