"""Links between texts of alike shingle sets: rows found by banded minima of hashes, pairs by rare shingles, verified on the shingles themselves.

SimHash keys reach three bits, which texts of Jaccard 0.8 seldom keep.  A second search
finds those: each text has 80 minima over its shingles' hashes in 16 bands of five, and
a pair of Jaccard 0.8 shares no band with probability (1 - 0.8^5)^16 = 0.002.  Rows that
share a band with a row of another component go on.  Of n shingles, in one order for all
rows that has the rare ones first, a pair alike shares one among the first n/5 + 1 of
both (prefix filtering, exact), so rows meet there.  A large group of copies with edits
of their own starts with these edits and meets only where copies can be alike.  Pairs
that meet are compared on both whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldspark.llm import words
from fieldspark.llm.common import cut_lineage, drop_folder, runs_of_rows, stored
from fieldspark.llm.components import connected_components

SIZE, ALIKE = 5, 0.8
BANDS, ROWS = 16, 5
#: Cells of the table of shingle counts, by a part of the hash: some 4 MB in every task, whatever the input.
CELLS = 1 << 20
#: Bytes of a run of texts: short, since nothing is put together over a run.
RUN_CHARS = 1 << 20
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS + SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES, _PLACES = _FACTORS[:BANDS * ROWS], _FACTORS[BANDS * ROWS:]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = words.lowered()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> set[bytes]:
    """The distinct 5-word shingles of a text, A-Z lower-cased; of fewer words the whole sequence, of none nothing."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return set()
    return {b" ".join(found[at:at + SIZE]) for at in range(max(1, len(found) - SIZE + 1))}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle, repeats included, rows in order."""
    row, code, known = words.split(texts, _LOWER)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    of_word = np.array([xxh64_intdigest(w) for w in known.to_pylist()], np.uint64)[code]
    first = np.concatenate([[0], np.nonzero(np.diff(row))[0] + 1])
    count = np.diff(np.concatenate([first, [len(row)]]))
    # Words behind a short text's end count as zero in its only shingle.
    place = np.arange(len(row)) - np.repeat(first, count)
    starts = np.nonzero((place == 0) | (place + SIZE <= np.repeat(count, count)))[0]
    hashes = np.zeros(len(starts), np.uint64)
    for k in range(SIZE):
        at = np.minimum(starts + k, len(row) - 1)
        inside = (starts + k < len(row)) & (row[at] == row[starts])
        hashes += np.where(inside, of_word[at] * _PLACES[k], np.uint64(0))
    return row[starts], _mixed(hashes)


def minima(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, minima: a row of BANDS * ROWS) of the texts with a word."""
    owner, hashes = hashed(texts)
    if not len(owner):
        return owner, np.zeros((0, BANDS * ROWS), np.uint64)
    begin = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
    out = np.empty((len(begin), BANDS * ROWS), np.uint64)
    for j, factor in enumerate(_HASHES):
        out[:, j] = np.minimum.reduceat(hashes * factor, begin)
    return owner[begin], out


def _sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, keys)."""
    for whole in it:
        for batch in words.runs(whole, "text", RUN_CHARS):
            row, least = minima(batch.column(1))
            keys = np.zeros((len(row), BANDS), np.uint64)
            for k in range(ROWS):
                keys = _mixed(keys + least[:, k::ROWS] + _PLACES[k])
            keys = keys + np.arange(BANDS, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), lists], ["row", "keys"])


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, comp, text) -> (row, comp, bytes, packed)."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in it:
        raw = [t.as_py().encode() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in raw], pa.int64()), pa.array([squeeze(t) for t in raw], pa.binary())], ["row", "comp", "bytes", "packed"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with the owner (place in the run) and the hash of each distinct shingle."""
    open_up = zstandard.ZstdDecompressor().decompress
    for batch in it:
        for at, count in runs_of_rows(batch.column("bytes").to_pylist(), RUN_CHARS):
            run = batch.slice(at, count)
            owner, hashes = hashed(pa.array([open_up(t.as_py()).decode() for t in run.column("packed")], pa.string()))
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.append(True, (np.diff(owner) != 0) | (np.diff(hashes) != 0))[:len(owner)]
            yield run, owner[new], hashes[new]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CELLS)).astype(np.int64)


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed texts -> (cell, n): how many rows have a shingle there."""
    sums = np.zeros(CELLS, np.int64)
    for _, _, hashes in _sets(it):
        sums += np.bincount(_cell(hashes), minlength=CELLS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["cell", "n"])


def _rare_first(texts: DataFrame) -> DataFrame:
    """Packed texts -> (token, row, comp, n, left): a row's shingles that can be the first it shares with one alike.

    n: its distinct shingles; left: how many of them, rare ones first, come from this one on.
    Counts only make the order, so cells with several shingles cost time and no link.
    """
    found = texts.mapInArrow(_counted, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, np.uint32)
    table[found.column("cell").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 32) - 1)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, owner, hashes in _sets(it):
            times = shared.value[_cell(hashes)]
            order = np.lexsort((hashes, times, owner))
            owner, hashes, times = owner[order], hashes[order], times[order]
            n = np.bincount(owner, minlength=run.num_rows)
            left = np.repeat(np.cumsum(n), n) - np.arange(len(owner))
            # The least partner has 4/5 of the shingles, which must all be shared; a cell of one row has no other.
            keep = (5 * left >= 4 * n[owner]) & (times > 1)
            of = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), run.column("row").take(of), run.column("comp").take(of), pa.array(n[owner[keep]].astype(np.int32)), pa.array(left[keep].astype(np.int32))], ["token", "row", "comp", "n", "left"])

    return texts.mapInArrow(batches, "token bigint, row bigint, comp bigint, n int, left int")


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, their texts, their components) -> the components of the pairs that are alike."""
    open_up = zstandard.ZstdDecompressor().decompress
    cached = lru_cache(8)(lambda packed: shingles(open_up(packed).decode()))
    for batch in it:
        pairs = zip(batch.column(0), batch.column(1), strict=True)
        good = pa.array([jaccard(cached(a.as_py()), cached(b.as_py())) >= ALIKE for a, b in pairs], pa.bool_())
        yield batch.select(["a", "b"]).filter(good)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, a_comp, b_comp) of packed texts -> links (a, b) of components by pairs that are alike."""
    both = pairs.distinct().join(texts.select(F.col("row").alias("a"), F.col("packed").alias("a_text")), "a")
    both = both.join(texts.select(F.col("row").alias("b"), F.col("packed").alias("b_text")), "b")
    both = both.select("a_text", "b_text", F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    return cut_lineage(both.mapInArrow(_alike, "a bigint, b bigint").distinct())


def _end(name: str) -> list:
    return [F.col("token"), F.col("row").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("comp", "n", "left"))]


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a and b of one token and different components that can be alike if no rarer token is shared.

    Jaccard 4/5 is 9 shared >= 4 (a_n + b_n), and no more are shared than are left from this token on.
    """
    enough = 9 * F.least("a_left", "b_left").cast("bigint") >= 4 * (F.col("a_n").cast("bigint") + F.col("b_n"))
    met = a.join(b, "token").where((F.col("a_comp") != F.col("b_comp")) & enough)
    smaller = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(smaller, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pick("a_comp", "b_comp", "a_comp"), pick("b_comp", "a_comp", "b_comp"))


def joined_components(rows: DataFrame, known: DataFrame) -> DataFrame:
    """known (row, comp) with the components joined whose rows (row, text) are alike: Jaccard of 5-word shingles 0.8 or more.

    Rows are distinct longs, and so are components.  A text without a word is linked to
    nothing here.  Each token's rows are first compared with one of them (a star), the one
    with the fewest rarer shingles, which is the least edited; then only rows that are
    still in different components, and not both in the token's main one, meet.
    An empty table gives no rows.
    """
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    sketches = rows.mapInArrow(_sketched, "row bigint, keys array<bigint>")
    paths: list[str] = []
    sketches = stored(sketches.join(known, "row"), "sketches", paths)
    flat = sketches.select(F.explode("keys").alias("key"), "row", "comp")
    mixed = flat.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last")
    wanted = flat.join(mixed.select("key"), "key", "left_semi").select("row", "comp").distinct()
    texts = stored(rows.join(wanted, "row").select("row", "comp", "text").mapInArrow(_packed, "row bigint, comp bigint, bytes bigint, packed binary"), "texts", paths)
    tokens = stored(_rare_first(texts), "tokens", paths)
    hubs = tokens.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("left")).alias("rarer"), "row", "comp", "n", "left")).alias("hub"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    hubs = stored(hubs.where("first < last").select("token", "hub.*"), "hubs", paths)
    links = _verified(_met(hubs.select(*_end("a")), tokens.select(*_end("b"))), texts)
    joined = connected_components(links)
    renamed = lambda df, by: df.join(by.select(F.col("node").alias("comp"), "component"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
    # What the stars left: tokens whose rows are still in several components.
    rest = stored(renamed(tokens.join(hubs.select("token"), "token", "left_semi"), joined), "rest", paths)
    sizes = rest.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("token").agg(F.max(F.struct("rows", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"))
    main = stored(main.where("comps > 1").select("token", "main"), "main", paths)
    left = rest.join(main, "token")
    more = _verified(_met(left.where("comp <> main").select(*_end("a")), left.select(*_end("b"))), texts)
    for path in paths:
        drop_folder(rows.sparkSession, path)
    return renamed(known, connected_components(links.unionByName(more)))
