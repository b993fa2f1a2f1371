"""Source divergence audit: frequent terms by iceberg prefix refinement, sources compared over them.

Whole terms are many and mostly rare, prefixes few.  So a level counts, for each language, the
documents that hold a prefix of some bytes, and the next level extends only prefixes that enough
documents hold.  Prefixes that go on are passed to the next scan as a bitmap of a fixed size: it
never loses one, and one let through by chance is met again by the exact count of the complete
terms.  No table of terms ever passes through the driver or a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import words
from fieldspark.llm.common import cut_lineage, documents, small_batches, stored
from fieldspark.operators.stats import beside

#: Fixed value: ASCII bytes that are no letters end a term.
_TABLE = words.lowered(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))
#: Bits of the map of prefixes that go on: 2 MB, whatever the data.
MAP_BITS = 1 << 24
#: Bytes of a batch of texts on its way to Python, below a run's.
BATCH_BYTES = 7 << 20
#: Fixed value: what shares are counted in.
SCALE = 1_000_000_000


def _alive(bits: np.ndarray, langs: list[str], prefixes: pa.Array, pairs: np.ndarray) -> np.ndarray:
    """Which (language, prefix) pairs, coded as language * count of prefixes + prefix, have their bit."""
    seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in langs]
    content, n = prefixes.to_pylist(), max(len(prefixes), 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(content[p % n], seeds[p // n]) for p in pairs.tolist()), np.uint64, len(pairs))
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _cut(terms: pa.Array, length: int) -> tuple[np.ndarray, pa.Array]:
    """The number of each term's prefix, and the distinct prefixes as bytes."""
    coded = pc.binary_slice(terms.cast(pa.binary()), 0, length).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _living(run: pa.RecordBatch, before: int, bits: np.ndarray | None):
    """(row, term, times) of each row's distinct terms in a run whose prefix of `before` bytes goes on in its language; the terms; languages and their number by row."""
    rows, ids, times, terms = words.counted(run.column("text"), _TABLE)
    coded = run.column("lang").dictionary_encode()
    langs, lang_of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if bits is not None and len(rows):
        number, prefixes = _cut(terms, before)
        pairs, _, where = words.distinct(lang_of[rows] * len(prefixes) + number[ids])
        keep = _alive(bits, langs, prefixes, pairs)[where]
        rows, ids, times = rows[keep], ids[keep], times[keep]
    return rows, ids, times, terms, langs, lang_of


def _prefix_documents(docs: DataFrame, length: int, before: int, bits) -> DataFrame:
    """lang, prefix (bytes), docs: distinct documents by prefix of `length` bytes, in part sums; terms with a prefix that went out are left out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in words.runs(batch, "text", 2 * words.RUN_CHARS):
                rows, ids, _, terms, langs, lang_of = _living(run, before, bits.value if bits else None)
                if not len(rows):
                    continue
                number, prefixes = _cut(terms, length)
                held, _, _ = words.distinct(rows * len(prefixes) + number[ids])  # once for each document
                pairs, docs_of, _ = words.distinct(lang_of[held // len(prefixes)] * len(prefixes) + held % len(prefixes))
                names = pa.array(langs, pa.string()).take(pa.array(pairs // len(prefixes)))
                yield pa.RecordBatch.from_arrays([names, prefixes.take(pa.array(pairs % len(prefixes))), pa.array(docs_of)], ["lang", "prefix", "docs"])

    return docs.select("lang", "text").mapInArrow(batches, "lang string, prefix binary, docs bigint")


def _bitmap(frequent: DataFrame, size: int) -> np.ndarray:
    """The bitmap of (lang, prefix) rows, put together by Spark; the driver gets at most size / 64 words."""
    at = F.xxhash64("lang", "prefix").bitwiseAND(F.lit(size - 1))
    found = frequent.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64(lang, prefix) & {size - 1} & 63 as int))").alias("bit"))
    parts = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[parts.column("word").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint64)


def frequent_terms(docs: DataFrame, least: int = 10, levels: tuple[int, ...] = (4, 8), map_bits: int = MAP_BITS) -> DataFrame:
    """lang, term, lang_count, by: each term that at least `least` documents of a language hold, and its counts by source.

    docs: lang, source, text without nulls; each row is a document.  by: array of (source, count).
    levels: bytes of the prefixes of each level.
    """
    context, bits, before = docs.sparkSession.sparkContext, None, 0
    for length in levels:
        held = _prefix_documents(docs, length, before, bits).groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        bits, before = context.broadcast(_bitmap(held, map_bits)), length

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in words.runs(batch, "text", 2 * words.RUN_CHARS):
                row, term, times, terms, langs, lang_of = _living(run, before, bits.value if bits else None)
                if not len(row):
                    continue
                coded = run.column("source").dictionary_encode()
                sources, source_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                keys, docs_of, where = words.distinct((lang_of[row] * len(sources) + source_of[row]) * len(terms) + term)
                group, _, place = words.distinct(keys // len(terms))
                # Language and source in one string, the length of the first ahead.
                names = [f"{len(x)}:{x}{y}" for x, y in zip((langs[g // len(sources)] for g in group), (sources[g % len(sources)].as_py() for g in group), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(place)), terms.take(pa.array(keys % len(terms))), pa.array(docs_of.astype(np.int64)), pa.array(np.bincount(where, times, len(keys)).astype(np.int64))], ["group", "term", "docs", "n"])

    counted = docs.select("lang", "source", "text").mapInArrow(batches, "group string, term string, docs bigint, n bigint")
    counted = counted.groupBy("group", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    size, start = F.substring_index("group", ":", 1).cast("int"), F.instr("group", ":") + 1
    counted = counted.select(F.substr("group", start, size).alias("lang"), F.substr("group", start + size).alias("source"), "term", "docs", "n")
    whole = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_count"), F.collect_list(F.struct("source", "n")).alias("by"))
    return whole.where(F.col("docs") >= least).select("lang", "term", "lang_count", "by")


def _share(count, total, kinds):
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)), exact for any long."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(2)).cast("decimal(20,0)")
    return F.call_function("div", top, (total + 2 * kinds).cast("decimal(20,0)")) + F.lit(1)


def _pair_sums(terms: DataFrame, entries: int = 1 << 21) -> DataFrame:
    """(lang, zero, at, p) by term -> lang, i, j, value for i < j: sums over terms of the divergence of sources i and j.

    zero: shares of an absent term by source; at, p: the sources that hold the term, and its shares.
    A task holds a matrix of terms x sources of about `entries` numbers, and one row of results.
    """

    def sums(lang: str, zero: np.ndarray, at: list, p: list) -> pa.RecordBatch:
        shares = np.tile(zero, (len(at), 1))
        shares[np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at)] = np.concatenate(p)
        out = []
        for i in range(len(zero) - 1):
            a, b = shares[:, i:i + 1], shares[:, i + 1:]
            out.append(((a - b) ** 2 // (a + b)).sum(axis=0))
        i, j = np.triu_indices(len(zero), 1)
        values = np.concatenate(out) if out else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values)], ["lang", "i", "j", "value"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict = {}
        held = 0
        for batch in it:
            zeros, ats, ps = batch.column("zero"), batch.column("at"), batch.column("p")
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                if lang not in waiting:
                    waiting[lang] = (zeros[k].values.to_numpy(), [], [])
                zero, at, p = waiting[lang]
                at.append(ats[k].values.to_numpy())
                p.append(ps[k].values.to_numpy())
                held += len(zero)
                if held >= entries:
                    yield from (sums(x, *parts) for x, parts in waiting.items())
                    waiting, held = {}, 0
        yield from (sums(x, *parts) for x, parts in waiting.items())

    return terms.mapInArrow(batches, "lang string, i int, j int, value bigint").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10, levels: tuple[int, ...] = (4, 8), map_bits: int = MAP_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language are apart.

    Null text, lang and source count as ''.  A term is a run of letters (ASCII letters and all beyond
    ASCII), only A-Z lower-cased; a language keeps the terms that `least` of its rows hold.  Part pair
    compares each source with each other of its language over all kept terms, part term lists the
    `top` kept terms that a source has more of than its language.  A language without a kept term has
    pairs of value 0.  Rows are documents of their own, so repeated and null ids need no care; ties are
    ordered by item; an empty table gives no rows; extra columns are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    with small_batches(docs.sparkSession, BATCH_BYTES):
        terms = stored(frequent_terms(docs, least, levels, map_bits), "terms")
    flat = terms.select("lang", "term", "lang_count", F.explode("by").alias("g")).select("lang", "term", "lang_count", "g.source", "g.n")
    by_group = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_count").alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row for each source
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = cut_lineage(groups.na.fill(0, ["total", "kinds", "lang_total"]).withColumn("place", place))
    small = beside(groups)

    # Shares of each kept term in the groups that hold it.
    held = flat.join(small, ["lang", "source"]).select("lang", "source", "term", "place", _share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), _share(F.col("lang_count"), F.col("lang_total"), F.col("kinds")).alias("q"))
    held = stored(held, "shares")
    apart = F.expr("((p - q) * (p - q)) div (p + q)")  # shares are at most SCALE + 1, so the square fits a long
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    zero = F.when(F.col("kinds") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kinds"))).otherwise(F.lit(0).cast("bigint"))
    langs = beside(groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", zero.alias("zero"), "source"))).alias("g")).select("lang", F.col("g.zero").alias("zero"), F.col("g.source").alias("sources")))
    vectors = held.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p")).alias("x")).select("lang", F.col("x.place").alias("at"), F.col("x.p").alias("p"))
    sums = _pair_sums(vectors.join(langs, "lang").select("lang", "zero", "at", "p"))
    both = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    sums = sums.select("lang", "value", both.alias("e")).select("lang", "e.a", "e.b", "value")
    ends = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    pairs = ends.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(by_term)


def op12_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counts AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM tokens t JOIN kept USING (lang, term) GROUP BY ALL
), kinds AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL
), lang_counts AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL
), lang_totals AS (
  SELECT lang, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN kinds v USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_shares AS (
  SELECT lang, term, 1 + (1000000000 * (c.n + 2)) // (t.n + 2 * v) AS q FROM lang_counts c JOIN lang_totals t USING (lang) JOIN kinds USING (lang)
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
