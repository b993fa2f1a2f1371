"""Source divergence against its SQL on awkward rows, and level by level."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from fieldspark.llm import divergence, words
from fieldspark.llm.common import small_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, value bigint, rank int, item string, part string, n bigint, p bigint, term string"
ANY = (5, 1, "i", "p", 3, 9, "t")


def rows():
    draw = random.Random(3)
    words = ["alpha", "Alphabet", "al", "BETA", "été", "Été", "don't", "x1y2", "語の", "gamma", "prefixes", "prefixed"]
    out = []
    for k in range(160):
        text = " ".join(draw.choice(words[: 3 + k % 10]) + draw.choice(["", ".", "!", "\n"]) for _ in range(draw.randint(0, 30)))
        out.append((k if k % 7 else None, text, draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s1", "S2", "", None, "é"])))
    out += [(1, "alpha beta", "en", "s1")] * 12  # repeated rows are documents of their own
    out += [(900, None, "fr", "a"), (901, "seul", "fr", "b"), (902, "", "it", "only"), (903, "word " * 9000, "en", "long")]
    return out


def against_sql(spark, table, **how):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if table:
        con.executemany("insert into documents values (?, ?, ?, ?)", table)
    docs = spark.createDataFrame([(*r, *ANY) for r in table], SCHEMA).repartition(3)
    got = sorted(map(tuple, divergence.divergence(docs, **how).collect()))
    want = sorted(con.execute(divergence.OP12_SQL).fetchall())
    assert got == want
    return got


@pytest.mark.parametrize("how", [{}, {"levels": (1, 2, 3, 4, 5), "map_bits": 64}, {"levels": ()}])
def test_divergence_equals_its_sql(spark, how):
    got = against_sql(spark, rows(), **how)
    assert {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "a", "pair", "b", 0, 1) in got


def test_no_documents(spark):
    assert against_sql(spark, []) == []


def test_a_level_counts_documents_and_extends_only_what_goes_on(spark):
    docs = spark.createDataFrame([("en", "abc abd"), ("en", "abc"), ("en", "xyz xyz xyz")], "lang string, text string")
    counts = {(r["lang"], bytes(r["prefix"])): r["docs"] for r in divergence._prefix_documents(docs, 2, 0, None).groupBy("lang", "prefix").agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "docs").collect()}
    assert counts == {("en", b"ab"): 2, ("en", b"xy"): 1}
    going = docs.sparkSession.createDataFrame([("en", bytearray(b"ab"))], "lang string, prefix binary")
    bits = spark.sparkContext.broadcast(divergence._bitmap(going, 1 << 16))
    left = {bytes(r["prefix"]) for r in divergence._prefix_documents(docs, 3, 2, bits).collect()}
    assert left == {b"abc", b"abd"}


def test_counts_beyond_a_long_product(spark):
    d = spark.createDataFrame([(10**15, 10**16, 5)], "n bigint, total bigint, kinds bigint")
    assert d.select(divergence._share(d["n"], d["total"], d["kinds"])).first()[0] == 1 + (10**9 * (10**15 + 2)) // (10**16 + 10)


def test_a_run_is_counted_in_parts(monkeypatch):
    draw = random.Random(5)
    known = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'x' * (k % 5)}" for k in range(3000)]
    texts = [None, "", "A a\tB"] + [" ".join(draw.choices(known, k=600)) for _ in range(500)]
    row, number, found = words.split(pa.array(texts), divergence._TABLE)
    want = Counter(zip(row.tolist(), found.take(pa.array(number)).to_pylist(), strict=True))
    sizes, split = [], words.split
    monkeypatch.setattr(words, "split", lambda x, table: sizes.append(sum(len(t or "") for t in x.to_pylist())) or split(x, table))
    run = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    at, number, times, found, *_ = divergence._living(run, 0, None)
    assert len(sizes) > 1 and max(sizes) <= 1 << 20 and sum(sizes) == sum(len(t or "") for t in texts)
    assert dict(zip(zip(at.tolist(), found.take(pa.array(number)).to_pylist(), strict=True), times.tolist(), strict=True)) == want
    assert [len(x) for x in words.counted(pa.array([None, ""]), divergence._TABLE)] == [0, 0, 0, 0]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    name, seen, kept = "spark.sql.execution.arrow.maxBytesPerBatch", [], divergence.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(divergence, "stored", lambda df, *rest: seen.append(spark.conf.get(name)) or kept(df, *rest))
    against_sql(spark, rows()[:40])
    assert seen[0] == f"{divergence.BATCH_BYTES}b" and spark.conf.get(name) == before
    docs = spark.createDataFrame([("x" * 1000,)] * 400, "text string").coalesce(1)
    with small_batches(spark, 50_000):
        sizes = [r["n"] for r in docs.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it), "n bigint").collect()]
    assert sum(sizes) >= 400_000 and max(sizes) < 60_000
