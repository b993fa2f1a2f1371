"""The second search of the near-copy stage: components as all pairs give them, from few pairs."""

import random
import re
import tracemalloc
from collections import defaultdict

import pyarrow as pa

from fieldspark.llm import shingle_links, simhash


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    sets, group = [sets_of(t) for t in texts], list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])) > 0 and top(i) != top(j):
                group[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def found(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row bigint, text string").repartition(3)
    got = shingle_links.joined_components(rows, rows.selectExpr("row", "row as comp")).collect()
    return [r["comp"] for r in sorted(got, key=lambda r: r["row"])]


def test_a_large_group_of_edited_copies_meets_in_few_pairs(spark, monkeypatch):
    """Copies with 0 to 20 words replaced by words of their own: most are alike with none, though all share most shingles."""
    draw, made = random.Random(3), []
    base = [f"w{draw.randint(0, 900)}" for _ in range(150)]
    texts = []
    for i in range(400):
        copy = list(base)
        for at in draw.sample(range(150), draw.randint(0, 20) if i else 0):
            copy[at] = f"own{i}-{at}"
        texts.append(" ".join(copy))
    draw.shuffle(texts)
    verified = shingle_links._verified
    monkeypatch.setattr(shingle_links, "_verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    got = found(spark, texts)
    assert got == components(texts) and 200 < len(set(got)) < 390
    assert sum(made) < 40 * len(texts)


def test_sizes_and_shared_parts(spark):
    """Pairs of exactly 0.8 and just below, of different sizes, chains, short and empty texts."""
    draw = random.Random(4)
    make = lambda n: [f"x{draw.randint(0, 10**6)}" for _ in range(n)]
    texts = ["", None, " \n ", "one", "ONE", "one two", "a b c d e", "A b c d e", "a b c d e f", "a b c d f"]
    for n in (4, 5, 20, 36, 80, 200):
        base = make(n + 4)  # n shingles
        texts += [" ".join(x) for x in (base, base + make(n // 4), base + make(n // 4 + 1), base[: len(base) - n // 5], make(3) + base[3:])]
    chain = make(120)
    for k in range(12):
        chain = [*chain[6:], *make(6)]
        texts.append(" ".join(chain))
    assert found(spark, texts) == components(texts)


def test_minima_are_taken_in_short_runs():
    """What Python holds beside a batch of texts while it takes their minima."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randint(0, 3000)}" for _ in range(500)) for _ in range(1400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row", "text"])
    tracemalloc.start()
    got = sum(part.num_rows for part in shingle_links._sketched(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(texts) and peak < 8 * sum(map(len, texts)), peak / sum(map(len, texts))


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    name, seen, joined = "spark.sql.execution.arrow.maxBytesPerBatch", [], simhash.joined_components
    before = spark.conf.get(name)
    monkeypatch.setattr(simhash, "joined_components", lambda *rest: seen.append(spark.conf.get(name)) or joined(*rest))
    kept = simhash.keep_one(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}
    assert seen == [f"{simhash.BATCH_BYTES}b"] and spark.conf.get(name) == before
