"""The corpus pipeline on a small, awkward table: every stage on what the one before it kept."""

import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import brute_fingerprint, brute_secrets
from test_models import judged

import corpus_pipeline as cp
from fieldspark.llm import bpe, language_id, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row bigint, word string, spans string"


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(31)
    words = {"en": "the house is over there and nobody knows why it was built so".split(), "de": "das haus ist dort und niemand weiß warum es so gebaut wurde".split()}
    make = lambda l, n: " ".join(draw.choice(words[l]) for _ in range(n))
    rows = [(i, make(l, draw.randint(5, 80)), l) for i, l in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[3][1], "de"), (101, rows[3][1].replace(" ", " \n", 1), "de"), (3, rows[3][1], "de"), (4, "the same id with another text entirely", "en"), (None, rows[6][1], "en"), (None, make("en", 30), None),
             (None, None, None), (102, "", "en"), (103, "  \t ", None), (104, "123 !!", "en"), (105, make("en", 6000), "en"), (106, make("de", 20) + " password = abc123XYZ and " + "0123456789abcdef" * 3, "de"),
             (107, "the house token qX7mZp2LrT9vBn4KwS8dYc3H is there", "en"), (105, make("en", 6000), "en")]
    rows += [(200 + i, make("en", 300), "en") for i in range(3)]
    rows += [(210 + i, rows[-1][1] + " so", "en") for i in range(3)]
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), 5, "w", "x") for r in rows], SCHEMA).repartition(4).cache()


def table(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def stage(spark, name, docs):
    return dict(cp.STAGES)[name](spark, docs, None)


def test_language_stage(spark, documents):
    learn = documents.where(language_id.crc_bucket("doc_id", 4) != 2)
    langs, probs = language_id.fit(learn, "text", "lang", "doc_id", 8_000, 2, None)
    judge = language_id.Scorer(langs, probs, None)
    want = Counter({r: n for r, n in table(documents).items() if (v := [x[0] for x in judge([r[1]])])[0] != "und" and v[1] >= 0.5})
    got = stage(spark, "language_id", documents)
    assert got.columns == list(cp.COLUMNS) and table(got) == want
    assert {r[0] for r in table(documents)} - {r[0] for r in want} == {102, 103, 104}


def test_exact_stage(spark, documents):
    groups = {}
    for r in table(documents):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    least = lambda rs: min((r[0] is None, r[0] or 0) for r in rs)
    got = stage(spark, "exact_dedup", documents)
    assert got.columns == list(cp.COLUMNS)
    kept = list(table(got).elements())
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in kept) == Counter(groups.keys())
    assert all((r[0] is None, r[0] or 0) == least(groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")]) for r in kept)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_stage_finds_edited_copies(spark):
    """Copies with a word or 2 % of the words replaced, all of Jaccard 0.8 or more, and halves, which are not."""
    draw = random.Random(5)
    make = lambda n: [f"w{draw.randint(0, 900)}" for _ in range(n)]
    texts, groups = [], []
    for g in range(60):
        base = make(draw.choice([60, 100, 200, 800]))
        copies = [base]
        for share in (0, 0.01, 0.02):
            copy = list(base)
            for at in draw.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = "other"
            copies.append(copy)
        copies.append(base[: len(base) // 2] + make(len(base) // 2))
        texts += [" ".join(c) for c in copies]
        groups.append(range(len(texts) - 5, len(texts)))
    shared = " ".join(make(50))
    texts += [" ".join([shared, *make(60)]) for _ in range(40)] + ["five words are not here", "Five words are not here", "four words are here"]
    got = {r[0] for r in stage(spark, "simhash_near_dedup", spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    want, sets = set(range(len(texts))), [five_words(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.discard(i)
    assert got == want and len(want) < len(texts) - 100 and all(g[4] in want and g[0] in want for g in groups)


def test_near_stage(spark, documents):
    rows = list(table(documents).elements())
    prints, sets = [brute_fingerprint(r[1]) for r in rows], [five_words(r[1]) for r in rows]
    near = lambda a, b: bool(a & b) and len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 or near(sets[i], sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    best = {}
    for g, r in zip(group, rows):
        best.setdefault(g, []).append((r[0] is None, r[0] or 0))
    got = stage(spark, "simhash_near_dedup", documents)
    assert got.columns == list(cp.COLUMNS)
    assert Counter(r[0] for r in table(got).elements()) == Counter(None if none else i for none, i in map(min, best.values()))


def test_near_stage_keeps_no_shuffle_files(spark, documents):
    """Its many small queries left thousands of shuffle files until the driver collected its garbage."""
    own = spark.conf.get("spark.local.dir")
    left = lambda: {f for _, _, names in os.walk(own) for f in names if f.startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, asked = left(), spark.conf.get(setting)
    kept = cp.drop_near_copies(spark, documents, "")
    end = time.time() + 20
    while left() - before and time.time() < end:  # executors delete them on their own time
        time.sleep(0.2)
    assert not left() - before
    assert spark.conf.get(setting) == asked
    assert 0 < kept.count() < documents.count()


def test_secret_stage(spark, documents):
    docs = documents.select("doc_id", "text")
    chains = secrets.fit(docs, secrets.found_spans(docs, "doc_id", "text"), "doc_id", "text", 20_000)
    want = Counter()
    for r, n in table(documents).items():
        if r[1] is None:
            want[(*r[:4], None)] += n
            continue
        spans = sorted([(int(a), int(b)) for a, b in (x.split(":")[1:] for x in brute_secrets(r[1]).split(",") if x)] + judged(r[1], chains, 9.2))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += r[1][at:a] + "[secret]"
            at = max(at, b)
        text = out + r[1][at:]
        want[r[0], text, r[2], r[3], len(text)] += n
    got = stage(spark, "secret_scan", documents)
    assert got.columns == list(cp.COLUMNS) and table(got) == want
    assert [r[1].count("[secret]") for r in want if r[0] == 106] == [2]  # this table is too small to train the chains for 107


def test_packing_stage(spark, documents):
    got = stage(spark, "best_fit_packing", documents).toPandas().sort_values(["sequence_id", "offset"])
    sizes = Counter()
    for r, n in table(documents).items():
        sizes[r[0]] += n * (len(bpe.ids_of(bpe.codec().packed(r[1] or ""))) + 1)
    assert got.length.sum() == sizes.total() and got.dropna(subset=["doc_id"]).groupby("doc_id").length.sum().to_dict() == {i: n for i, n in sizes.items() if i is not None}
    before = got.groupby("sequence_id").length.cumsum() - got.length
    assert (before == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_of_an_empty_table(spark, documents):
    empty = documents.where("doc_id = -1")
    for _, f in cp.STAGES:
        assert f(spark, empty, None).count() == 0


def test_run_joins_the_stages(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs = documents
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path)).cache()
    got = cp.run(spark, str(tmp_path))
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert Counter(map(tuple, got.select(pieces).collect())) == Counter(map(tuple, want.select(pieces).collect()))
    assert docs.count() and got.select(F.countDistinct("sequence_id")).first()[0] == want.select(F.countDistinct("sequence_id")).first()[0]
