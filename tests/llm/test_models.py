"""Language model, packing and secret chains against plain Python forms, and the recall of added secret spans."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import language_id, packing, secrets

WORDS = {"en": "the house is over there and nobody knows why", "de": "das haus ist dort drüben und niemand weiß warum", "fr": "la maison est là bas et personne ne sait pourquoi"}
LONG = "verylongwordwithoutanyspace" * 4 + "é中" * 9


def labelled(spark):
    draw = random.Random(21)
    rows = [(i, " ".join(draw.choices(WORDS[l].split(), k=draw.randint(1, 12))) + (f" {LONG}{i}" if i % 7 == 0 else ""), l, 1, "x") for i, l in enumerate(list(WORDS) * 20)]
    rows += [(1000, None, "en", 1, "x"), (1001, "no language", None, 1, "x"), (1002, "", "de", 1, "x"), (None, "12 34", None, 1, "x"), (1004, "unseen zzz words", None, 1, "x")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n bigint, word string")


def pieces_at(word, end, vocab):
    """(length, number) of the pieces that end at a place; a single character is always one."""
    for k in range(1, min(end, language_id.LONGEST) + 1):
        piece = vocab.get(word[end - k:end], len(vocab) if k == 1 else None)
        if piece is not None:
            yield k, piece


def plain_forward(word, vocab, probs):
    alpha = [1.0]
    for end in range(1, len(word) + 1):
        alpha.append(sum(alpha[end - k] * probs[p] for k, p in pieces_at(word, end, vocab)))
    return alpha


def plain_training(rows, rounds):
    """Expectation-maximisation, a word at a time."""
    vocab = language_id.pieces(None)
    words = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            words[lang].update(text.split())
    langs, size = sorted(words), len(vocab) + 2
    probs = {l: np.full(size, 1 / size) for l in langs}
    for l in langs:
        probs[l][-1] = 0
        for _ in range(rounds):
            total = np.full(size, 0.05)
            for w, n in words[l].items():
                w = "▁" + w
                now = np.array(probs[l])
                alpha, beta = [0.0], [-math.inf] * len(w) + [0.0]
                logs = lambda p: math.log(now[p]) if now[p] > 0 else -math.inf
                add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs)) if xs and max(xs) > -math.inf else -math.inf
                for end in range(1, len(w) + 1):
                    alpha.append(add([alpha[end - k] + logs(p) for k, p in pieces_at(w, end, vocab)]))
                for end in range(len(w), 0, -1):
                    for k, p in pieces_at(w, end, vocab):
                        beta[end - k] = add([beta[end - k], logs(p) + beta[end]])
                for end in range(1, len(w) + 1):
                    for k, p in pieces_at(w, end, vocab):
                        total[p] += n * math.exp(alpha[end - k] + logs(p) + beta[end] - alpha[-1])
            total[-1] = 0
            probs[l] = total / total.sum()
    return langs, np.array([probs[l] for l in langs]).T


def test_language_model_against_plain_training_and_scoring(spark):
    rows, table = labelled(spark)
    langs, probs = language_id.fit(table, "text", "lang", "doc_id", 10_000, 2, None)
    want_langs, want = plain_training(rows, 2)
    assert langs == want_langs and np.allclose(probs, want, rtol=1e-9, atol=1e-15)
    vocab = language_id.pieces(None)
    got = language_id.predict(table, langs, probs).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r in got:
        text = r["text"]
        if text is None or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        if LONG in text:
            continue  # too small for plain products; test_forward_sums_all_segmentations has long words
        logs = np.array([sum(math.log(plain_forward("▁" + w, vocab, probs[:, k])[-1]) for w in text.split()) for k in range(len(langs))])
        share = np.exp(logs - logs.max())
        assert r["lang_pred"] == langs[int(logs.argmax())] and r["score"] == pytest.approx(share.max() / share.sum())


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= s]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= s
        else:
            bins.append(capacity - s)
    return Counter(bins)


def test_best_fit_equals_a_plain_one():
    draw = random.Random(22)
    for _ in range(300):
        capacity = draw.randint(5, 60)
        counts = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 120)))
        got = Counter()
        placed = Counter()
        for n, content in packing.best_fit(dict(counts), capacity):
            got[capacity - sum(s * k for s, k in content)] += n
            for s, k in content:
                placed[s] += n * k
        assert got == plain_best_fit(list(counts.elements()), capacity) and placed == counts


def test_slots_hold_each_item_once():
    draw = random.Random(23)
    for _ in range(100):
        counts = Counter(draw.randint(1, 64) for _ in range(draw.randint(1, 300)))
        plan, used, fill = packing.slots(dict(counts), 64), Counter(), Counter()
        for size, lo, hi, first, each, at in plan:
            used[size] += hi - lo
            for rank in range(lo, hi):
                fill[first + (rank - lo) // each] += size
        fixed, rest = packing.reduce(dict(counts), 64)
        assert used == counts and max(fill.values()) <= 64
        assert len(fill) == sum(n for n, _ in fixed) + plain_best_fit(list(Counter(rest).elements()), 64).total()


def test_hot_lengths_are_ranked_in_buckets(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(1500)] + [(i, "x " * (i % 9)) for i in range(1500, 1700)], "doc_id bigint, text string")
    got = packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    before = got.groupby("sequence_id").length.cumsum() - got.length
    assert len(got) == 1700 and (before == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert got.sequence_id.nunique() == -(-got.length.sum() // packing.CAPACITY)


def judged(text, table, log_odds):
    """Spans of added tokens: outside all base spans, with a sum of log ratios over log_odds."""
    base = [m.span() for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 6]
    base += [m.span() for p in (r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}") for m in re.finditer(p, text)]
    n, place = len(secrets.ALPHABET), secrets.ALPHABET.index
    out = []
    for m in re.finditer(secrets.TOKEN, text):
        ratio = sum(table[place(a) * n + place(b)] for a, b in zip(m[0], m[0][1:]))
        if ratio > log_odds and not any(a < m.end() and m.start() < b for a, b in base):
            out.append(m.span())
    return out


def test_added_spans_equal_a_plain_scan_and_find_planted_strings(spark):
    """Random strings of 20 to 40 letters and digits, put between the words of real texts: recall of 0.9 or more, no clean word flagged often."""
    draw = random.Random(24)
    real = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted, rows = {}, []
    for i, text in real:
        words = text.split(" ")
        if i % 3 == 0 and len(words) > 3:
            token = "".join(draw.choice(letters) for _ in range(draw.randint(20, 40)))
            at = draw.randrange(len(words))
            text = " ".join([*words[:at], token, *words[at:]])
            begin = len(" ".join(words[:at])) + (1 if at else 0)
            planted[i] = (begin, begin + len(token))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").cache()
    found = secrets.found_spans(docs, "doc_id", "text").cache()
    table = secrets.fit(docs, found, "doc_id", "text", 20_000)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in secrets.secret_spans(docs).select("doc_id", "added").collect()}
    assert got == {i: judged(t, table, 9.2) for i, t in rows}
    hits = sum(any(a <= x and y <= b for a, b in got[i]) for i, (x, y) in planted.items())
    assert len(planted) > 200 and hits / len(planted) >= 0.9
    wrong = sum(len(got[i]) - (i in planted) for i, _ in rows if len(got[i]) > (i in planted))
    print("planted", len(planted), "found", hits, "others", wrong, "documents", len(rows))
    assert docs.where(F.col("doc_id").isNull()).count() == 0


@pytest.mark.parametrize("text", [None, "", "x" * 5000, "A1" * 3000, " ".join("key=" + "v" * k for k in range(30))])
def test_awkward_texts_have_spans(spark, text):
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    assert secrets.secret_report(docs).count() == 3 and secrets.redact(docs).count() == 3


def test_pieces_too_long_for_the_tables_are_an_error(monkeypatch):
    assert max(map(len, language_id.pieces(None))) <= language_id.LONGEST
    monkeypatch.setattr(language_id, "LONGEST", 10)
    with pytest.raises(ValueError, match="more than 10 characters"):
        language_id.pieces.__wrapped__(None)
