"""Long tokens and many spans in linear time; null ids in links and samples; many roles."""

import random
import re
import time

from pyspark.sql import functions as F

from fieldspark.llm import bpe, chat, language_id, secrets, simhash
from test_llm import brute_secrets, chat_table


def seconds(job):
    begin = time.monotonic()
    out = job()
    return out, time.monotonic() - begin


def merged(spans, text, mask="[secret]"):
    """text with sorted (start, end) spans masked, one by one."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_a_token_of_a_million_characters_is_judged_in_seconds(spark):
    draw = random.Random(31)
    letters = secrets.ALPHABET[:64]
    rows = [(k, "".join(draw.choice(letters) for _ in range(250_000 * k))) for k in (1, 2, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id").cache()
    docs.count()
    table = [draw.uniform(-1, 1) for _ in range(len(secrets.ALPHABET) ** 2)]
    n = len(secrets.ALPHABET)
    for i, text in rows:
        one = docs.where(F.col("doc_id") == i).select(secrets.ratio(F.col("text"), table).alias("r"))
        got, took = seconds(lambda one=one: one.first()["r"])
        at = [secrets.ALPHABET.index(c) for c in text]
        assert abs(got - sum(table[a * n + b] for a, b in zip(at, at[1:]))) < 1e-4 * (1 + abs(got)) and took < 10
    got, took = seconds(lambda: {r["doc_id"]: r for r in secrets.secret_report(docs).collect()})
    assert len(got) == 3 and took < 30


def test_texts_of_many_spans_keep_their_offsets(spark):
    draw = random.Random(32)
    hexes = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(draw.randint(20, 30)))
    rows = []
    for i, n in enumerate((1, 255, 256, 257, 511, 512, 513, 10_000)):
        rows.append((i, "é🙂 ".join(draw.choice(["Token: ", "x ", "password="]) + hexes() for _ in range(n))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    clean, took = seconds(lambda: {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()})
    assert took < 60
    for i, text in rows:
        spans = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in got[i].split(",") if s]
        assert ",".join(s for s in got[i].split(",") if not s.startswith("markov")) == brute_secrets(text)
        assert clean[i] == merged(spans, text)


def test_a_word_of_a_million_letters_is_encoded_in_seconds():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, library = bpe.codec(), Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    draw = random.Random(33)
    for n in (250_000, 1_000_000):
        word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
        got, took = seconds(lambda word=word: bpe.ids_of(own.packed(word)))
        assert took < 10 and got == library.encode(word, add_special_tokens=False).ids


def plain_components(rows):
    """Least non-null id by row, from all pairs of rows within three bits and from equal smallest ids."""
    prints = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    least = {p: min((i for (i, _), q in zip(rows, prints) if q == p and i is not None), default=None) for p in prints}
    for a, p in enumerate(prints):
        for b, q in enumerate(prints):
            if (p ^ q).bit_count() <= 3 or (least[p] is not None and least[p] == least[q]):
                group[top(a)] = top(b)
    return [min((i for k, (i, _) in enumerate(rows) if top(k) == top(a) and i is not None), default=None) for a in range(len(rows))], prints


def test_rows_with_null_ids_link_others(spark, monkeypatch):
    made = {"a": 0b0, "b": 0b111, "c": 0b111111, "d": 1 << 63, "e": (1 << 63) | 1, "f": 0b11 << 40, "g": 0b11111 << 40, "h": 0xF0F0 << 20}
    rows = [(1, "a"), (None, "b"), (2, "c"), (None, "d"), (None, "e"), (5, "f"), (5, "h"), (7, "g"), (None, "g"), (2**63 - 1, "d"), (None, "zz" * 9)]
    fake = lambda text, size=3: made.get(text, 0x123456789ABCDEF)
    monkeypatch.setattr(simhash, "fingerprint", fake)
    want, prints = plain_components(rows)
    monkeypatch.undo()
    prints = [made.get(t, 0x123456789ABCDEF) for _, t in rows]
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for (i, _), p in zip(rows, prints)], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, i, t: table)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()), key=repr)
    assert got == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want)), key=repr)
    assert {c for i, _, c in got if i in (1, 2)} == {1} and (None, f"{0b111:016x}", 1) in got


def test_samples_of_rows_without_ids_stay_near_their_size(spark):
    rows = spark.range(40_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string"), F.lit(" more")).alias("text"), F.lit("en").alias("lang"))
    plan = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(0.1 * (1 << 30))))
    assert 3_600 < plan.count() < 4_400
    langs, probs = language_id.fit(rows, "text", "lang", "doc_id", 4_000, 1, None)
    assert langs == ["en"] and probs.shape[1] == 1
    found = secrets.found_spans(rows, "doc_id", "text")
    assert len(secrets.fit(rows, found, "doc_id", "text", 4_000)) == len(secrets.ALPHABET) ** 2


def test_ten_roles_are_all_learned(spark):
    names = [f"role{chr(97 + k)}" for k in range(10)]
    turns = [(c, k, names[(c + k) % 10], f"{names[(c + k) % 10]} speaks of matter {c} at {k}.") for c in range(120) for k in range(5)]
    model = chat.fit(chat.sorted_turns(chat_table(spark, turns)).where("not held_out"))
    assert model.roles == tuple(names)
    got = chat.format_chats(chat_table(spark, turns)).toPandas()
    marked = got[got.role_true.isin(names[8:])]
    assert set(got.role.dropna()) == set(names) and (marked.role == marked.role_true).mean() > 0.5
    assert re.fullmatch(r"role[a-j]", got.role.dropna().iloc[0])
