"""Each operator against brute force on a small, awkward table, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from fieldspark.llm import bpe, chat, components, exact_dedup, golay, language_id, packing, pii, secrets, simhash, spotsigs, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, node string, chunks string, rank int, hash string, spans string, word string"
ANY = ("x", 1, None, 0, None, 1, "n", "c", 2, "h", "s", "w")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, *ANY[3:]) for i, t, lang in rows], SCHEMA)


def texts():
    draw = random.Random(5)
    words = ["the", "of", "idiot", "Haus", "maison", "una", "token", "alpha", "beta", "gamma", "delta"]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long = make(6000)
    out = [make(draw.randint(1, 60)) for _ in range(40)]
    out += [out[3], out[3].replace(" ", "  "), out[3] + " \n", None, "", "   ", None, "!!! 123", long, long + " x", "a" * 9000, "é" * 30, out[7], "one two", "<|endoftext|> x <|endoftext|>"]
    return out


def rows():
    return [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts())] + [(None, "no id here", "en"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_golay_lists_meet_at_one_bit():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 4000)
    other = words ^ (1 << draw.integers(0, 23, 4000))
    near, _ = golay.codeword_indices(other)
    _, lists = golay.codeword_indices(words)
    assert (lists == near[:, None]).any(axis=1).all()


def test_fuzzy_keys_find_every_pair_within_three_bits():
    draw = random.Random(2)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 3)):
            b ^= 1 << bit
        keys = []
        for x in (a, b):
            _, k = simhash.fuzzy_keys(np.array([x], np.uint64))
            keys.append(set(k.tolist()))
        assert keys[0] & keys[1]


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, _ in rows()]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, f in prints)
    component = {i: i for i, _ in prints if i is not None}
    for _ in range(8):
        for i, f in prints:
            for j, g in prints:
                if i is not None and j is not None and (f ^ g).bit_count() <= 3:
                    component[i] = component[j] = min(component[i], component[j])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == component
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).where("doc_id is not null").count() == len(set(component.values()))


def test_simhash_joins_chains_of_near_fingerprints(spark):
    draw = random.Random(4)
    prints, x = [], draw.getrandbits(64)
    for _ in range(300):
        for bit in draw.sample(range(64), 3):
            x ^= 1 << bit
        prints.append(x)
    nodes = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "node bigint, fp bigint")
    got = simhash.near_links(nodes).collect()
    assert {r["component"] for r in got} == {0} and len(got) == len(set(prints))


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, docs, empty, bits):
    more = [(3, "an id that has other texts too", "en"), (3, texts()[4], "en"), (None, texts()[5], None), (None, "中文字符没有空格" * 40, None), (99, "中文字符没有空格" * 40, None), (98, "0a1b2c3d4e5f" * 30, None)]
    got = exact_dedup.exact_duplicates(docs.unionByName(table(spark, more)), least=8, most=64, hash_bits=bits).collect()
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows() + more]
    groups = {}
    for i, t in normal:
        groups.setdefault(t, []).append(i)
    want = Counter((i, min(x for x in groups[t] if x is not None) if any(x is not None for x in groups[t]) else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got if r["doc_id"] is not None)
    assert exact_dedup.exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_one])
def test_rows_are_kept_one_by_one(spark, keep):
    a, b, c, d, e = ("alpha beta gamma", "one two three four", "delta epsilon zeta eta", "nothing like the rest", "some other words again")
    repeated = [(1, a, "en"), (5, a, "de"), (5, b, "en"), (None, a, "en"), (None, c, "en"), (None, c, "en"), (7, d, "en"), (7, d, "en"), (9, e, "en"), (8, e, "en"), (8, b, "en")]
    got = keep(table(spark, repeated).repartition(3))
    assert got.columns == table(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (5, b), (None, c), (7, d), (8, e)])
    assert keep(table(spark, [])).count() == 0


def test_chunks_cover_the_text(spark, docs):
    for r in exact_dedup.chunked(docs, "doc_id", "text", 8, 64).collect():
        assert hashlib.sha256("".join(r["chunks"]).encode()).hexdigest() == r["text_sha256"]


def brute_secrets(text):
    out = []
    for m in re.finditer(secrets.ASSIGN, text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs, empty):
    key = "AKIA" + "QZ7PL0XK3M9TR2VB"
    hexes = "0123456789abcdef" * 2
    made = [f"é🙂 API_KEY = \"{key}\" then secret: token: abcdefgh", f"password='x' passwd=abc123 {hexes}", f"{key}{key} ApiKey:{hexes}.", "secret: tok", hexes * 3, None, ""]
    d = table(spark, [(k, t, None) for k, t in enumerate(made)] + [(100 + i, t, None) for i, t, _ in rows() if i is not None])
    got = {r["doc_id"]: r for r in secrets.secret_report(d).collect()}
    for k, t in enumerate(made):
        want = brute_secrets(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
        assert [got[k][f"n_{n}"] for n in secrets.KINDS[:3]] == [want.count(n + ":") for n in secrets.KINDS[:3]]
    assert secrets.secret_report(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(d).collect()}
    assert clean[5] is None and hexes not in clean[4] and clean[0].startswith("é🙂 [secret]") and clean[3] == "secret: tok"


def test_markov_chains_tell_random_strings_from_words():
    draw = random.Random(6)
    letters = secrets.ALPHABET[:62]
    pairs = lambda values: Counter(a + b for v in values for a, b in zip(v, v[1:]))
    words = ["settingmanager", "document_writer", "theoreticalgroup", "connectionpool"] * 50
    noise = ["".join(draw.choice(letters) for _ in range(30)) for _ in range(400)]
    a, b = secrets.log_table(pairs(noise)), secrets.log_table(pairs(words))
    n = len(secrets.ALPHABET)
    score = lambda v: sum(a[k] - b[k] for x, y in zip(v, v[1:]) for k in [secrets.ALPHABET.index(x) * n + secrets.ALPHABET.index(y)])
    assert score("groupmanagerdocumentpool") < 0 < score("x9Kq2LmZ7TbV4RpW8sYd3HfG")


def test_bpe_equals_the_library(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, library = bpe.codec(), Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    draw = random.Random(7)
    pool = ["the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "é", "中文", "🙂", "́", "<|endoftext|>", "Ab", "123", "!!", "ing", "supercalifragilistic", "\x00", "ſ"]
    for _ in range(1500):
        s = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        want = library.encode(s, add_special_tokens=False).ids
        assert bpe.ids_of(own.packed(s)) == want == bpe.ids_of(bpe.codec(None, True).packed(s))
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect() if r["doc_id"] is not None}
    for i, t, _ in rows():
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0
    again = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).where("coalesce(text, '') <> decoded").count()
    assert again == 0


def fewest_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_dominance_reduction_loses_no_optimum():
    draw = random.Random(8)
    for _ in range(400):
        capacity = draw.randint(6, 30)
        items = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 9))), reverse=True)
        fixed, rest = packing.reduce(Counter(items), capacity)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for n, _ in fixed) + fewest_bins(left, capacity) == fewest_bins(items, capacity)


def test_packing(spark, docs, empty):
    got = packing.pack(docs).toPandas()
    known = {i: bpe.ids_of(bpe.codec().packed(t or "")) + [0] for i, t, _ in rows() if i is not None}
    for i, own in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.length.sum() == len(known[i]) and list(own.piece) == list(range(len(own))) and (own.length[1:] == packing.CAPACITY).all()
        for r in own.itertuples():
            assert zlib.crc32(np.array(known[i][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    placed = got.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert len(got.dropna(subset=["doc_id"]).groupby("doc_id")) == len(known)
    assert packing.pack(empty).count() == 0


def test_language(spark, sf_dir, docs, empty):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(real).toPandas().merge(real.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    awkward = {r["doc_id"]: r for r in language_id.identify(docs).collect() if r["doc_id"] is not None}
    assert all((awkward[i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)) for i, t, _ in rows() if i is not None)
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", docs.node.substr(5, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    probs = np.random.default_rng(0).random((8, 2))
    probs[7] = 0

    def brute(word):
        if not word:
            return np.ones(2)
        return sum((probs[vocab.get(word[:k], 6 if k == 1 else 7)] * brute(word[k:]) for k in range(1, min(4, len(word)) + 1)), np.zeros(2))

    for word in ("a", "abab", "abcab", "ab" * 5):
        assert np.allclose(language_id.word_scores([word], vocab, probs)[0], np.log(brute("▁" + word)))
    assert np.allclose(language_id._long_score("▁" + "ab" * 20, vocab, probs), language_id.word_scores(["ab" * 20], vocab, probs)[0])


def brute_spots(text, anchors):
    """Spot hashes of a text, word by word with plain integers."""
    full = (1 << 64) - 1
    words = re.findall(r"\w+", text.lower())
    code = lambda w: xxhash.xxh64_intdigest(w) & ~1 | (w in anchors)
    out = set()
    for k, w in enumerate(words):
        chain = [v for v in words[k + 1:] if v not in anchors][:spotsigs.CHAIN]
        if w in anchors and len(chain) == spotsigs.CHAIN:
            h = code(w)
            for v in chain:
                h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + code(v)) & full
            out.add(((h ^ (h >> 32)) * 0x94D049BB133111EB & full) >> 32)
    if not out and text:
        out = {xxhash.xxh64_intdigest(" ".join(words) if words else text) >> 32}
    return "".join(f"{x:08x}" for x in sorted(out))


@pytest.mark.parametrize("repeats", [0, 30])
def test_fingerprints(spark, docs, empty, monkeypatch, repeats):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    more = [(3, f"one id and another text {k} of the same, with the and of", "en") for k in range(repeats)]
    known = docs.where("doc_id is not null").unionByName(table(spark, more))
    got = Counter(tuple(r) for r in spotsigs.edited_likeness(known).collect())
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = [(i, t or "") for i, t, _ in sorted(((i, t or "", x) for i, t, x in rows() + more if i is not None), key=lambda r: (r[0], signed(r[1])))]
    counts = Counter(w for _, t in order for w in re.findall(r"\w+", t.lower()))
    anchors = set(sorted(counts, key=lambda w: (-counts[w], w))[:spotsigs.ANCHORS])
    want = Counter()
    for k, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        edited = t[: len(t) - half] + after[:half]
        prints = [brute_spots(x, anchors) for x in (t, edited, after)]
        sets = [{f[x:x + 8] for x in range(0, len(f), 8)} for f in prints]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *like] += 1
    assert got == want
    assert spotsigs.edited_likeness(empty).count() == 0
    assert spotsigs.edited_likeness(docs).count() == len(rows())


def test_similar_sets_against_brute_force(spark, docs):
    prints = spotsigs.fingerprints(docs.where("doc_id is not null")).select("doc_id", "fingerprint").cache()
    pairs, member = spotsigs.similar_sets(prints, 0.5)
    sets = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    reps = sorted({min(j for j in sets if sets[j] == f) for f in sets.values()})
    cut = lambda f: {f[x:x + 8] for x in range(0, len(f), 8)}
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and len(cut(sets[a]) & cut(sets[b])) >= 0.5 * len(cut(sets[a]) | cut(sets[b]))}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and member.count() == len(sets)


def test_pseudonyms(docs, empty):
    assert pii.pseudonymise(docs, "key").count() == len(rows()) and pii.pseudonymise(empty, "key").count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(30 * 7).select(F.array((F.col("id") % 30).cast("int"), F.floor(F.col("id") / 30).cast("int")).alias("s"))
    got = d.select(pii.feistel(F.col("s"), F.array(F.lit(30), F.lit(7)), F.lit("t"), "key").alias("s")).collect()
    assert len({tuple(r["s"]) for r in got}) == 210 and all(0 <= r["s"][0] < 30 and 0 <= r["s"][1] < 7 for r in got)


def enumerated(emission, trans):
    weight = {}
    for tags in np.ndindex(*[2] * len(emission)):
        weight[tags] = np.exp(sum(emission[k] * t for k, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
    return [sum(w for t, w in weight.items() if t[k]) / sum(weight.values()) for k in range(len(emission))]


def one_by_one(emission, trans):
    t, psi = np.exp(trans), np.stack([np.ones(len(emission)), np.exp(emission)], axis=1)
    fwd, bwd = np.ones((len(emission), 2)), np.ones((len(emission), 2))
    fwd[0] = psi[0]
    for k in range(1, len(emission)):
        fwd[k] = (fwd[k - 1] @ t) * psi[k]
        fwd[k] /= fwd[k].sum()
    for k in range(len(emission) - 2, -1, -1):
        bwd[k] = t @ (psi[k + 1] * bwd[k + 1])
        bwd[k] /= bwd[k].sum()
    return (fwd * bwd)[:, 1] / (fwd * bwd).sum(axis=1)


def test_marginals_against_enumeration():
    trans = np.array([[0.2, -0.4], [0.1, 0.9]])
    for emission in ([0.3, -1.0, 2.0, 0.5], [1.5], [-0.2, 0.1, 3.0, -4.0, 0.0, 1.0, -1.0]):
        assert np.allclose(toxicity.marginals(np.append(emission, np.nan), trans)[:-1], enumerated(emission, trans))


def test_long_chains_are_whole():
    draw = np.random.default_rng(13)
    values, trans = draw.normal(size=900) * 2, draw.normal(size=(2, 2))
    values[[0, 3, 4, 68, 700]] = np.nan
    got, inside = toxicity.marginals(values, trans), np.flatnonzero(~np.isnan(values))
    for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
        assert np.allclose(got[run], one_by_one(values[run], trans))
    assert (got[np.isnan(values)] == 0).all() and not len(toxicity.marginals(np.zeros(0), trans))


def test_scores_and_spans_against_a_plain_pass():
    field = toxicity.Field({"idiot": 6.0, "stupi*": 4.0}, -2.0, np.array([[0.3, -0.2], [-0.1, 0.4]]), np.array([-3.0, 5.0, 0.7]))
    texts = ["", "İİ you idiot idiot. Nice day", "STUPID\nidiot!", "one two " * 200 + "stupidly " * 70 + "end", "x. y. z"]
    scores, spans = field.score_all(texts)
    for text, score, found in zip(texts, scores, spans):
        p, where = [], []
        for sentence in re.finditer(r"[^.!?\n]+", text):
            words = list(re.finditer(r"\w+", sentence[0]))
            if words:
                e = np.array([-2.0 + 6.0 * (w[0].lower() == "idiot") + 4.0 * (w[0].lower().startswith("stupi") and len(w[0]) > 5) for w in words])
                p += one_by_one(e, field.trans).tolist()
                where += [(sentence.start() + w.start(), sentence.start() + w.end()) for w in words]
        x = field.curve @ [1.0, max(p, default=0.0), np.log1p(sum(v > 0.5 for v in p))]
        assert score == pytest.approx(1 / (1 + np.exp(-x)))
        hit = {k for (a, b), v in zip(where, p) if v > 0.5 for k in range(a, b)}
        assert hit <= {k for a, b, _ in found for k in range(a, b)}
        assert all(a in hit and b - 1 in hit and not re.search(r"[.!?\n]", text[a:b]) for a, b, _ in found)


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(real, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.predicted == got.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    assert got[(got.toxic == 1)].score.mean() > got[(got.toxic == 0)].score.mean() + 0.4
    none = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, none).where("predicted = 0").count() == len(rows())
    assert toxicity.score(empty, none).count() == 0


CHAT = "conv_id bigint, turn int, role string, text string, rendered int, part string"


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT)


def test_chat(spark, sf_dir):
    turns = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet")).cache()
    got = chat.conversation_report(turns).toPandas()
    written = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").count().toPandas().set_index("conv_id")["count"]
    assert dict(zip(got.conv_id, got.n_turns)) == written.to_dict()
    assert got.exact.mean() >= 0.85 and (got[got.held_out].roles_right == got[got.held_out].n_turns).mean() >= 0.8
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in turns.where("role is not null").collect())
    turns.unpersist()
    odd = chat_table(spark, [(None, 0, "user", "hi"), (1, None, None, None), (2, 0, "user", "a\n\n\nb"), (2, 0, "user", "a\n\n\nb"), (3, 2_500, "assistant", ""), (4, 999, "tool", "x"), (4, 1000, "tool", "y")])
    rows = chat.format_chats(odd)
    report = {r["conv_id"]: r for r in chat.conversation_report(rows).collect()}
    assert {k: r["n_turns"] for k, r in report.items()} == {None: 1, 1: 1, 2: 2, 3: 1, 4: 2}
    assert chat.conversation_report(chat.format_chats(odd.where("turn > 99999"))).count() == 0


def test_blank_lines_of_a_turn_stay():
    model = chat.Model({("mark", "user/first", "mark=user"): 50, ("mark", "user/later", "mark=none"): 50, ("start", "", "user/first"): 9, ("next", "user/first", "user/later"): 50, ("next", "user/later", "user/later"): 50})
    assert model.parse("User: a\n\n\n  b\nc  \n") == [("user", "a\n\n\n  b\nc")]
    assert model.parse(" \n\n") == []


def test_roles_are_learned(spark):
    turns = [(c, k, ("user", "tool")[k % 2], f"question {c} number {k}" + "?" * (k % 2 == 0)) for c in range(60) for k in range(6)]
    got = chat.format_chats(chat_table(spark, turns)).toPandas()
    assert set(got.role.dropna()) == {"user", "tool"} and got.exact.mean() > 0.8


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_long_conversation_in_many_tasks_is_parsed_as_one(spark, partitions):
    draw = random.Random(12)
    say = lambda: "\n".join(" ".join(draw.choice(["so", "what", "is", "it", "code:", "well"]) for _ in range(draw.randint(1, 9))) + draw.choice([".", "?"]) for _ in range(draw.randint(1, 3)))
    turns = [(7, k, ("user", "assistant")[k % 2], say()) for k in range(400)] + [(c, k, ("user", "assistant")[k % 2], say()) for c in range(20, 30) for k in range(4)] + [(None, k, "user", say()) for k in range(30)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        table = chat.sorted_turns(chat_table(spark, turns).repartition(3))
        assert table.select("part").distinct().count() == partitions
        model = chat.fit(table.where("not held_out"))
        found = chat.format_chats(chat_table(spark, turns).repartition(3)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = chat.Model({}, model.roles)
    whole = chat.fit(chat.sorted_turns(chat_table(spark, turns)).where("not held_out"))
    assert whole.start == model.start and whole.step == model.step and plain.states == model.states
    assert {k: dict(c) for k, c in whole._total.items()} == {k: dict(c) for k, c in model._total.items()}
    for conv in {t[0] for t in turns}:
        piece = chat.Piece(0, conv, False, 0)
        piece.turns = [t[1:] for t in turns if t[0] == conv]
        want = model.parse("\n\n".join(piece.written()))
        own = sorted((r for r in found if r["conv_id"] == conv and r["role"] is not None), key=lambda r: r["position"])
        joined = []
        for r in own:
            if r["goes_on"]:
                joined[-1] = (joined[-1][0], f"{joined[-1][1]}\n\n{r['text']}")
            else:
                joined.append((r["role"], r["text"]))
        assert joined == want


def test_many_markers_push_no_other_count_out(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"word{k // 3}: text\nnext{k}: more") for k in range(60)] + [(2, 0, "system", "rare start")]
    table = chat.sorted_turns(chat_table(spark, turns))
    got = chat.fit(table, most_marks=5)
    every = {(r["kind"], r["state"], r["value"]): r["n"] for r in chat.counted(table, got.roles).collect() if r["kind"] != "edge"}
    for state in ("user/first", "system/first"):
        every["start", "", state] = 1
    want = chat.Model(every, got.roles)
    assert got.start == want.start and got.step == want.step
    assert {k: c.total() for k, c in got._total.items()} == {k: c.total() for k, c in want._total.items()}
    assert all(c == want._total[k] for k, c in got._total.items() if k[0] != "mark")
    assert len({v for (kind, _), c in got._total.items() if kind == "mark" for v in c if v != "mark="}) == 5
    assert all(c[v] == want._total[k][v] for k, c in got._total.items() for v in c if v != "mark=")


def test_viterbi_against_enumeration():
    draw = random.Random(9)
    states = [f"{r}/{p}" for r in chat.ROLES for p in ("first", "later")]
    counts = Counter()
    for s in states:
        counts["start", "", s] = draw.randint(0, 9)
        for t in states:
            counts["next", s, t] = draw.randint(0, 9)
        for v in ("mark=none", "mark=user"):
            counts["mark", s, v] = draw.randint(0, 9)
    model = chat.Model(counts)
    seen = [["mark=none"], ["mark=user"], ["mark=none"], ["mark=none"]]
    value = lambda path: model.start[path[0]] + sum(model.emission(states[s], f) for s, f in zip(path, seen)) + sum(model.step[a][b] for a, b in zip(path, path[1:]))
    best = max(np.ndindex(*[6] * 4), key=value)
    assert value(tuple(states.index(s) for s in model.viterbi(seen))) == pytest.approx(value(best))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == list(cp.COLUMNS)
        sizes.append(kept.count())
    normal = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert sizes[2] == len(normal) and sizes[3] == sizes[4] <= sizes[2] <= sizes[1] <= sizes[0]
    assert all(not brute_secrets(r["text"] or "").count("hex") for r in kept.collect())
    packed = cp.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[4]
