"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's
likelihood sums over all ways to cut it into pieces (a forward pass), a text's is the
product over its words.  Piece probabilities come from expectation-maximisation over the
word counts of a bounded, stratified sample of labelled rows (`sample_rows`); the scoring
covers all rows and whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import crc_bucket, cut_lineage, documents, runs_of_rows

MODEL = "piece_bpe_32k.model"
#: Longest piece looked up, and words kept by a Python worker between batches.
LONGEST, REMEMBERED = 16, 200_000
#: Words up to so many characters are counted together; longer ones one by one, in logarithms.
PLAIN_CHARS = 48
#: Characters scored at a time, so that words of one length meet in one array.
PART_CHARS = 2_000_000


class Vocabulary(dict):
    """Pieces and their numbers, with a trie of their characters for searches over whole arrays.

    An arc's key is its node and its character; `keys` are sorted, `to` has the node an arc
    leads to, `piece` the number of the piece that ends at a node, or -1.
    """

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        nodes = {"": 0}
        for piece in ids:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        arcs = sorted((nodes[begin[:-1]] << 21 | ord(begin[-1]), node) for begin, node in nodes.items() if begin)
        self.keys, self.to = (np.array(column, np.int64) for column in zip(*arcs, strict=True))
        self.piece = np.array([ids.get(begin, -1) for begin in nodes], np.int32)


@cache
def pieces(path: str | None) -> Vocabulary:
    """Ordinary pieces of the vocabulary; then come an unknown character and "no piece".

    A piece of more than LONGEST characters is an error: no table here has room for it.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if too_long := [p for p in own if len(p) > LONGEST]:
        raise ValueError(f"pieces of more than {LONGEST} characters: {too_long[:5]}")
    return Vocabulary({p: i for i, p in enumerate(own)})


def lattice(words: list[str], vocab: dict[str, int]) -> np.ndarray:
    """Words of one length n -> ids[word, end - 1, length - 1] of the piece that ends there.

    All starts walk the trie together, each while a piece begins so; lengths that no piece
    has are left off.
    """
    trie = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
    many, n, unknown, none = len(words), len(words[0]), len(vocab), len(vocab) + 1
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full((many * n, min(n, LONGEST)), none, np.int32)
    out[:, 0] = unknown
    place, longest = np.arange(many * n), 1
    node, left = np.zeros(many * n, np.int64), n - place % n
    for size in range(1, out.shape[1] + 1):
        key = node << 21 | chars[place + size - 1]
        arc = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1)
        hit = trie.keys[arc] == key
        place, node, left = place[hit], trie.to[arc[hit]], left[hit]
        found = trie.piece[node]
        whole = found >= 0
        if whole.any():
            out[place[whole] + size - 1, size - 1] = found[whole]
            longest = size
        on = left > size
        place, node, left = place[on], node[on], left[on]
        if not len(place):
            break
    return out.reshape(many, n, -1)[:, :, :longest]


def forward(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """weights[word, end, length, ...] -> alpha[word, position, ...] and the log of its scale.

    Every eighth position the last LONGEST values are brought back to 1, so a word of
    any length keeps its precision.
    """
    many, n, most = weights.shape[:3]
    alpha = np.zeros((many, n + 1, *weights.shape[3:]))
    alpha[:, 0] = 1
    scale = np.zeros((many, *weights.shape[3:]))
    for i in range(1, n + 1):
        k = min(i, most)
        alpha[:, i] = (alpha[:, i - k:i][:, ::-1] * weights[:, i - 1, :k]).sum(axis=1)
        if i % 8 == 0:
            lo = max(0, i - LONGEST + 1)
            top = np.maximum(alpha[:, lo:i + 1].max(axis=1), 1e-300)
            alpha[:, lo:i + 1] /= top[:, None]
            scale += np.log(top)
    return alpha, scale


def word_scores(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """log P(word) for each language: len(words) x languages."""
    out = np.zeros((len(words), probs.shape[1]))
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    for n, at in by_length.items():
        step = 1 if n > 512 else max(1, 200_000 // (n * min(n, LONGEST)))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            if n > 512:
                out[part[0]] = _long_score("▁" + words[part[0]], vocab, probs)
                continue
            alpha, scale = forward(probs[lattice(["▁" + words[i] for i in part], vocab)])
            out[part] = np.log(np.maximum(alpha[:, n], 1e-300)) + scale
    return out


def _long_score(word: str, vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """The same for one long word, with a window of LONGEST positions in memory."""
    find, unknown = vocab.get, len(vocab)
    window, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for end in range(1, len(word) + 1):
        now = window[-1] * probs[find(word[end - 1], unknown)]
        for size in range(2, min(end, LONGEST) + 1):
            if (at := find(word[end - size:end])) is not None:
                now = now + window[-size] * probs[at]
        window = [*window[1 - LONGEST:], now]
        if end % 8 == 0:
            top = np.maximum(np.max(window, axis=0), 1e-300)
            window = [x / top for x in window]
            scale += np.log(top)
    return np.log(np.maximum(window[-1], 1e-300)) + scale


def expected_counts(rows: list[tuple[int, str, float]], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (languages x pieces) over (language, word, count) rows."""
    size = len(vocab) + 2
    total = np.zeros((probs.shape[1], size))
    by_length = defaultdict(list)
    for row in rows:
        if len(row[1]) <= PLAIN_CHARS:
            by_length[len(row[1]) + 1].append(row)
        else:
            _count_long("▁" + row[1], row[0], row[2], vocab, probs, total)
    for n, group in by_length.items():
        step = max(1, 400_000 // (n * min(n, LONGEST)))
        for lo in range(0, len(group), step):
            part = group[lo:lo + step]
            ids = lattice(["▁" + w for _, w, _ in part], vocab)
            lang, count = np.array([r[0] for r in part]), np.array([r[2] for r in part], float)
            weights = probs[ids, lang[:, None, None]]
            # No rescaling: PLAIN_CHARS characters stay far above the smallest double.
            alpha, beta = np.zeros((len(part), n + 1)), np.zeros((len(part), n + 1))
            alpha[:, 0], beta[:, n] = 1, 1
            most = weights.shape[2]
            for i in range(1, n + 1):
                k = min(i, most)
                alpha[:, i] = (alpha[:, i - k:i][:, ::-1] * weights[:, i - 1, :k]).sum(axis=1)
            for i in range(n, 0, -1):
                k = min(i, most)
                beta[:, i - k:i] += (beta[:, i, None] * weights[:, i - 1, :k])[:, ::-1]
            share = count / np.maximum(alpha[:, n], 1e-300)
            for k in range(most):
                use = alpha[:, : n - k] * weights[:, k:, k] * beta[:, k + 1:] * share[:, None]
                np.add.at(total, (np.broadcast_to(lang[:, None], use.shape), ids[:, k:, k]), use)
    return total


def _count_long(word: str, lang: int, count: float, vocab: dict[str, int], probs: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses of one long word, in logarithms, with one number for each position in memory."""
    with np.errstate(divide="ignore"):
        logs = np.log(probs[:, lang])
    find, unknown, n = vocab.get, len(vocab), len(word)

    def arcs(end: int) -> tuple[list[int], np.ndarray]:
        """Pieces that end there: lengths and numbers."""
        found = [(1, find(word[end - 1], unknown))] + [(k, p) for k in range(2, min(end, LONGEST) + 1) if (p := find(word[end - k:end])) is not None]
        return [k for k, _ in found], np.array([p for _, p in found])

    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for end in range(1, n + 1):
        sizes, ids = arcs(end)
        alpha[end] = np.logaddexp.reduce(alpha[[end - k for k in sizes]] + logs[ids])
    if alpha[n] == -np.inf:
        return
    for end in range(n, 0, -1):
        sizes, ids = arcs(end)
        onward = logs[ids] + beta[end]
        begin = [end - k for k in sizes]
        np.add.at(total[lang], ids, count * np.exp(alpha[begin] + onward - alpha[n]))
        beta[begin] = np.logaddexp(beta[begin], onward)


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample_rows: int, rounds: int,
        path: str | None) -> tuple[list[str], np.ndarray]:
    """Languages, and probabilities (pieces x languages), from rows whose language is known.

    Each language gives about sample_rows / languages rows, chosen by a hash of id and text.
    The driver sees counts by language and by piece only.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces(path)) + 2, 0))
    share = {l: min(1.0, sample_rows / len(langs) / sizes[l]) for l in langs}
    limit = F.element_at(F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(int(share[l] * (1 << 30))))]), F.col("lang"))
    picked = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < limit)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                found[lang.as_py()].update(text.as_py().split())
            rows = [(l, w, n) for l, words in found.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 2 + [pa.array([], pa.int64())], ["lang", "word", "n"])

    words = picked.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    number = {l: i for i, l in enumerate(langs)}
    size = len(pieces(path)) + 2
    probs = np.full((size, len(langs)), 1.0 / size)
    probs[-1] = 0
    for _ in range(rounds):
        now = probs

        def expect(it: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            vocab, total = pieces(path), np.zeros((len(number), size))
            for batch in it:
                rows = batch.to_pydict()
                total += expected_counts([(number[l], w, n) for l, w, n in zip(rows["lang"], rows["word"], rows["n"], strict=True)], vocab, now)
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "n"])

        counts = words.mapInArrow(expect, "lang bigint, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        total = np.full((size, len(langs)), 0.05)
        for r in counts.collect():
            total[r["piece"], r["lang"]] += r["n"]
        total[-1] = 0
        probs = total / total.sum(axis=0)
    return langs, probs


class Scorer:
    """Scores texts in a Python worker; remembers words it has met, the often met ones longest, within a bound."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str | None):
        self.langs, self.probs, self.vocab = langs, probs, pieces(path)
        self.at: dict[str, int] = {}
        self.known, self.met = np.zeros((1024, len(langs))), np.zeros(1024, np.int64)

    def _forget(self) -> None:
        """Keeps the half of the bound that was met most."""
        words = list(self.at)
        most = np.sort(np.argpartition(-self.met[:len(words)], REMEMBERED // 2)[:REMEMBERED // 2])
        self.known, self.met = self.known[most], self.met[most] // 2
        self.at = {words[k]: i for i, k in enumerate(most.tolist())}

    def _learn(self, new: list[str]) -> None:
        first, need = len(self.at), len(self.at) + len(new)
        if (more := need - len(self.met)) > 0:
            more = max(more, len(self.met))
            self.known = np.concatenate([self.known, np.zeros((more, len(self.langs)))])
            self.met = np.concatenate([self.met, np.zeros(more, np.int64)])
        self.known[first:need], self.met[first:need] = word_scores(new, self.vocab, self.probs), 0
        self.at.update(zip(new, range(first, need), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [], []
        judged = [text.split() if self.langs and text is not None and any(map(str.isalpha, text)) else None for text in texts]
        if len(self.at) > REMEMBERED:
            self._forget()
        if new := list({w for words in judged if words for w in words if w not in self.at}):
            self._learn(new)
        for words in judged:
            if words is None:
                lang.append("und")
                score.append(0.0)
                continue
            places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            np.add.at(self.met, places, 1)
            total = self.known[places].sum(axis=0)
            share = np.exp(total - total.max())
            lang.append(self.langs[int(total.argmax())])
            score.append(float(share.max() / share.sum()))
        return lang, score


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, text_col: str = "text", path: str | None = None,
            lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with a language and its posterior (equal priors) added.

    "und" with score 0 if the text is null or has no letter, or nothing was learned; equal
    posteriors go to the language first in alphabetical order.
    """
    table = docs.sparkSession.sparkContext.broadcast(probs)
    text_at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(langs, table.value, path)
        for batch in it:
            for at, rows in runs_of_rows(pc.utf8_length(batch.column(text_at)).to_pylist(), PART_CHARS):
                part = batch.slice(at, rows)
                lang, score = scorer(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, lang_name, score_name])
        pa.default_memory_pool().release_unused()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(batches, f"{fields}, `{lang_name}` string, `{score_name}` double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_rows: int = 8_000, rounds: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Learns from rows with a language whose crc32(doc_id as text) mod 4 is not 2; a null id
    counts as learned from.  Rows with repeated ids are scored one by one; an empty table
    gives no rows; other columns are ignored.
    """
    held = crc_bucket(id_col, 4) == 2
    langs, probs = fit(docs.where(~held), text_col, lang_col, id_col, sample_rows, rounds, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, langs, probs, "text", path).drop("text")


def op2_language(spark, sf_dir):
    return identify(documents(spark, sf_dir))
