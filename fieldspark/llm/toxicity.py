"""Toxicity by a linear-chain conditional random field over tokens.

Labels are given for documents only, so tokens are labelled first: in a toxic document, the
words and word beginnings that toxic documents use far more often than clean ones.  The
field (tags clean and toxic, weights per word and beginning, a transition table) is trained
on all sentences of a bounded sample of labelled rows; a chain is a whole sentence, however
long.  Forward-backward marginals of all tokens of a document give the offending spans and,
through a logistic curve fitted on the same sample, the score.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import crc_bucket, documents, runs_of_rows

TOKEN = re.compile(r"\w+|[.!?\n]")
#: Tokens of a chain that are worked through one by one; longer chains are joined exactly from such blocks.
BLOCK = 64
_BREAKS = frozenset(".!?\n")
_LOG_ODDS = 30.0
#: Lengths of the word beginnings that are features.
STEMS = (5, 6, 7)
_KEPT = 300_000
#: Characters of texts that are scored together.
_PART_CHARS = 1_000_000
#: Pairs of tokens whose marginals are summed together in training.
_PAIRS = 1 << 17


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class _Emissions(dict):
    """Emission log-odds of words, summed from their features when first met; bounded."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        """word: a token as it is written; features belong to its lower-cased form."""
        if len(self) > _KEPT:
            self.clear()
        get = self.weights.get
        value = np.nan if word in _BREAKS else self.bias + sum(get(f, 0.0) for f in word_features(word.lower()))
        self[word] = value
        return value

    def __reduce__(self):
        return _Emissions, (self.weights, self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -_LOG_ODDS, _LOG_ODDS)))


class Chains:
    """The chains of a flat array of tokens, cut into blocks that are grouped by length.

    groups: numbers of blocks, and their positions (length x blocks, -1 behind a block's end); first,
    last: whether a block begins or ends its chain.  Blocks of a chain have neighbouring numbers.
    """

    def __init__(self, breaks: np.ndarray):
        at = np.flatnonzero(~breaks)
        self.size = len(breaks)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(at):
            return
        new = np.concatenate([[True], np.diff(at) > 1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        begin = np.flatnonzero(new | ((np.arange(len(at)) - start) % BLOCK == 0))
        size = np.diff(np.concatenate([begin, [len(at)]]))
        self.first = new[begin]
        self.last = np.concatenate([self.first[1:], [True]])
        # Blocks are grouped by lengths rounded up, so few groups run through few steps.
        step = np.minimum(BLOCK, -(-size // 4) * 4)
        for n in np.unique(step):
            blocks = np.flatnonzero(step == n)
            inside = np.arange(n)[:, None] < size[blocks]
            place = at[np.minimum(begin[blocks] + np.arange(n)[:, None], len(at) - 1)]
            self.groups.append((blocks, np.where(inside, place, -1).astype(np.int32)))

    def odds(self, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of every token (0 at breaks), over whole chains."""
        fwd, bwd = np.zeros(self.size), np.zeros(self.size)
        if not self.groups:
            return fwd, bwd
        before, after = self._edges(emission, trans)
        for blocks, place in self.groups:
            own = place >= 0
            f, b = odds(np.where(own, emission[place], 0.0), trans, before[blocks], after[blocks], own)
            fwd[place[own]], bwd[place[own]] = f[own], b[own]
        return fwd, bwd

    def _edges(self, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every block: forward log-odds of the token before it (NaN: none), backward log-odds of its last token."""
        many = len(self.first)
        before, after = np.full(many, np.nan), np.zeros(many)
        split = ~(self.first & self.last)
        if not split.any():
            return before, after
        t = np.exp(np.clip(trans, -_LOG_ODDS, _LOG_ODDS))
        whole = np.zeros((many, 2, 2))
        for blocks, place in self.groups:
            keep = split[blocks]
            if not keep.any():
                continue
            place, own = place[:, keep], place[:, keep] >= 0
            e = np.exp(np.clip(np.where(own, emission[place], 0.0), -_LOG_ODDS, _LOG_ODDS))
            product = np.broadcast_to(np.eye(2), (place.shape[1], 2, 2)).copy()
            # The first token of a chain is reached by no transition.
            enter = np.where(self.first[blocks[keep]][:, None, None], np.eye(2), t)
            for k in range(len(place)):
                moved = (product @ (t if k else enter)) * np.stack([np.ones(place.shape[1]), e[k]], axis=1)[:, None, :]
                product = np.where(own[k, :, None, None], moved / moved.max(axis=(1, 2), keepdims=True), product)
            whole[blocks[keep]] = product
        for block in np.flatnonzero(split & ~self.last):
            entry = 1.0 if self.first[block] else np.exp(np.clip(before[block], -_LOG_ODDS, _LOG_ODDS))
            out = np.array([1.0, entry]) @ whole[block]
            before[block + 1] = np.log(max(out[1], 1e-300)) - np.log(max(out[0], 1e-300))
        for block in np.flatnonzero(split & ~self.first)[::-1]:
            out = whole[block] @ np.array([1.0, np.exp(np.clip(after[block], -_LOG_ODDS, _LOG_ODDS))])
            after[block - 1] = np.log(max(out[1], 1e-300)) - np.log(max(out[0], 1e-300))
        return before, after


def odds(emission: np.ndarray, trans: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds (toxic over clean) of blocks: each length x n.

    before: forward log-odds of the token ahead of each block (NaN: a chain begins); after:
    backward log-odds of its last token; own: false in the padding behind it.  Only ratios
    matter with two tags: the recursion on log-odds is
    r' = e + log((T01 + T11 exp r) / (T00 + T10 exp r)).
    """
    t = np.exp(np.clip(trans, -_LOG_ODDS, _LOG_ODDS))

    def onward(r):
        x = np.exp(np.clip(r, -_LOG_ODDS, _LOG_ODDS))
        return np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))

    fwd, bwd = np.empty_like(emission), np.empty_like(emission)
    fwd[0] = emission[0] + np.where(np.isnan(before), 0.0, onward(np.nan_to_num(before)))
    for k in range(1, len(emission)):
        fwd[k] = emission[k] + onward(fwd[k - 1])
    bwd[-1] = after
    for k in range(len(emission) - 2, -1, -1):
        x = np.exp(np.clip(bwd[k + 1] + emission[k + 1], -_LOG_ODDS, _LOG_ODDS))
        bwd[k] = np.where(own[k + 1], np.log((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)), after)
    return fwd, bwd


def marginals(values: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of a flat array of emission log-odds; NaN is a break and has 0."""
    breaks = np.isnan(values)
    fwd, bwd = Chains(breaks).odds(values, trans)
    return np.where(breaks, 0.0, _sigmoid(fwd + bwd))


def features(p: np.ndarray) -> np.ndarray:
    """Of a document: a constant, its largest marginal, the log of its toxic tokens."""
    return np.array([1.0, p.max(initial=0.0), np.log1p((p > 0.5).sum())])


class Field:
    """words: weights of the features; other: the bias of every token."""

    def __init__(self, words: dict[str, float], other: float, trans: np.ndarray, curve: np.ndarray):
        self.table, self.trans, self.curve = _Emissions(words, other), trans, curve

    def values(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.table.__getitem__, words), float, len(words))

    def score_all(self, texts: list[str]) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Scores, and toxic spans as (start, end, largest marginal) in code points of the text.

        Neighbouring toxic tokens of a sentence are one span.
        """
        values = [np.append(self.values(TOKEN.findall(t)), np.nan) for t in texts]
        p = marginals(np.concatenate(values), self.trans) if values else np.zeros(0)
        ends = np.cumsum([len(v) for v in values])
        scores, spans = [], []
        for text, end, v in zip(texts, ends, values, strict=True):
            own = p[end - len(v):end]
            scores.append(float(_sigmoid(features(own) @ self.curve)))
            spans.append(_merged(text, own) if (own > 0.5).any() else [])
        return scores, spans


def _merged(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    where = [m.span() for m in TOKEN.finditer(text)]
    out: list[tuple[int, int, float]] = []
    last = -2
    for k in np.flatnonzero(p > 0.5).tolist():
        begin, end = where[k]
        if k == last + 1:
            out[-1] = (out[-1][0], end, max(out[-1][2], float(p[k])))
        else:
            out.append((begin, end, float(p[k])))
        last = k
    return out


class _Words:
    """Texts as numbers of lower-cased words (-1 for a break, also after each text), and the words by number."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        written: dict[str, int] = dict.fromkeys(_BREAKS, -1)
        flat, self.edges = array("i"), [0]
        for text in texts:
            for m in TOKEN.finditer(text):
                if (k := written.get(m[0])) is None:
                    k = written[m[0]] = numbers.setdefault(m[0].lower(), len(numbers))
                flat.append(k)
            flat.append(-1)
            self.edges.append(len(flat))
        self.flat, self.words = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), list(numbers)

    def features_of_texts(self) -> Iterator[set[str]]:
        for i, j in zip(self.edges, self.edges[1:]):
            yield {f for k in np.unique(self.flat[i:j]).tolist() if k >= 0 for f in word_features(self.words[k])}


def toxic_features(words: _Words, toxic: list[int], weights: list[float]) -> tuple[set[str], set[str]]:
    """Features of at least three texts and 1 % of the toxic ones, nine in ten of their texts toxic; and features of five texts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    common: Counter = Counter()
    for own, label, weight in zip(words.features_of_texts(), toxic, weights, strict=True):
        common.update(own)
        for f in own:
            seen[label][f] += 1 if label else weight
    least = max(3, 0.01 * sum(toxic))
    return {f for f, n in seen[1].items() if n >= least and n >= 9 * seen[0][f]}, {f for f, n in common.items() if n >= 5}


def train(texts: list[str], toxic: list[int], weights: list[float], rounds: int = 40) -> Field:
    """The field and the curve from labelled texts; weights: clean rows that a sampled one stands for.

    All sentences of the texts take part.  Gradients are summed word by word first, then by feature.
    A text is four bytes for each of its words here, and some twenty times that while a round runs.
    """
    words = _Words(texts)
    bad, common = toxic_features(words, toxic, weights)
    known = sorted(common | bad)
    number = {f: i + 2 for i, f in enumerate(known)}  # 0: no feature, weight 0; 1: the bias
    found = [word_features(w) for w in words.words]
    codes = np.array([[1, *(number.get(f, 0) for f in own), *[0] * (len(STEMS) + 1 - len(own))] for own in found], np.int32).reshape(-1, len(STEMS) + 2)
    marked = np.array([any(f in bad for f in own) for own in found] + [False])  # -1 is the last
    flat = words.flat
    tag = marked[flat] & np.repeat(np.array(toxic, bool), np.diff(words.edges))
    breaks = flat < 0
    chains, inside = Chains(breaks), np.flatnonzero(~breaks)
    left = np.flatnonzero(~breaks[:-1] & ~breaks[1:])
    pairs = np.bincount(2 * tag[left] + tag[left + 1], minlength=4)
    weight, trans = np.zeros(len(known) + 2), np.zeros((2, 2))
    prior = np.zeros_like(weight)
    prior[1] = weight[1] = -3.0
    step_w, step_t = np.zeros_like(weight), np.zeros_like(trans)
    square_w, square_t = np.zeros_like(weight), np.zeros_like(trans)
    emission = np.zeros(len(flat))
    for turn in range(1, rounds + 1):
        emission[inside] = weight[codes].sum(axis=1)[flat[inside]]
        fwd, bwd = chains.odds(emission, trans)
        rest = _sigmoid(fwd[inside] + bwd[inside]) - tag[inside]
        by_word = np.bincount(flat[inside], rest, len(codes))
        grad_w = 0.01 * (weight - prior) + np.bincount(codes.ravel(), np.repeat(by_word, codes.shape[1]), len(weight))
        # Pair marginals from the forward odds on the left and what follows on the right.
        grad_t = 0.01 * trans - pairs.reshape(2, 2)
        for lo in range(0, len(left), _PAIRS):
            at = left[lo:lo + _PAIRS]
            a, b = fwd[at], emission[at + 1] + bwd[at + 1]
            score = np.stack([np.zeros_like(a) + trans[0, 0], b + trans[0, 1], a + trans[1, 0], a + b + trans[1, 1]])
            score = np.exp(score - score.max(axis=0))
            grad_t += (score / score.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad_w[0] = 0.0
        for value, grad, step, square in ((weight, grad_w, step_w, square_w), (trans, grad_t, step_t, square_t)):
            step *= 0.9
            step += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad * grad
            value -= 0.5 * (step / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)
    field = Field({f: float(weight[i]) for f, i in number.items() if weight[i]}, float(weight[1]), trans, np.array([-3.0, 6.0, 0.0]))
    emission[inside] = weight[codes].sum(axis=1)[flat[inside]]
    p = marginals(np.where(breaks, np.nan, emission), trans)
    rows = np.array([features(p[i:j]) for i, j in zip(words.edges, words.edges[1:])]).reshape(-1, 3)
    field.curve = _logistic(rows, np.array(toxic, float), np.where(np.array(toxic) == 1, 1.0, np.array(weights)))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -_LOG_ODDS, _LOG_ODDS)))
        grad = x.T @ (weight * (p - y)) + 0.1 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta - np.linalg.solve(hess, grad)
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> tuple[list[str], list[int], list[float]]:
    """About sample_rows labelled texts, up to half of each class, and what each stands for.

    Labels of the held-out fifth are never read.  Equal texts count once; a row's label is
    the largest that labels gives for its id.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_bucket("doc_id", 5) != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, sample_rows / 2 / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    # The sample's ids are bounded by sample_rows, so they may be broadcast.
    picked = known.where(draw < limit).select(F.col("doc_id").alias("__id"), "toxic")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id").where("text is not null")
    rows = rows.select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["text"])
    times = (share.get(1) or 1.0) / (share.get(0) or 1.0)
    return [r["text"] for r in rows], [r["toxic"] for r in rows], [times] * len(rows)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4_000) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end, marginal) of every whole text.

    Null counts as empty; an empty text has the score of one without a toxic token.  With no
    labels all scores are low.  Rows with repeated or null ids are scored one by one (a null
    id is not held out); other columns are ignored; an empty table gives no rows.  Offsets
    count code points of the text as it is.
    """
    texts, toxic, weights = labelled_sample(docs, labels, id_col, text_col, sample_rows)
    field = train(texts, toxic, weights) if 1 in toxic else Field({}, -5.0, np.zeros((2, 2)), np.array([-5.0, 0.0, 0.0]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in it:
            for at, n in runs_of_rows(pc.utf8_length(batch.column(2)).to_pylist(), _PART_CHARS):
                part = batch.slice(at, n)
                found, spans = own.score_all([t or "" for t in part.column(2).to_pylist()])
                marks = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32()), marks], ["doc_id", "held_out", "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col(id_col).isNotNull() & (crc_bucket(id_col, 5) == 0)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def op7_toxicity(spark, sf_dir):
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
