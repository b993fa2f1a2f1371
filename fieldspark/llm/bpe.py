"""Byte-level BPE through a tokenization automaton over a public vocabulary.

The automaton reads token sequences and accepts those that BPE itself would produce.  It
starts as one state that takes every byte.  Each merge (u, v) -> uv, in order of rank,
adds one gadget: the state that u leads to is copied without its arc for v, u leads to the
copy from then on, and every state with an arc for u gets an arc for uv to where v led.
A state keeps only what its gadget changed (its parent, the arc taken away, its rank), so
50,000 merges compile in a moment; arcs are looked up once and then kept in a table.

A pre-split word has exactly one accepted token sequence.  Encoding walks the table with
the longest token first, found through a trie, and steps back where no arc leads on;
decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
#: Unicode white space, and the pre-tokenizer's pattern with it spelt out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of a worker's tables before they are cleared; a ready-made encoder needs fewer parts kept.
CHUNKS, READY_CHUNKS, WORDS, ARCS = 400_000, 150_000, 100_000, 500_000
#: Longest part, in characters, that a table keeps; longer ones are encoded each time.
LONGEST = 64
#: Characters of texts that are split together.
SLICE = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """labels: bytes of each token id; merges: (left id, right id, merged id) by rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.token = {b: i for i, b in labels.items()}
        self.made, self.left = dict.fromkeys(labels, -1), {}
        self.rank: dict[tuple[int, int], int] = {}
        # State 0 takes all bytes.  owner: the token whose gadget made a state.
        self.born, self.owner = [-1], [-1]
        self.leads = dict.fromkeys(labels, 0)
        self.base: dict[int, int] = {}
        self.births: dict[int, list[int]] = {}
        self.copies: dict[int, list[int]] = {}
        for rank, merge in enumerate(merges):
            self._gadget(rank, *merge)
        # A trie finds how far a word follows a token (a character stands for a byte); `longest`
        # has the longest token that begins each such beginning, `shorter` the next shorter one.
        self.trie, self.longest = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), {"": -1}
        self.sizes, self.shorter = ([0] * (max(labels, default=-1) + 1) for _ in range(2))
        for label, token in sorted(self.token.items()):
            letters = label.decode("latin-1")
            self.trie.add_word(letters)
            self.sizes[token] = len(letters)
            for k in range(1, len(letters)):
                self.longest.setdefault(letters[:k], self.longest[letters[: k - 1]])
            self.shorter[token] = self.longest[letters[:-1]]
            self.longest[letters] = token
        self.most = max(self.sizes, default=0)
        self.arcs: dict[int, int] = {}

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if self.made[uv] >= 0:
            raise ValueError(f"two merges make token {uv}")
        onward = self.leads[v]
        self.base.setdefault(u, self.leads[u])
        self.births.setdefault(u, []).append(rank)
        self.copies.setdefault(u, []).append(len(self.born))
        self.leads[u] = len(self.born)
        self.born.append(rank)
        self.owner.append(u)
        self.leads[uv] = onward
        self.made[uv], self.left[uv], self.rank[u, v] = rank, u, rank

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a state takes a token, through the gadgets that made them."""
        while True:
            made = self.made[token]
            if made >= self.born[state]:
                if made < 0:
                    return True
                token = self.left[token]  # the arc was added where one for the left part was
                continue
            owner = self.owner[state]
            if self.rank.get((owner, token), len(self.rank)) <= self.born[state]:
                return False
            older = bisect_right(self.births[owner], made)
            state = self.copies[owner][older - 1] if older else self.base[owner]

    def _arc(self, state: int, token: int) -> int:
        """Looks an arc up through the gadgets and keeps it: the next state, or -1."""
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        to = self.arcs[state << 20 | token] = self.leads[token] if self.has_arc(state, token) else -1
        return to

    def encode(self, word: bytes) -> list[int]:
        """Token ids of a pre-split word, which has one byte at least."""
        if (whole := self.token.get(word)) is not None and self.has_arc(0, whole):
            return [whole]
        arcs, sizes, shorter, depth, longest = self.arcs, self.sizes, self.shorter, self.trie.longest_prefix, self.longest
        letters, end, at, state, most = word.decode("latin-1"), len(word), 0, 0, self.most
        ids, states, dead = [], [], set()
        token = longest[letters[: depth(letters[:most])]]
        while True:
            while token >= 0:
                to_at = at + sizes[token]
                if to_at not in dead:
                    if (to := arcs.get(state << 20 | token)) is None:
                        to = self._arc(state, token)
                    if to >= 0:
                        break
                token = shorter[token]
            else:
                dead.add(at)
                state, token = states.pop(), ids.pop()
                at -= sizes[token]
                token = shorter[token]
                continue
            ids.append(token)
            if to_at == end:
                return ids
            states.append(state)
            state, at = to, to_at
            rest = letters[at: at + most]
            token = longest[rest[: depth(rest)]]

    def label(self, token: int) -> bytes:
        return self.labels[token]

    @property
    def labels(self) -> dict[int, bytes]:
        if not hasattr(self, "_labels"):
            self._labels = {i: b for b, i in self.token.items()}
        return self._labels


class _Table(dict):
    """A bounded table filled by a function where a key is missing.

    Once full it becomes the older generation, whose entries come back as they are met.
    """

    def __init__(self, fill, most: int):
        super().__init__()
        self.fill, self.most, self.older = fill, most, {}

    def __missing__(self, key):
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Codec:
    """Encodes and decodes whole texts with a byte-level BPE vocabulary file.

    With ready=True, pre-split parts go to a ready-made encoder of the same ranks and no
    automaton is built.  Tables hold short parts only, so their size is bounded; forget()
    empties them.
    """

    def __init__(self, path: str, ready: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        labels = {i: to_bytes(t) for t, i in vocab.items()}
        self.automaton = None if ready else Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.labels = [b""] * (max([*labels, *self.special.values()]) + 1)
        for i, b in [*labels.items(), *((i, t.encode()) for t, i in self.special.items())]:
            self.labels[i] = b
        self.numbers = [str(i) for i in range(len(self.labels))]
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(SPLIT)
        self._rare = regex.compile(r"[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self._apart = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self._words = _Table(self._word, WORDS)
        self._chunks = _Table(self._chunk, READY_CHUNKS if ready else CHUNKS)
        if ready:
            import tiktoken

            ranks = {b: i for i, b in labels.items()}
            own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self._chunks.fill = lambda chunk: array("I", own.encode_ordinary(chunk)).tobytes()

    def forget(self) -> None:
        """Empties the tables, so that a worker between tasks holds the vocabulary alone."""
        self._words.forget()
        self._chunks.forget()
        if self.automaton:
            self.automaton.arcs.clear()
        pa.default_memory_pool().release_unused()

    def _chunk(self, chunk: str) -> bytes:
        parts = self._split.findall(chunk)
        return self._word(chunk) if len(parts) == 1 else b"".join([self._words[p] for p in parts])

    def _word(self, word: str) -> bytes:
        return array("I", self.automaton.encode(word.encode())).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether each white space beside a space, and each special token, is certainly absent."""
        return not (
            "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text
            or any(s in text for s in self.special) or (not text.isascii() or "\x0b" in text or "\x0c" in text) and self._rare.search(text)
        )

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit numbers in the machine's (little-endian) order.

        The pre-tokenizer always cuts before a single space between other characters, so
        a text is taken apart there first and the parts are looked up in a table.
        """
        if self._special and any(s in text for s in self.special):
            parts = self._special.split(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self.packed(p) for k, p in enumerate(parts))
        parts = text.split(" ") if self._plain(text) else self._apart.split(text)
        chunks = self._chunks
        return chunks[parts[0]] + b"".join([chunks[" " + p] for p in parts[1:]])

    def packed_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """packed() of many texts as arrays, in turn; null counts as empty.

        Plain texts are split together and each different part is looked up once, in
        pieces of about SLICE characters.
        """
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > SLICE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        plain = [t if self._plain(t) else "" for t in texts]
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        own = [self._chunks[" " + w] for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy(zero_copy_only=False)
        each = sizes[at]
        ends = np.cumsum(each)
        flat = ids[np.repeat(first[at] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        edges = split.offsets.to_numpy()
        out = []
        for k, (text, as_plain) in enumerate(zip(texts, plain, strict=True)):
            if as_plain:
                head = np.frombuffer(self._chunks[text.partition(" ")[0]], "<u4")
                out.append(np.concatenate([head, flat[ends[edges[k] + 1]:ends[edges[k + 1]]]]))
            else:
                out.append(np.frombuffer(self.packed(text), "<u4"))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str | None = None, ready: bool = False) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Codec(path, ready)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Whole texts; null counts as empty and has no tokens.  Strings of special tokens in a
    text become their ids.  Rows stand alone: repeated or null ids, other columns and
    empty tables need no care.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in it:
            n, ids_sha, text_sha = [], [], []
            for packed in own.packed_all(batch.column(1)):
                ids = packed.tolist()
                n.append(len(ids))
                ids_sha.append(digest(",".join(map(own.numbers.__getitem__, ids))))
                text_sha.append(digest(own.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """docs with an array of token ids added."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        own = codec(path)
        return texts.map(lambda t: ids_of(own.packed(t or "")))

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """rows with the text of an array of token ids added; a null array decodes to an empty text."""

    @F.pandas_udf("string")
    def texts(ids):
        own = codec(path)
        return ids.map(lambda x: own.decode(list(x) if x is not None else []))

    return rows.withColumn(out, texts(F.col(ids_col)))


def op8_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir))
