"""Words of whole batches of texts as numbers, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from fieldspark.llm.common import runs_of_rows

#: Characters of one run of texts.
RUN_CHARS = 1 << 22
#: Bytes of the part of a run that is split into words at a time, since words in order take many times as many.
PART_CHARS = 1 << 20


def lowered(separators: bytes | None = None) -> bytes:
    """A byte table that lower-cases A-Z and turns the separators (default: none but white space) into spaces."""
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    for b in separators or b"":
        table[b] = 32
    return bytes(table)


def split(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the word) for each word in order, and the distinct words; null texts have none.

    Words are what white space [\\x20\\x09-\\x0D] separates once the bytes went through the table.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    mapped = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(table) if data is not None else b""
    moved = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(mapped))
    lists = pc.ascii_split_whitespace(moved)
    words = lists.values
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(words, "")
    rows = rows[full.to_numpy(zero_copy_only=False)]
    coded = words.filter(full).dictionary_encode()
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order of appearance, how often each occurs, and the number of each key; by hashing, not sorting."""
    number, found = pd.factorize(keys)
    return found, np.bincount(number, minlength=len(found)), number


def counted(texts: pa.Array, table: bytes, most: int = PART_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the word, how often) for each distinct word of each text, and the distinct words.

    Texts are split in parts of `most` bytes (or one text), so that only counts of a whole run are held.
    """
    rows, times, coded = [], [], []
    for at, count in runs_of_rows(pc.binary_length(texts).to_pylist(), most):
        row, number, found = split(texts.slice(at, count), table)
        if len(row):
            held, often, _ = distinct(row * len(found) + number)
            rows.append(held // len(found) + at)
            times.append(often)
            coded.append(pa.DictionaryArray.from_arrays(pa.array((held % len(found)).astype(np.int32)), found))
    if not coded:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    parts = pa.chunked_array(coded).unify_dictionaries().chunks
    number = np.concatenate([x.indices.to_numpy() for x in parts]).astype(np.int64)
    return np.concatenate(rows), number, np.concatenate(times), parts[0].dictionary


def runs(batch: pa.RecordBatch, text: str, most: int = RUN_CHARS):
    """Slices of a batch of at most `most` bytes of text each, or one row."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    for at, count in runs_of_rows(sizes, most):
        yield batch.slice(at, count)
