"""The perfect binary Golay code of length 23, as decoding tables."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 2,048 syndromes: the error of weight <= 3, its weight, and five errors of weight 4.

    Only syndromes of weight 3 have the latter: each of the five codewords of weight 7
    that contain the error leaves four bits, an error that leads to another codeword.
    """
    leader, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for w in (1, 2, 3):
        errors = np.array([sum(1 << i for i in x) for x in combinations(range(23), w)], np.int64)
        at = _remainder(errors)
        leader[at], weight[at] = errors, w
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages ^ _remainder(messages)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    others: list[list[int]] = [[] for _ in range(2048)]
    for c in sevens.tolist():
        bits = [i for i in range(23) if c >> i & 1]
        for three in combinations(bits, 3):
            error = sum(1 << i for i in three)
            others[int(_remainder(np.array([error]))[0])].append(c ^ error)
    five = np.array([x if x else [0] * 5 for x in others], np.int64)
    return leader, weight, five


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the nearest codeword, and of all within distance 4: n x 6, -1 where fewer.

    Two words that differ in one bit: the nearest codeword of either is within 4 of the other.
    """
    leader, weight, five = tables()
    syndrome = _remainder(words)
    nearest = (words ^ leader[syndrome]) >> 11
    rest = (words[:, None] ^ five[syndrome]) >> 11
    rest[weight[syndrome] < 3] = -1
    return nearest, np.concatenate([nearest[:, None], rest], axis=1)
