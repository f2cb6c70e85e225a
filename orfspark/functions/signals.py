"""Junction signals (stretches of 13 bases) of many sequences: scores and counts in arrays."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from . import expr as X, grams

LENGTH = len(X.SPLICE)
#: Log frequency of A, C, G, T and any other letter in each place, as `expr.splice_score` has them.
LOGS = np.array([[*map(math.log, row), math.log(0.25)] for row in X.SPLICE])


def base_numbers(letters: np.ndarray) -> np.ndarray:
    """0 to 3 for A, C, G, T; 4 for any other letter."""
    table = np.full(256, 4, dtype=np.int64)
    for i, b in enumerate("ACGT"):
        table[ord(b)] = i
    return table[np.minimum(letters, 255)]


def scores(bases: np.ndarray, n: int) -> np.ndarray:
    """Scores of the stretches from the first n places on, added up from left to right."""
    total = np.zeros(n)
    for i in range(LENGTH):
        total = total + LOGS[i][bases[i : i + n]]
    return total


def best_of(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of a text's stretches, the scores that are the best to some 5 decimals, and the first place of each."""
    bases = base_numbers(grams.code_points(text))
    n = max(len(bases) - LENGTH + 1, 0)
    if not n:
        return 0, np.zeros(0), np.zeros(0, dtype=np.int64)
    found = scores(bases, n)
    near = np.flatnonzero(found >= found.max() - 2e-5)
    score, first = np.unique(found[near], return_index=True)
    return n, score, near[first]


def accepted(numbers: np.ndarray, texts: list[str], least: int, score: float) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(number, signal, n, score) of the signals that texts of one number hold `least` times or that score more."""
    letters, begin = grams.joined(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(begin))[: max(len(letters) - LENGTH + 1, 0)]
    n = len(text)
    bases, whole = base_numbers(letters), np.arange(n) + LENGTH <= begin[text + 1]
    code, known = np.zeros(n, dtype=np.int64), whole.copy()
    for i in range(LENGTH):
        b = bases[i : i + n]
        code, known = 4 * code + np.minimum(b, 3), known & (b < 4)
    key, count = np.unique((numbers[text[known]] << 2 * LENGTH) + code[known], return_counts=True)
    digits = (key[:, None] >> 2 * np.arange(LENGTH - 1, -1, -1)) & 3
    value = np.zeros(len(key))
    for i in range(LENGTH):
        value = value + LOGS[i][digits[:, i]]
    keep = (count >= least) | (value > score)
    signal = grams.stretches(np.frombuffer(b"ACGT", dtype=np.uint8).astype("<u4")[digits[keep]].ravel(), np.arange(int(keep.sum())) * LENGTH, LENGTH)
    out = key[keep] >> 2 * LENGTH, signal, count[keep], value[keep]
    # stretches with other letters, which have no code
    other = Counter((int(numbers[text[p]]), letters[p : p + LENGTH].astype("<u4").tobytes().decode("utf-32-le")) for p in np.flatnonzero(whole & ~known).tolist())
    if not other:
        return out
    more = [(i, s, c, float(scores(base_numbers(grams.code_points(s)), 1)[0])) for (i, s), c in other.items()]
    number, signal, count, value = zip(*[m for m in more if m[2] >= least or m[3] > score], strict=True) if any(m[2] >= least or m[3] > score for m in more) else ((),) * 4
    return np.append(out[0], np.array(number, dtype=np.int64)), pa.concat_arrays([out[1], pa.array(signal, pa.string())]), np.append(out[2], np.array(count, dtype=np.int64)), np.append(out[3], np.array(value, dtype=float))
