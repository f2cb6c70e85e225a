"""Stretches of k letters in batches of sequences: text, hashes and the places that windows agree on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters that are hashed at once; a longer sequence is taken part by part.
PART = 1 << 20
ROWS = 1 << 17
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k letters from each place on; the last k - 1 places have none."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # blocks of 1, 2, 4 ... letters: a stretch is put together from those that its length is the sum of
    block, step, at, out = letters.astype(np.uint64) + np.uint64(1), 1, 0, np.zeros(n, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    while step <= k:
        if k & step:
            out = out * np.uint64(pow(base, step, 1 << 64)) + block[at : at + n]
            at += step
        block, step = block[:-step] * np.uint64(pow(base, step, 1 << 64)) + block[step:], 2 * step
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.minimum(out, NONE - np.uint64(1))


def least_of_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Places, rising, that have the least hash (the first of equal ones) of some `width` places in a row."""
    if width == 1 or len(codes) < width:
        return np.arange(len(codes) if width == 1 else 0)
    n = len(codes) - width + 1
    best, least = np.arange(n), codes[:n].copy()
    for d in range(1, width):
        better = codes[d : d + n] < least
        best[better] += d - (best[better] - np.flatnonzero(better))
        least[better] = codes[d : d + n][better]
    return np.unique(best)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters one after another, and where each begins (and the last ends)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return code_points("".join(texts)), np.append(0, np.cumsum(sizes))


def places(texts: list[str], k: int, width: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place from 0, hash) of the stretches of k letters inside a text which are the least of some window of
    `width`, and among `wanted` (rising hashes) if given."""
    letters, begin = joined(texts)
    codes = hashes(letters, k)
    row = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(codes)]
    codes = np.where(np.arange(len(codes)) + k <= begin[row + 1], codes, NONE)
    if wanted is None:
        at = least_of_windows(codes, width)
    else:
        found = np.searchsorted(wanted, codes)
        at = np.flatnonzero(wanted[np.minimum(found, len(wanted) - 1)] == codes) if len(wanted) else np.zeros(0, dtype=np.int64)
    at = at[codes[at] != NONE]
    return row[at], at - begin[row[at]], codes[at]


def groups(texts: list[str | None], reach: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(number of the text, where the part begins, part) of texts in groups of about PART letters; a longer text comes
    in parts that share `reach` letters."""
    number, first, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t or "") - reach, 1), PART):
            part = (t or "")[a : a + PART + reach]
            number.append(i), first.append(a), parts.append(part)  # in place: short texts are many
            size += len(part)
            if size >= PART:
                yield number, first, parts
                number, first, parts, size = [], [], [], 0
    if parts:
        yield number, first, parts


def of_batch(batch: pa.RecordBatch, seq: str, k: int, width: int, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`places` of a batch's column, each place of a sequence once."""
    reach = k + width - 2
    last = (-1, -1)
    for number, first, parts in groups(batch.column(seq).to_pylist(), reach):
        row, at, code = places(parts, k, width, wanted)
        place = at + np.array(first)[row]
        row = np.array(number)[row]
        # what two parts of one text share is found in both
        order = np.lexsort((place, row))
        row, place, code = row[order], place[order], code[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        new &= (row != last[0]) | (place > last[1])
        row, place, code = row[new], place[new], code[new]
        if len(row):
            last = (int(row[-1]), int(place[-1]))
            for a in range(0, len(row), ROWS):
                yield row[a : a + ROWS], place[a : a + ROWS], code[a : a + ROWS]


def stretches(letters: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The k letters from each of these places on, as strings."""
    cut = letters[at[:, None] + np.arange(k)]
    if not len(at) or cut.max() < 128:
        data, offsets = cut.astype(np.uint8).tobytes(), np.arange(len(at) + 1, dtype=np.int32) * k
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    return pa.array([x.tobytes().decode("utf-32-le") for x in np.ascontiguousarray(cut.astype("<u4"))], pa.string())


def grams_of(batch: pa.RecordBatch, seq: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(row, place from 0, k letters) of every stretch of k letters of a batch's column."""
    for number, first, parts in groups(batch.column(seq).to_pylist(), k - 1):
        letters, begin = joined(parts)
        row = np.repeat(np.arange(len(parts)), np.maximum(np.diff(begin) - k + 1, 0))
        start = np.cumsum(np.append(0, np.maximum(np.diff(begin) - k + 1, 0)))[:-1]
        within = np.arange(len(row)) - start[row]
        for a in range(0, len(row), ROWS):
            r, w = row[a : a + ROWS], within[a : a + ROWS]
            yield np.array(number)[r], w + np.array(first)[r], stretches(letters, begin[r] + w, k)
