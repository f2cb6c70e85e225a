"""Md5 of many short texts that begin alike, in arrays."""

from __future__ import annotations

import hashlib

import numpy as np

#: Messages that are digested at once, and letters whose messages are laid out at once.
ROWS = 1 << 14
LETTERS = 1 << 18
TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def md5_blocks(blocks: np.ndarray) -> np.ndarray:
    """(rows, 4) words of the digests of messages of one padded block each: (16, rows) words."""
    a, b, c, d = (np.full(blocks.shape[1], x, dtype=np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += blocks[g]
        f += SINES[i]
        turn = TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return np.stack([a, b, c, d], axis=1) + START


def written(out: np.ndarray, begin: bytes) -> None:
    """Fill rows of 64 bytes with `begin` and their number in decimal, padded as md5 wants it."""
    out[:, : len(begin)] = np.frombuffer(begin, dtype=np.uint8)
    low, high = 0, 10
    while low < len(out):  # numbers of one length
        part, digits = out[low:high], len(str(low))
        numbers, size = np.arange(low, low + len(part)), len(begin) + digits
        for k in range(digits):
            part[:, size - 1 - k] = 48 + numbers // 10**k % 10
        part[:, size] = 128
        part[:, 56:58] = [8 * size % 256, 8 * size // 256]
        low, high = high, high * 10


def digests_of(begins: list[bytes], sizes: list[int]) -> np.ndarray:
    """(rows, 2) numbers that stand in the order of the digests of each `begin` followed by 0, 1, 2 ... in decimal, as many
    as its size; all of one block."""
    text, at = np.zeros((sum(sizes), 64), dtype=np.uint8), 0
    for begin, n in zip(begins, sizes, strict=True):
        written(text[at : at + n], begin)
        at += n
    parts = [md5_blocks(np.ascontiguousarray(text[i : i + ROWS].view("<u4").T)) for i in range(0, len(text), ROWS)]
    return np.concatenate([np.zeros((0, 4), dtype=np.uint32), *parts]).astype("<u4").view(">u8").astype(np.uint64)


def long_digests(begin: bytes, n: int) -> np.ndarray:
    """`digests_of` for one `begin` of any length."""
    found = b"".join(hashlib.md5(begin + str(i).encode()).digest() for i in range(n))
    return np.frombuffer(found, dtype=">u8").reshape(-1, 2).astype(np.uint64)


def sorted_by(text: str, keys: np.ndarray) -> str:
    letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return letters[np.lexsort((keys[:, 1], keys[:, 0]))].tobytes().decode("utf-32-le")


def ordered(texts: list[str | None], begins: list[str]) -> list[str | None]:
    """The letters of each text in the order of md5(its begin followed by their place from 0). Texts are digested together
    in groups of about LETTERS letters; a longer text is a group of its own."""
    out: list[str | None] = [None] * len(texts)
    group: list[int] = []

    def flush() -> None:
        keys = digests_of([begins[i].encode() for i in group], [len(texts[i]) for i in group])
        at = 0
        for i in group:
            out[i] = sorted_by(texts[i], keys[at : at + len(texts[i])])
            at += len(texts[i])
        group.clear()

    for i, (text, begin) in enumerate(zip(texts, begins, strict=True)):
        if text is None:
            continue
        if len(begin.encode()) + len(str(len(text))) > 55:  # more than a block
            out[i] = sorted_by(text, long_digests(begin.encode(), len(text)))
            continue
        if group and sum(len(texts[j]) for j in group) + len(text) > LETTERS:
            flush()
        group.append(i)
    flush()
    return out
