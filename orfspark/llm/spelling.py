"""Operator 11, spelling variants: blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by
a squared distance of 1 or 2. The letters fall into five groups, of which an edit
touches at most two, so near words agree in the counts of all letters of some three
groups: words are dealt into blocks under each three of them (a hash of those
counts). Inside a block words of one length, and of that and the next, are compared
by a NumPy product, |a|^2 + |b|^2 - 2ab for all of them at once. Pairs at the
distance of an edit are verified on the letters, and count in the first block whose
groups the edit leaves alone. A block beyond `HOT` words is dealt out as pairs of its
parts, so no set of letters, however common, is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, read_table, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
GROUPS = 5
COMBOS = [list(c) for c in combinations(range(GROUPS), 3)]
#: By the groups of two letters (x, y), the first of COMBOS without them.
FIRST = np.array([[next(k for k, c in enumerate(COMBOS) if x not in c and y not in c) for y in range(GROUPS)] for x in range(GROUPS)])
#: Words compared in one product, words of a task's blocks, and words from which a block is dealt out.
TILE, BUCKET, HOT = 1024, 40_000, 8192


def corpus_words(docs: DataFrame, one_in: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the distinct runs of letters of all texts, A-Z lower-cased, each with its uses.

    A run loses a letter where crc32 of `<doc_id>:<run>` is divisible by one_in
    (the letter at crc32 modulo its length). Counted before the shuffle. Null texts
    have no words; a null doc_id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    rows = rows.where(F.length("w") >= shortest).select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    words = rows.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("w")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def flat_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words in a row, the word of each, lengths)."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), np.repeat(np.arange(len(words)), lengths), lengths


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> a row per three groups: (word, n, combo, key), the key being equal for equal counts of their letters."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        codes, owner, _ = flat_letters(words)
        sums = np.zeros((len(words), GROUPS), dtype=np.uint64)
        np.add.at(sums, (owner, codes % GROUPS), mixed(codes + np.uint32(1)))
        for combo, groups in enumerate(COMBOS):
            key = mixed(sums[:, groups].sum(axis=1, dtype=np.uint64) + np.uint64(combo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(np.full(len(words), combo, dtype=np.int32)), pa.array(key.view(np.int64))], ["word", "n", "combo", "key"]
            )


def one_edit(a: str, b: str) -> int | None:
    """The place of the letter that b has instead of a's or more than a; None if b is not a with exactly one edit."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    fits = k < len(b) and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])
    return k if fits else None


def verified(a: np.ndarray, b: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of letters, b as long as a or one letter longer: whether they are one edit apart, and its place."""
    n = a.shape[1] - long
    unlike = a[:, :n] != b[:, :n]
    if not long:
        return unlike.sum(axis=1) == 1, unlike.argmax(axis=1)
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), n)
    moved = a[:, :n] != b[:, 1 : n + 1]
    last = np.where(moved.any(axis=1), n - moved[:, ::-1].argmax(axis=1), 0)
    return last <= first, first


class Bucket:
    """Words of some blocks, in order of block and length, with their letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, key: np.ndarray, combo: np.ndarray, side: np.ndarray | None) -> None:
        lengths = np.array([len(w) for w in words])
        order = np.lexsort((lengths, key))
        self.words, self.lengths, self.key = [words[i] for i in order], lengths[order], key[order]
        self.n, self.combo = n[order], combo[order]
        self.side = None if side is None else side[order]
        codes, owner, _ = flat_letters(self.words)
        letters, column = np.unique(codes, return_inverse=True)
        kind = np.float32 if self.lengths.max() < 2000 else np.float64  # holds the squares exactly
        width = len(letters)
        counts = np.bincount(owner * width + column, minlength=len(words) * width).reshape(-1, width).astype(kind)
        squares, ones = (counts * counts).sum(axis=1, keepdims=True), np.ones((len(words), 1), dtype=kind)
        # their product is the squared distance
        self.left, self.right = np.hstack([-2 * counts, squares, ones]), np.hstack([counts, ones, squares])

    def letters(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer("".join(self.words[i].ljust(width) for i in at).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), width)

    def compared(self, a: slice, b: slice, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of near words of two stretches, those of b being as long as those of a or one letter longer."""
        # a replaced letter is a distance of 2, a letter more one of 1
        i, j = np.nonzero(self.left[a] @ self.right[b].T == (1 if long else 2))
        i, j = i + a.start, j + b.start
        keep = np.ones(len(i), dtype=bool) if long else i < j
        if self.side is not None:
            keep &= self.side[i] != self.side[j]
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
        width = int(self.lengths[b.start])
        if width > 64:
            places = [one_edit(self.words[x], self.words[y]) for x, y in zip(i, j, strict=True)]
            fits, place = np.array([p is not None for p in places]), np.array([p or 0 for p in places])
            new = np.array([ord(self.words[y][p]) for y, p in zip(j, place, strict=True)])
            old = new if long else np.array([ord(self.words[x][p]) for x, p in zip(i, place, strict=True)])
        else:
            block_a, block_b = self.letters(np.arange(a.start, a.stop), width), self.letters(np.arange(b.start, b.stop), width)
            one, two = block_a[i - a.start], block_b[j - b.start]
            fits, place = verified(one, two, long)
            new = two[np.arange(len(two)), place]
            old = new if long else one[np.arange(len(one)), place]
        fits = fits & (FIRST[old % GROUPS, new % GROUPS] == self.combo[a.start])
        return i[fits], j[fits]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stretches of one block and length, each with itself and with the next length, `TILE` by `TILE` words."""
        edge = np.flatnonzero((self.key[1:] != self.key[:-1]) | (self.lengths[1:] != self.lengths[:-1])) + 1
        starts, stops = [0, *edge.tolist()], [*edge.tolist(), len(self.words)]
        for r, (start, stop) in enumerate(zip(starts, stops, strict=True)):
            follows = stop < len(self.words) and self.key[stop] == self.key[start] and self.lengths[stop] == self.lengths[start] + 1
            for x in range(start, stop, TILE):
                a = slice(x, min(x + TILE, stop))
                if stop - start > 1:
                    for y in range(x, stop, TILE):
                        yield self.compared(a, slice(y, min(y + TILE, stop)), 0)
                if follows:
                    for y in range(stop, stops[r + 1], TILE):
                        yield self.compared(a, slice(y, min(y + TILE, stops[r + 1])), 1)


def near_in_bucket(rows: pa.Table) -> pa.Table:
    of = {c: rows.column(c).to_numpy() for c in ("n", "key", "combo", "i", "j", "side")}
    across = of["side"] if of["i"][0] != of["j"][0] else None  # two parts of a hot block: only pairs between them
    bucket = Bucket(rows.column("word").to_pylist(), of["n"], of["key"], of["combo"], across)
    found = list(bucket.pairs())
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, dtype=np.int64)
    take = lambda at: pa.array([bucket.words[k] for k in at], pa.string())
    return pa.table({"word": take(a), "n": bucket.n[a], "near": take(b), "near_n": bucket.n[b]})


def near_words(words: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): each pair of distinct words one edit apart, once. words: (word, n), without repeats."""
    rows = words.select("word", "n").mapInArrow(keyed, "word string, n long, combo int, key long")
    rows = stored(rows)
    buckets = max(rows.count() // bucket, 1)
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("key", F.ceil(2 * F.col("size") / hot).cast("int").alias("parts"))
    seated = rows.join(broadcast_within(stored(large), 200_000), "key", "left")
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    seat = lambda g, i, j, side: F.struct(g.alias("g"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    plain = F.array(seat(F.pmod("key", F.lit(buckets)), F.lit(-1), F.lit(-1), 0))
    later = F.transform(F.sequence(mine, F.col("parts") - 1), lambda j: seat(F.col("key"), mine, j, 0))
    sooner = F.filter(F.transform(F.sequence(F.lit(0), mine), lambda i: seat(F.col("key"), i, mine, 1)), lambda s: s["i"] < s["j"])
    seats = F.explode(F.when(F.col("parts").isNull(), plain).otherwise(F.concat(later, sooner))).alias("s")
    dealt = seated.select("word", "n", "combo", "key", seats).select("word", "n", "combo", "key", "s.*")
    return dealt.groupBy("g", "i", "j").applyInArrow(near_in_bucket, "word string, n long, near string, near_n long")


def spelling_forms(words: DataFrame, ratio: int = 2, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n).

    form: the near word of largest n (ties: the least in code-point order), if
    that n >= ratio * n, else null; root: what following forms ends at, the word
    itself without one. Rows without word are left out, repeated words count
    once with their largest n; other columns are ignored; no words give no rows.
    """
    words = stored(words.where("word is not null").groupBy("word").agg(F.max(F.coalesce("n", F.lit(0))).alias("n")))
    pairs = stored(near_words(words, bucket, hot))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    rows = words.join(best, "word", "left").withColumn("m", -F.col("b.m"))
    takes = F.col("m") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("b.near")).alias("form"), F.when(takes, F.col("m")).alias("form_n")))
    # n at least doubles with each form: few steps, and each round doubles their length
    ways = stored(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        ways = longer.select("word", "root")
        if not moved:
            break
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(corpus_words(read_table(spark, sf_dir, "documents")))
