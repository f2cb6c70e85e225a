"""Operator 4, SimHash near-dedup with deletion-variant signatures.

64-bit fingerprints that differ in at most four bits agree, in at least one of
three segments, up to one bit. Each distinct fingerprint is therefore indexed
under its one-wildcard segment variants (one per bit: 64 keys of 20 or 21 bits),
equal keys meet through a shuffle, and every meeting is verified on all bits.

Copies share one fingerprint and are grouped (with a partial aggregation)
before anything is joined. Inside a bucket of equal keys only a spanning forest
of the verified links is kept, never all pairs; a bucket beyond ``bucket_limit``
(at 2**16, some 6e10 distinct fingerprints spread over 2**20 keys) is resolved
exactly, in linear work, by meeting in the middle: two fingerprints differ by at
most four bits if and only if some word lies within two bits of both.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, free_prefix, read_table, short_batches, stored

SEED = 42
MAX_BITS = 4
#: First bit of each segment, and the end.
SEGMENTS = (0, 21, 42, 64)
MASKS = [sum(1 << b for b in range(a, z)) for a, z in itertools.pairwise(SEGMENTS)]
#: Shingles whose bits are counted together.
CHUNK = 100_000
SMALL = 8
#: Fingerprints of a bucket that are compared in one task, and rows of buckets handled together.
BUCKET_LIMIT = 1 << 16
ROWS = 20_000


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of the word shingles of a text: words of non-blanks, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(line[a:z], SEED) for a, z in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; counts are all above zero."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = 2 * ones > np.array(counts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[str | None], size: int = 4) -> np.ndarray:
    """uint64 fingerprints; a text without words (or null) has zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    places: list[int] = []

    def flush() -> None:
        if counts:
            out[places] = majority(hashes, counts)
        hashes.clear(), counts.clear(), places.clear()

    for i, text in enumerate(texts):
        own = shingle_hashes(text, size) if text else []
        if own:
            hashes.extend(own)
            counts.append(len(own))
            places.append(i)
        if len(hashes) >= CHUNK:
            flush()
    flush()
    return out


def fingerprint(size: int = 4):
    """Column function: text -> fingerprint (long, the 64 bits as they are)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of([x if isinstance(x, str) else None for x in texts], size).view(np.int64))

    return fp


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges = []
    left = np.arange(len(values))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = popcount(values[left] ^ values[at]) <= MAX_BITS
            if near.any():
                found = left[near]
                edges += [(at, x) for x in found]
                queue.extend(found)
                left = left[~near]
    return edges


def owned(x: np.ndarray, wild: np.ndarray) -> np.ndarray:
    """Whether wild is the first key that two fingerprints with difference x share."""
    first = np.full(len(x), -1, dtype=np.int64)
    for mask, low in zip(MASKS, SEGMENTS, strict=False):
        part = x & np.uint64(mask)
        one = popcount(part) == 1
        bit = np.where(one, popcount(part - np.uint64(1)), low).astype(np.int64)
        first = np.where((first < 0) & (popcount(part) <= 1), bit, first)
    return first == wild


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in larger ones of ROWS rows or more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bucket_links(limit: int):
    """Sorted (wild, bits, fp) rows -> (src, dst, hot): verified links, or members of a bucket beyond limit."""

    def links(wild: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
        src, dst = [], []
        cut = np.flatnonzero((wild[1:] != wild[:-1]) | (bits[1:] != bits[:-1])) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if not len(i):
                break
            x = fp[i] ^ fp[i + d]
            keep = (popcount(x) <= MAX_BITS) & (x != 0) & owned(x, wild[i])
            src.append(fp[i[keep]])
            dst.append(fp[i[keep] + d])
        for g in np.flatnonzero(sizes > SMALL):
            own = fp[starts[g] : starts[g] + sizes[g]]
            edges = np.array(forest(own), dtype=np.int64).reshape(-1, 2)
            src.append(own[edges[:, 0]])
            dst.append(own[edges[:, 1]])
        return src, dst

    def batch(src: np.ndarray, dst: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"src": pa.array(src.view(np.int64)), "dst": pa.array(dst.view(np.int64)), "hot": pa.array(np.full(len(src), hot))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        spilling = None
        for b in itertools.chain(gathered(batches), [None]):
            if b is not None:
                new = [b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
                kept = [np.concatenate([x, y]) for x, y in zip(kept, new, strict=True)]
            wild, bits, fp = kept
            if not len(fp):
                continue
            last = (wild[-1], bits[-1])
            if spilling is not None:  # the rest of a bucket beyond the limit
                more = (wild == spilling[0]) & (bits == spilling[1])
                if more.any():
                    yield batch(fp[more], fp[more], True)
                wild, bits, fp = wild[~more], bits[~more], fp[~more]
                kept = [wild, bits, fp]
                if not len(fp):
                    continue
                spilling = None
            tail = int(((wild == last[0]) & (bits == last[1])).sum()) if b is not None else 0
            ready = len(fp) - tail
            if ready:
                src, dst = links(wild[:ready], bits[:ready], fp[:ready])
                if src:
                    yield batch(np.concatenate(src), np.concatenate(dst), False)
            kept = [x[ready:] for x in (wild, bits, fp)]
            if tail > limit:
                yield batch(kept[2], kept[2], True)
                spilling, kept = last, [x[:0] for x in kept]

    return run


def fingerprint_links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(src, dst): links that connect exactly what distance <= 4 connects, over distinct fingerprints (fp long)."""
    variants = []
    for mask, (a, z) in zip(MASKS, itertools.pairwise(SEGMENTS), strict=True):
        for b in range(a, z):
            variants.append((b, mask & ~(1 << b)))
    keys = F.array(*[F.struct(F.lit(b).alias("wild"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for b, m in variants])
    rows = fps.select("fp", F.explode(keys).alias("k")).select(F.col("k.wild").alias("wild"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("bits"), "fp")
    rows = rows.repartition(F.col("wild"), F.col("bits")).sortWithinPartitions("wild", "bits")
    found = stored(rows.mapInArrow(bucket_links(bucket_limit), "src long, dst long, hot boolean"))
    links = found.where("not hot").select("src", "dst")
    hot = found.where("hot").select(F.col("src").alias("fp")).distinct()
    if not hot.isEmpty():
        links = links.union(midpoint_links(hot))
    return links


def midpoint_links(fps: DataFrame) -> DataFrame:
    """Links of a crowded set: each fingerprint meets the smallest one at every word within two bits of both."""
    from pyspark.sql import Window

    near = [0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in itertools.combinations(range(64), 2))]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in near])
    spread = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid"))
    low = spread.withColumn("low", F.min("fp").over(Window.partitionBy("mid")))
    return low.where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")).distinct()


def components(docs: DataFrame, size: int, bucket_limit: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row of (doc_id, text); root tells components apart."""
    short_batches(docs.sparkSession)
    of = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), fingerprint(size)("text").alias("fp")))
    fps = stored(of.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(fingerprint_links(fps.select("fp"), bucket_limit))
    rooted = fps.join(parts, fps.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted)
    low = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stored(rooted.join(low, "root").select("fp", "root", "component_id"))
    return of.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most four
    differing bits. Null and empty texts have fingerprint zero and link like any
    other. Repeated rows keep one result each. A row without doc_id takes part
    and gets the component's smallest id (null if it has none). An empty table
    gives an empty table. Other columns are ignored.
    """
    return components(docs, size, bucket_limit).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 4) -> DataFrame:
    """The documents that are the first of their component (all columns kept).

    Of several rows of a component with its smallest doc_id the one with the least
    hash of its text stays, once; texts of one doc_id in different components are
    judged each; rows without doc_id stay. Columns of any name are kept.
    """
    free = free_prefix(docs)
    hashed, first_id, first_hash = free + "hash", free + "id", free + "of"
    found = components(docs, size, BUCKET_LIMIT).where("doc_id = component_id")
    first = found.groupBy("doc_id", "root").agg(F.min("text_hash").alias("least"))
    first = stored(first.select(F.col("doc_id").alias(first_id), F.col("least").alias(first_hash)).distinct())
    named = docs.where("doc_id is not null").withColumn(hashed, F.xxhash64("text"))
    kept = named.join(first, (F.col("doc_id") == F.col(first_id)) & (F.col(hashed) == F.col(first_hash)), "left_semi")
    return kept.dropDuplicates(["doc_id", hashed]).drop(hashed).union(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
