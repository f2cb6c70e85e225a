"""Operator 6, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Fit: a bounded, hash-ordered sample of the distinct labelled texts of each class
(`sample` of each) gives, per hashed n-gram, the document counts of both
classes; the `features` n-grams with the largest log-count ratios (weighted by
support) are kept, a document's feature is presence times ratio, and a logistic
regression with L2 penalty is fitted on those. The n-grams are hashed in tasks
and counted by groupBy; the driver gets the kept ones and a bitmap of them per
sampled document, no text. Score: one narrow pass over the whole texts with the
bounded model broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, read_table, short_batches, stored

ORDERS = (3, 4, 5, 6)
HASH_BITS = 22
#: Labelled documents of each class used to fit, and n-grams in the model.
SAMPLE, FEATURES = 2500, 1 << 14
#: Code points handled together; features of documents that the solver handles together.
CHUNK = 200_000
BLOCK = 1 << 18
#: Odd multipliers of the n-gram hash (arbitrary).
PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Model:
    slot: np.ndarray  # hashed n-gram -> feature or -1
    weight: np.ndarray  # feature -> weight times log-count ratio
    bias: float


def hashed(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram starting at each code point (HASH_BITS bits)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        h = h * np.uint64(PRIMES[0]) + points[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(PRIMES[1])
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (lower case, padded by a blank on both sides), and the text of each."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    points[points < 33] = 32  # all blanks alike
    return points, np.repeat(np.arange(len(padded)), [len(t) for t in padded])


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hashed n-gram) arrays, order by order; n-grams across texts are left out."""
    points, owner = code_points(texts)
    for order in ORDERS:
        h = hashed(points, order)
        own = owner[: len(h)]
        inside = own == owner[order - 1 : order - 1 + len(h)]
        yield own[inside], h[inside]


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Stretches of texts of about CHUNK code points, with the first one's place."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def presence(texts: list[str], slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    found = []
    for at, some in pieces(texts):
        keys = []
        for own, h in grams(some):
            f = slot[h]
            hit = f >= 0
            keys.append((own[hit] + at) * n + f[hit])
        found.append(np.unique(np.concatenate(keys)))
    keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    return (keys // n).astype(np.int32), (keys % n).astype(np.int32)


def logistic(size: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 80, memory: int = 8) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by limited-memory quasi-Newton steps; classes weigh the same.

    Row i has the next size[i] features of col; a feature's value is its ratio.
    """
    n, ends = len(ratio), np.concatenate([[0], np.cumsum(size)])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] + 1, BLOCK)), [0, len(y)]))

    def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, own, bias, scaled = penalty / 2 * (x[:n] @ x[:n]), np.zeros(n), 0.0, ratio * x[:n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            c, row = col[ends[a] : ends[b]], np.repeat(np.arange(b - a), size[a:b])
            z = np.bincount(row, scaled[c], b - a) + x[n]
            g = share[a:b] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[a:b])
            loss += (share[a:b] * (np.logaddexp(0, z) - y[a:b] * z)).sum()
            own += np.bincount(c, g[row], n)
            bias += g.sum()
        return loss, np.append(ratio * own + penalty * x[:n], bias)

    x = np.zeros(n + 1)
    loss, grad = cost(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, d in reversed(past):
            k = (s @ q) / (s @ d)
            q -= k * d
            kept.append(k)
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, d), k in zip(past, reversed(kept), strict=True):
            q += s * (k - (d @ q) / (s @ d))
        rate = 1.0 if past else 1.0 / max(np.abs(grad).sum(), 1e-12)
        while rate > 1e-10:
            new, new_grad = cost(x - rate * q)
            if new <= loss - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        s, d = -rate * q, new_grad - grad
        if s @ d > 1e-12:
            past = [*past[1 - memory :], (s, d)]
        x, gain, loss, grad = x + s, loss - new, new, new_grad
        if gain < 1e-7:
            break
    return x[:n], float(x[n])


def strengths(n0: np.ndarray, n1: np.ndarray, rows: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio and strength of n-grams that are in n0 and n1 of the `rows` documents of the classes."""
    rate = [(n + 1) / (r + 2) for n, r in zip((n0, n1), rows, strict=True)]
    ratio = (np.log(rate[1]) - np.log(rate[0])).astype(np.float32)
    return ratio, np.where(n0 + n1 < 3, 0, np.abs(ratio) * np.sqrt(np.abs(rate[1] - rate[0])))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n0, n1) of a partition's (text, label): the documents of each class that hold the n-gram."""
    size = 1 << HASH_BITS
    counts = np.zeros((2, size), dtype=np.int32)
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for at, some in pieces(batch.column(0).to_pylist()):
            keys = np.unique(np.concatenate([own * size + h for own, h in grams(some)]))
            own, h = keys // size + at, keys % size
            for c in (0, 1):
                seen, n = np.unique(h[y[own] == c], return_counts=True)
                counts[c, seen] += n.astype(np.int32)
    seen = np.flatnonzero(counts[0] | counts[1])
    for some in np.array_split(seen, len(seen) // 100_000 + 1):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[c][some].astype(np.int64)) for c in (0, 1))], names=["gram", "n0", "n1"])


def bitmaps(slot, n: int):
    """(place, label, text) -> (place, label, bits): which of the n features the text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            row, col = presence(texts, slot.value, n)
            bits = []
            for own in np.split(col, np.searchsorted(row, np.arange(1, len(texts)))) if texts else []:
                flags = np.zeros(n, dtype=np.uint8)
                flags[own] = 1
                bits.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["place", "label", "bits"])

    return run


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    row, col = presence(texts, model.slot, len(model.weight))
    z = np.bincount(row, model.weight[col], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(labelled: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most `sample` distinct texts of each class of (text, label 0 or 1), in order of the text's hash.

    Rows whose text is null or whose label is neither do not count; a text that
    is repeated counts once a class, so copies crowd nothing out. One class alone
    (or no row) gives a model that scores everything with that class's share.
    """
    spark = labelled.sparkSession
    short_batches(spark)
    rows = labelled.where("text is not null and label in (0, 1)").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("text").alias("place"))
    first = least_places(rows.select("label", "place").distinct(), sample)
    rows = rows.join(F.broadcast(first), ["label", "place"], "left_semi")  # at most 2 * sample rows
    rows = stored(rows.groupBy("label", "place").agg(F.first("text").alias("text")))
    n = dict(rows.groupBy("label").agg(F.count("*")).collect())
    slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    if len(n) < 2:
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1) if n else 0.0
        return Model(slot, np.zeros(1), float(np.log(share / (1 - share))) if 0 < share < 1 else -20.0)

    @F.pandas_udf("double")
    def strength(n0: pd.Series, n1: pd.Series) -> pd.Series:
        return pd.Series(strengths(n0.to_numpy(), n1.to_numpy(), (n[0], n[1]))[1])

    counted = rows.select("text", "label").mapInArrow(count_grams, "gram int, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ranked = counted.where("n0 + n1 >= 3").withColumn("strength", strength("n0", "n1")).where("strength > 0")
    chosen = ranked.orderBy(F.desc("strength"), "gram").limit(features).collect()
    if not chosen:
        return Model(slot, np.zeros(1), float(np.log(n[1] / n[0])))
    slot[[r.gram for r in chosen]] = np.arange(len(chosen))
    ratio, _ = strengths(np.array([r.n0 for r in chosen]), np.array([r.n1 for r in chosen]), (n[0], n[1]))
    held = spark.sparkContext.broadcast(slot)
    found = rows.select("place", "label", "text").mapInArrow(bitmaps(held, len(chosen)), "place long, label int, bits binary").collect()
    found.sort(key=lambda r: (r.place, r.label))
    size, col = [], []
    for r in found:
        own = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), count=len(chosen)))
        size.append(len(own))
        col.append(own.astype(np.min_scalar_type(len(chosen))))
    w, b = logistic(np.array(size), np.concatenate(col), ratio, np.array([r.label for r in found]))
    return Model(slot, w * ratio, b)


def scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, [t if isinstance(t, str) else "" for t in texts]))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs, and held_out, score, predicted.

    Labels (doc_id, toxic) are learnt only from rows whose crc32 of doc_id is not
    divisible by 5; only the text is an input of the score. A null text scores as
    an empty one; repeated documents score alike; without usable labels every
    score is next to 0. Columns of docs with the result's names, in capitals or
    not, are replaced; all other names are free.
    """
    columns = quoted(others(docs, "held_out", "score", "predicted"))
    scored = scorer(docs.sparkSession, fit(labelled_sample(docs.select("doc_id", "text"), labels, SAMPLE)))
    return docs.select(*columns, held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def least_places(distinct: DataFrame, sample: int) -> DataFrame:
    """The `sample` rows of the least place for each label, 0 and 1."""
    one, other = (distinct.where(F.col("label") == c).orderBy("place").limit(sample) for c in (0, 1))
    return one.union(other)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, label): the rows of docs (doc_id, text) behind at most `sample` distinct labelled texts of each class, in order
    of the text's hash. Only labels that may be learnt and whose document is there count; ids and hashes are shuffled, no
    text."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("doc_id")))
    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("place"))
    few = keyed.join(known, "doc_id").groupBy("label", "place").agg(F.min("doc_id").alias("_id"))
    few = least_places(few, sample)
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("place"))
    return docs.join(F.broadcast(few), same).select("text", "label")  # at most 2 * sample rows


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever their names."""
    own = F.struct(*quoted(docs.columns)).alias("own")
    return score(docs.select("doc_id", "text", own), labels).where("predicted = 0").select("own.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
