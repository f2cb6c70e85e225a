"""Operator 10, embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine >= c differ by a squared distance of at most 2 - 2c.
After a rotation (fixed by a seed) the coordinates are cut into blocks; in at
least one block the squared distance stays within the block's proportional part
of that budget. Each block is range-joined in cells that adapt to the data: a
label of many vectors is halved again and again by planes, each across a further
coordinate of the block (those of the widest spread first, at the label's mean),
until a cell is the home of some `CELL_ROWS` vectors. A vector visits the other
side of each plane within the block's radius, so both vectors of a pair meet in
the home cell of either. The candidates of all blocks are united (a pair counts
only in the first block that lets it through) and verified exactly, in double
precision, on the vectors as they are.

Equal vectors (by 128 bits of hash of label and components) are one class before
the join. Pairs are counted where they meet and never leave the task: what leaves
is link counts and a spanning forest. A cell beyond 4 * `cell_rows` rows is dealt out
as pairs of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, connected_components, read_table, short_batches, stored

BLOCK = 16
CELL_ROWS = 2048
#: Slack of the candidate search, far above the rounding of doubles.
SLACK = 1e-7
PAIRS = 50_000


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]


def blocks(dim: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, dim)) for a in range(0, dim, width)]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def add_coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, v) -> (label, dim, n, sums): a partition's sums of the turned coordinates and of their squares."""
    for batch in batches:
        label, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            turned = unit(matrix(batch.column("v").take(pa.array(rows)), int(dim))) @ rotation(int(dim))
            names, at = np.unique(label[rows], return_inverse=True)
            sums = np.zeros((len(names), 2 * int(dim)))
            np.add.at(sums, at, np.hstack([turned, turned**2]))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.full(len(names), dim, np.int32)), pa.array(np.bincount(at)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["label", "dim", "n", "sums"])


def choose_planes(width: int, cell_rows: int):
    """Sums of one label -> (label, dim, order, at): per block the coordinates that are cut, widest first, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            head = batch.slice(0, 1)
            n += int(batch.column("n").to_numpy().sum())
            for x in batch.column("sums"):
                total = total + np.frombuffer(x.as_buffer(), dtype=np.float64)
        dim = head.column("dim")[0].as_py()
        mean = total[:dim] / n
        spread = total[dim:] / n - mean**2
        depth = max(int(np.ceil(np.log2(n / cell_rows))), 0)
        order = [a + np.argsort(-spread[a:z], kind="stable")[:depth] for a, z in blocks(dim, width)]
        flat = np.concatenate([np.pad(x, (0, depth - len(x)), constant_values=-1) for x in order]).astype("<i4")
        yield pa.RecordBatch.from_arrays([head.column("label"), head.column("dim"), pa.array([flat.tobytes()], pa.binary()), pa.array([mean[flat].tobytes()], pa.binary())], names=["label", "dim", "order", "at"])

    return run


def meeting_cells(budget: float, width: int):
    """(k, m, label, dim, v, order, at) -> (k, m, label, dim, v, block, cell, home), for every cell that the vector's
    ball touches; without planes a label is one cell."""
    kept = ["k", "m", "label", "dim", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, labels = batch.column("dim").to_numpy(), batch.column("label").to_numpy()
            cut = batch.column("order").is_valid().to_numpy(zero_copy_only=False)
            groups = np.unique(np.stack([dims, np.where(cut, labels, 0), cut]), axis=1).T
            for dim, label, some in groups.tolist():
                pick = (dims == dim) & (cut == bool(some)) & ((labels == label) if some else True)
                rows = batch.filter(pa.array(pick))
                turned = unit(matrix(rows.column("v"), dim)) @ rotation(dim)
                parts = blocks(dim, width)
                order = np.frombuffer(rows.column("order")[0].as_buffer(), dtype="<i4").reshape(len(parts), -1) if some else np.zeros((len(parts), 0), np.int32)
                at = np.frombuffer(rows.column("at")[0].as_buffer(), dtype=np.float64).reshape(len(parts), -1) if some else np.zeros((len(parts), 0))
                for b, (a, z) in enumerate(parts):
                    radius = np.sqrt(budget * (z - a) / dim) + SLACK
                    row, cell, home = np.arange(len(turned)), np.zeros(len(turned), np.int64), np.ones(len(turned), dtype=bool)
                    for j, (c, x) in enumerate(zip(order[b], at[b], strict=True)):
                        if c < 0:
                            break
                        off = turned[row, c] - x
                        near = np.abs(off) <= radius
                        side = (off > 0).astype(np.int64)
                        row, home = np.concatenate([row, row[near]]), np.concatenate([home, np.zeros(near.sum(), dtype=bool)])
                        cell = np.concatenate([cell | (side << j), cell[near] | ((1 - side[near]) << j)])
                    taken = rows.select(kept).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(row), b, dtype=np.int32)), pa.array(cell), pa.array(home)], names=[*kept, "block", "cell", "home"])

    return run


def verified(least: float, width: int):
    """One part of a cell -> (k, peer, n): links counted for k, and links of a spanning forest (n null)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        key, m = table.column("k").to_numpy(), table.column("m").to_numpy()
        role = table.column("role").to_numpy()
        raw = matrix(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"), dim)
        turned = unit(raw) @ rotation(dim)
        budget = 2 - 2 * least
        cut = blocks(dim, width)
        lim = [budget * (z - a) / dim + SLACK for a, z in cut]
        a, z = cut[block]
        left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        own, n, src, dst = [], [], [], []
        norm = np.linalg.norm(raw, axis=1)
        square = (turned[:, a:z] ** 2).sum(axis=1)
        for i0 in range(0, len(left), 256):
            i = left[i0 : i0 + 256]
            d = square[i][:, None] + square[right][None, :] - 2 * turned[i, a:z] @ turned[right, a:z].T
            p, q = np.nonzero((d <= lim[block]) & (key[i][:, None] < key[right][None, :]))
            p, q = i[p], right[q]
            for j in range(0, len(p), PAIRS):
                x, y = p[j : j + PAIRS], q[j : j + PAIRS]
                first = np.ones(len(x), dtype=bool)
                for b in range(block):
                    diff = turned[x, cut[b][0] : cut[b][1]] - turned[y, cut[b][0] : cut[b][1]]
                    first &= (diff**2).sum(axis=1) > lim[b]
                x, y = x[first], y[first]
                close = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= least
                src.append(x[close])
                dst.append(y[close])
        out = {"k": [], "peer": [], "n": []}
        if src:
            x, y = np.concatenate(src), np.concatenate(dst)
            links = np.bincount(x, m[y], len(key)) + np.bincount(y, m[x], len(key))
            own = np.flatnonzero(links)
            low = np.arange(len(key))
            while True:  # smallest row reachable within this part
                new = low.copy()
                np.minimum.at(new, x, low[y])
                np.minimum.at(new, y, low[x])
                new = new[new]
                if (new == low).all():
                    break
                low = new
            tied = np.flatnonzero(low != np.arange(len(key)))
            none = pa.nulls(len(own), pa.int64())
            out = {"k": pa.concat_arrays([pa.array(key[own]), pa.array(key[tied])]), "peer": pa.concat_arrays([none, pa.array(key[low[tied]])]), "n": pa.concat_arrays([pa.array(links[own].astype(np.int64)), pa.nulls(len(tied), pa.int64())])}
        return pa.table(out, schema=pa.schema([("k", pa.int64()), ("peer", pa.int64()), ("n", pa.int64())]))

    return run


def with_planes(classes: DataFrame, width: int, cell_rows: int) -> DataFrame:
    """classes with order and at (see `choose_planes`) for labels of more than cell_rows classes, else null."""
    many = stored(classes.groupBy("label", "dim").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows).select("label", "dim"))
    of = classes.join(broadcast_within(many, 100_000), ["label", "dim"], "left_semi").select("label", "dim", "v")
    sums = of.mapInArrow(add_coordinates, "label long, dim int, n long, sums binary")
    planes = stored(sums.groupBy("label", "dim").applyInArrow(choose_planes(width, cell_rows), "label long, dim int, order binary, at binary"))
    return classes.join(broadcast_within(planes, 20_000), ["label", "dim"], "left")


def class_links(classes: DataFrame, least: float, width: int, cell_rows: int) -> DataFrame:
    """(k, peer, n) over classes (k, m, label, dim, v)."""
    shape = f"k long, m long, label long, dim int, v {classes.schema['v'].dataType.simpleString()}, block int, cell long, home boolean"
    met = with_planes(classes, width, cell_rows).mapInArrow(meeting_cells(2 - 2 * least, width), shape)
    met = stored(met)
    key = ["label", "dim", "block", "cell"]
    crowded = met.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where("homes > 0")
    crowded = stored(crowded.where("rows > 1").select(*key, F.ceil(F.col("rows") / (4 * cell_rows)).cast("int").alias("parts")))
    rows = met.join(broadcast_within(crowded, 2_000_000), key)
    part = F.pmod(F.hash("k", F.lit(1)), F.col("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # part i's homes meet part j's rows in (i, j)
    home = F.transform(every, lambda j: F.struct(part.alias("i"), j.alias("j"), F.when(j == part, 3).otherwise(1).alias("role")))
    visit = F.transform(every, lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(2).alias("role")))
    seats = F.when(F.col("home"), F.concat(home, F.filter(visit, lambda s: s["i"] != s["j"]))).otherwise(visit)
    rows = rows.select(*key, "k", "m", "v", F.explode(seats).alias("s")).select(*key, "k", "m", "v", "s.i", "s.j", "s.role")
    return rows.groupBy(*key, "i", "j").applyInArrow(verified(least, width), "k long, peer long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, width: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors link at cosine >= least if their labels, of any type, are equal and
    not null (labels are told apart by 64 bits of hash).
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing (component_id is their own id); vectors of different
    lengths never link. A repeated row is a vector of its own. A row without
    vec_id links like any other and gets its component's smallest id. Other
    columns are ignored; an empty table gives an empty table.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    v = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0 and 0 are one
    rows = vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"), usable.alias("usable"))
    rows = rows.select("vec_id", "label", "v", F.when(F.col("usable"), F.xxhash64("label", "v")).alias("k1"), F.xxhash64("v", F.lit(1), "label").alias("k2"))
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"), F.first(F.xxhash64("label")).alias("label"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("k", F.monotonically_increasing_id()))
    short_batches(vectors.sparkSession)
    found = stored(class_links(classes.select("k", "m", "label", F.size("v").alias("dim"), "v"), least, width, cell_rows))
    counts = found.where("n is not null").groupBy("k").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("peer is not null").select(F.col("k").alias("src"), F.col("peer").alias("dst")))
    rooted = classes.select("k", "k1", "k2", "m", "first").join(counts, "k", "left").join(parts, F.col("k") == parts.node, "left")
    rooted = stored(rooted.select("k1", "k2", "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "k").alias("root")))
    low = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stored(rooted.join(low, "root").select("k1", "k2", "n_links", "component_id"))
    linked = rows.where("k1 is not null").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
