"""Operator 12, exact top-k search: best-first search in an M-tree.

With one more coordinate, sqrt(M^2 - |x|^2) for a row (M: the largest norm) and 0
for a query, squared distance is |q|^2 + M^2 - 2qx: the largest inner products are
the nearest rows of a metric space. The tree is bulk-loaded from the top: a node of
more than a page of rows takes up to `FANOUT` of its rows as routing objects, and
its rows go to the nearest. Each node keeps its covering radius and its distance to
the parent's object; a leaf's rows are pages, sorted by their distance to its object.

Queries that lie together in the tree are a block. Each query's own page gives a
first bound on its k-th score. Blocks descend level by level: a child whose stored
parent distance already rules it out by the triangle inequality costs no distance.
The pages that remain are read nearest first, each query's bound growing on the
way; inside a page only rows whose parent distance can still fit are multiplied.
Bounds keep a slack far above rounding and let ties through; scores are integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_within, read_table, short_batches, stored

PAGE, FANOUT = 256, 16
#: Rows of a node from which its queries are a block, rows that go to one task of a split, pages that go to one task of a search.
BLOCK_ROWS, DEAL, STRIPE = 20_000, 16_384, 64
SLACK = 1e-6
#: Norms from which products leave the doubles that hold every integer, and from which they leave 64 bits.
EXACT, LARGEST = float(1 << 52), float(1 << 61)
#: Rounds of splitting; each divides a node of different rows, so a tree is some log_16 of its pages deep.
DEEPEST = 64


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def numbers(v: np.ndarray, largest: float) -> np.ndarray:
    """v so that products are exact: doubles as long as they hold them, else 64-bit integers."""
    return v.astype(np.float64 if largest < EXACT else np.int64)


def packed(v: np.ndarray) -> bytes:
    """The smallest kind of integer that holds v, its width in front."""
    top = int(np.abs(v).max()) if v.size else 0
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + v.astype(kind).tobytes()


def unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, dtype=f"i{b[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def row_distance(x: np.ndarray, y: np.ndarray, largest: float) -> np.ndarray:
    """Distances of rows x to rows y in the metric space."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    plain = np.maximum(nx[:, None] + ny[None, :] - 2 * (x @ y.T), 0)
    up = np.sqrt(np.maximum(largest - nx, 0))[:, None] - np.sqrt(np.maximum(largest - ny, 0))[None, :]
    return np.sqrt(plain + up * up)


def integer_rows(vectors: DataFrame, scale: int, id_col: str, column: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of whole vectors, without repeats."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0)))
    return rows.where(norm < LARGEST).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()


def to_nearest(dim: int, largest: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows of a node (left) to the nearest of its routing objects (right)."""

    def dealt(rows: pa.Table, routes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["vec_id", "v", "block", "node", "dist"]).slice(0, 0)
        objects, names = matrix(routes.column("object"), dim), np.array(routes.column("child").to_pylist(), dtype=object)
        order = np.argsort(names)
        far = row_distance(matrix(rows.column("v"), dim), objects[order], largest)
        best = far.argmin(axis=1)
        node = pa.array(list(names[order][best]), pa.string())
        return pa.table({"vec_id": rows.column("vec_id"), "v": rows.column("v"), "block": rows.column("block"), "node": node, "dist": far.min(axis=1)})

    return dealt


def squared(a: Column, b: Column) -> Column:
    """Squared plain distance of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def above(v: Column, largest: float) -> Column:
    """The further coordinate of a row."""
    return F.sqrt(F.greatest(F.lit(largest) - F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), F.lit(0.0)))


def bulk_load(rows: DataFrame, dim: int, largest: float, page: int = PAGE) -> tuple[DataFrame, list[DataFrame]]:
    """(rows with node, dist and block), and per level the nodes (node, parent, object, to_parent, n, radius).

    rows: (vec_id, v), stored. A node splits as long as it has more than `page` rows that are not all alike.
    """
    first = rows.agg(F.min_by("v", F.xxhash64("vec_id", "v")).alias("object"))  # one row
    root = rows.join(F.broadcast(first)).select("vec_id", "v", F.lit("r").alias("node"), F.sqrt(squared(F.col("v"), F.col("object")) + F.pow(above(F.col("v"), largest) - above(F.col("object"), largest), F.lit(2))).alias("dist"))
    open_ = stored(root.withColumn("block", F.lit(None).cast("string")))
    routes = stored(first.select(F.lit("r").alias("child"), F.lit("").alias("parent"), "object", F.lit(0.0).alias("to_parent")))
    done, levels = None, []
    for level in range(DEEPEST):
        sizes = stored(open_.groupBy("node").agg(F.count("*").alias("n"), F.max("dist").alias("radius")))
        levels.append(stored(routes.withColumnRenamed("child", "node").join(sizes, "node").select("node", "parent", "object", "to_parent", "n", "radius")))
        split = (F.col("n") > page) & (F.col("radius") > 0)
        with_size = open_.join(broadcast_within(sizes.select("node", "n", "radius"), 200_000), "node")
        # a block is the first node on the way down that is small enough, or a part of one that is not divided
        parts = F.ceil(F.col("n") / BLOCK_ROWS)
        part = F.when(parts > 1, F.concat(F.lit("#"), F.pmod(F.xxhash64("vec_id"), parts))).otherwise("")
        block = F.coalesce("block", F.when(~split | (F.col("n") <= BLOCK_ROWS), F.concat("node", part)))
        named = with_size.withColumn("block", block)
        ready = named.where(~split).select("vec_id", "v", "block", "node", "dist", "n")
        done = ready if done is None else done.unionByName(ready)
        if not sizes.where(split).limit(1).count():
            return stored(done), levels
        wide = named.where(split).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(level)), F.ceil(F.col("n") / DEAL)))
        wide = stored(wide.select("vec_id", "v", "block", "node", "part"))
        # up to FANOUT objects: the row of least hash in each of as many groups of vectors
        group = F.pmod(F.xxhash64("v", F.lit(level)), F.lit(FANOUT))
        picked = wide.groupBy("node", group.alias("i")).agg(F.min_by("v", F.xxhash64("v", F.lit(-level))).alias("object"))
        parent = levels[-1].select("node", F.col("object").alias("up"))
        far = F.sqrt(squared(F.col("object"), F.col("up")) + F.pow(above(F.col("object"), largest) - above(F.col("up"), largest), F.lit(2)))
        routes = stored(picked.join(parent, "node").select(F.concat("node", F.lit("."), F.col("i").cast("string")).alias("child"), F.col("node").alias("parent"), "object", far.alias("to_parent")))
        seats = wide.select("node", "part").distinct().join(routes.withColumnRenamed("parent", "node"), "node").select(F.col("node").alias("of"), F.col("part").alias("seat"), "child", "object")
        shape = "vec_id long, v array<bigint>, block string, node string, dist double"
        open_ = stored(wide.groupBy("node", "part").cogroup(seats.groupBy("of", "seat")).applyInArrow(to_nearest(dim, largest), shape))
    raise RuntimeError("the tree did not settle")


PAGES = "page string, node string, block string, radius double, n long, ids binary, vectors binary, dists binary, query long, q binary, bound long"


def pages_of(dim: int, largest: float, every: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """A page: one row with its rows sorted by parent distance, and one per query in it with its k-th score there."""

    def made(rows: pa.Table) -> pa.Table:
        dist = rows.column("dist").to_numpy()
        order = np.lexsort((rows.column("vec_id").to_numpy(), dist))
        ids, dist = rows.column("vec_id").to_numpy()[order], dist[order]
        v = matrix(rows.column("v"), dim)[order]
        blocks = [rows.column("block")[int(i)].as_py() for i in order]
        page, node = rows.column("page")[0].as_py(), rows.column("node")[0].as_py()
        asks = np.flatnonzero(ids % every == 0)
        x = numbers(v, largest)
        scores = (x[asks] @ x.T).astype(np.int64)
        out = {c.split()[0]: [] for c in PAGES.split(", ")}

        def put(**of: object) -> None:
            for c in out:
                out[c].append(of.get(c))

        put(page=page, node=node, radius=float(dist[-1]), n=len(ids), ids=ids.astype(np.int64).tobytes(), vectors=packed(v), dists=dist.astype(np.float64).tobytes())
        for at, mine in zip(asks, scores, strict=True):
            others = mine[ids != ids[at]]
            bound = int(np.partition(others, -k)[-k]) if len(others) >= k else None
            put(page=page, node=node, block=blocks[at], query=int(ids[at]), q=packed(v[at : at + 1]), bound=bound)
        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in PAGES.split(", ")})

    return made


def read_page(page: dict, dim: int, largest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(page["ids"], dtype=np.int64), numbers(unpacked(page["vectors"], dim), largest), np.frombuffer(page["dists"])


def nearest_first(dim: int, largest: float, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k rows of a stripe of pages (left) for each query of a block (right), with the products it took."""

    def searched(pages: pa.Table, queries: pa.Table) -> pa.Table:
        asked = np.array(queries.column("query").to_pylist(), dtype=np.int64)
        raw = [unpacked(b, dim) for b in queries.column("q").to_pylist()]
        out = {c: [] for c in ("query", "no", "vec_id", "score", "products")}
        if len(raw) and pages.num_rows:
            q = np.concatenate(raw)
            exact = numbers(q, largest)
            norm = (q.astype(np.float64) ** 2).sum(axis=1)
            lowest = np.array([np.iinfo(np.int64).min if b is None else b for b in queries.column("bound").to_pylist()], dtype=np.int64)
            best: list[list[tuple[int, int]]] = [[] for _ in asked]  # (-score, vec_id), ascending
            products = np.zeros(len(asked), dtype=np.int64)
            for page in sorted(pages.to_pylist(), key=lambda p: (p["low"], p["page"])):
                reach = np.sqrt(np.maximum(norm + largest - 2 * lowest.astype(np.float64), 0)) * (1 + SLACK) + SLACK
                center = np.array(page["object"], dtype=np.float64)
                far = np.sqrt(np.maximum(norm + largest - 2 * (q @ center), 0))
                active = np.flatnonzero(far - page["radius"] <= reach)
                if not len(active):
                    continue
                ids, v, dists = read_page(page, dim, largest)
                a = np.searchsorted(dists, (far - reach)[active].min() - SLACK)
                z = np.searchsorted(dists, (far + reach)[active].max() + SLACK, "right")
                scores = (exact[active] @ v[a:z].T).astype(np.int64)
                products[active] += z - a
                for row, i in enumerate(active):
                    hits = np.flatnonzero(scores[row] >= lowest[i])
                    hits = hits[ids[a:z][hits] != asked[i]]
                    if len(hits):
                        best[i] = sorted([*best[i], *zip((-scores[row][hits]).tolist(), ids[a:z][hits].tolist(), strict=True)])[:k]
                        if len(best[i]) == k:
                            lowest[i] = max(lowest[i], -best[i][-1][0])
            for i, found in enumerate(best):
                for score, vec_id in found:
                    for c, x in zip(out, (int(asked[i]), queries.column("no")[i].as_py(), vec_id, -score, int(products[i])), strict=True):
                        out[c].append(x)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return searched


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, page: int = PAGE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for rows whose id is divisible by `every` the k largest integer inner
    products of floor(scale * x) with all other rows, ties to the smaller id.

    Vectors that are null, hold null or non-finite components or have a squared
    norm beyond 2^61 (whose scores no 64 bits hold) take no part, nor do rows
    without id. Shorter vectors count as if zeros followed. A row repeated with its
    vector counts once; rows of one id with other vectors are rows of their own,
    queries too, and none of them meets its own id. Other columns are ignored; an
    empty table gives an empty one.
    """
    short_batches(vectors.sparkSession)
    rows = stored(integer_rows(vectors, scale, id_col, column))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    found = rows.agg(F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    largest, dim = float(found.m or 0), max(found.d or 0, 1)
    rows = rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), (dim - F.size("v")).cast("int"))).alias("v"))
    dealt, levels = bulk_load(rows, dim, largest, page)
    number = F.concat("node", F.lit("/"), F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / page)).cast("string"))
    made = stored(dealt.withColumn("page", number).drop("n").groupBy("page").applyInArrow(pages_of(dim, largest, every, k), PAGES))
    pages = made.where("ids is not null").select("page", "node", "radius", "ids", "vectors", "dists")
    queries = made.where("query is not null").select("block", "query", "q", "bound", F.monotonically_increasing_id().alias("no"))
    queries = stored(queries)
    on = descended(made, queries, levels, dim, largest)
    # pages of a block in stripes, each of them with all queries of the block
    stripes = on.groupBy("block").agg(F.ceil(F.count("*") / STRIPE).alias("stripes"))
    on = stored(on.join(stripes, "block").withColumn("stripe", F.pmod(F.xxhash64("page"), F.col("stripes"))))
    left = on.select("block", "stripe", "page", "object", "low").join(pages.drop("node"), "page")
    right = queries.join(on.select("block", "stripe").distinct(), "block").select(F.col("block").alias("of"), F.col("stripe").alias("seat"), "query", "no", "q", "bound")
    best = left.groupBy("block", "stripe").cogroup(right.groupBy("of", "seat")).applyInArrow(nearest_first(dim, largest, k), "query long, no long, vec_id long, score long, products long")
    w = Window.partitionBy("query", "no").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score", "products")


def descended(made: DataFrame, queries: DataFrame, levels: list[DataFrame], dim: int, largest: float) -> DataFrame:
    """(block, page, object, low): the pages that some query of a block may need, low being the least distance possible."""
    numbers_of = F.udf(lambda b: unpacked(bytes(b), dim).ravel().tolist() if b is not None else None, "array<bigint>")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = queries.select("block", "bound", numbers_of("q").alias("v"))
    # a block's center is one of its queries
    center = queries.groupBy("block").agg(F.min_by("q", "no").alias("q")).select("block", numbers_of("q").alias("center"))
    reach = F.sqrt(F.greatest(norm + largest - 2 * F.col("bound").cast("double"), F.lit(0.0)))
    wide = asked.join(center, "block").groupBy("block").agg(F.max(F.sqrt(squared(F.col("v"), F.col("center")))).alias("spread"), F.max(F.coalesce(reach, F.lit(float("inf")))).alias("reach"))
    blocks = stored(center.join(wide, "block").select("block", "center", "spread", (F.col("reach") * (1 + SLACK) + SLACK).alias("reach")))
    to = F.sqrt(squared(F.col("center"), F.col("object")) + F.pow(above(F.col("object"), largest), F.lit(2)))
    top = levels[0].select("node", "object", "radius")
    front = stored(blocks.join(F.broadcast(top)).select("block", "center", "spread", "reach", "node", "object", to.alias("far")))  # one row
    fronts = [front]
    for level in levels[1:]:
        child = level.select(F.col("node").alias("child"), F.col("parent").alias("node"), F.col("object").alias("c_object"), "to_parent", F.col("radius").alias("c_radius"))
        met = front.drop("object").join(child, "node")
        room = F.col("reach") + F.col("spread") + F.col("c_radius")
        # the stored distance to the parent's object first: only what it cannot rule out is measured
        far = F.when(F.abs(F.col("far") - F.col("to_parent")) <= room, F.sqrt(squared(F.col("center"), F.col("c_object")) + F.pow(above(F.col("c_object"), largest), F.lit(2))))
        met = met.withColumn("c_far", far).where(F.col("c_far").isNotNull() & (F.col("c_far") <= room))
        front = stored(met.select("block", "center", "spread", "reach", F.col("child").alias("node"), F.col("c_object").alias("object"), F.col("c_far").alias("far")))
        fronts.append(front)
    leaves = made.where("ids is not null").select("page", "node", "radius")
    every = fronts[0]
    for f in fronts[1:]:
        every = every.unionByName(f)
    low = F.col("far") - F.col("spread") - F.col("radius")
    return stored(every.select("block", "spread", "reach", "node", "object", "far").join(leaves, "node").where(low <= F.col("reach")).select("block", "page", "object", low.alias("low")))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")
