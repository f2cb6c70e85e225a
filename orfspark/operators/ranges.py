"""Reusable joins and groupings on ranges, k-mers and bins.

Spark plans a range predicate alone as a nested loop; each function here adds an
equality (a bin or a k-mer) so that the join shuffles on it instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import grams


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a session on this machine alone gets a temporary one; on a
    cluster that would lose rows (each executor would write to its own disk), so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_orfspark_folder", None) or "file://" + tempfile.mkdtemp(prefix="orfspark-")
        spark.sparkContext._orfspark_folder = folder
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared folder, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orfspark/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over four tasks a core, or more where shuffles have more: small rows with much work each, which Spark would
    join up to a few tasks by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges of (keys, order), stored, with `_p`, the number of the range: a key's rows are split over
    tasks, and a later range holds later rows. Rows alike in keys and order stay together."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))


def inside(keys: list[str], order: list[str]) -> Window:
    """Rows of one range of one key, in order."""
    return Window.partitionBy(*keys, "_p").orderBy(*order)


def carried(df: DataFrame, keys: list[str], **of: Column) -> DataFrame:
    """Join df (see `placed`) with what the ranges before hold of each key: per name a pair of an aggregate of a range
    and how ranges add up (F.sum, F.max, ...). Ranges are as many as tasks."""
    parts = stored(df.groupBy(*keys, "_p").agg(*[x.alias(f"_{n}") for n, (x, _) in of.items()]))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_p", *[f(f"_{n}").over(before).alias(n) for n, (_, f) in of.items()])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_p"]]
    return df.alias("a").join(small(parts).alias("b"), same).select("a.*", *[f"b.{n}" for n in of])


def following(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df (see `placed`) with the next value of `order` of its key, also where that stands in a later range."""
    first = stored(df.groupBy(*keys, "_p").agg(F.min(order).alias("_f")))
    nxt = first.withColumn(name, F.lead("_f").over(Window.partitionBy(*keys).orderBy("_p"))).drop("_f")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_p"]]
    joined = df.alias("a").join(small(nxt).alias("b"), same).select("a.*", F.col(f"b.{name}").alias("_n"))
    return joined.withColumn(name, F.coalesce(F.lead(order).over(inside(keys, [order])), F.col("_n"))).drop("_n")


def running_above(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """df with `<c>_above`: the sum of c over rows of larger `order`, without one task for all rows.

    Rows are dealt by ranges of `order`; each range adds the totals of those above it (a row per range is broadcast).
    """
    placed = stored(df.repartitionByRange(F.desc(order)).withColumn("_p", F.spark_partition_id()))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("_p").agg(*[F.sum(c).alias(c) for c in sums])
    before = per.select("_p", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(before), "_p")
    for c in sums:
        out = out.withColumn(f"{c}_above", F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_p", *[f"_b_{c}" for c in sums])


def exploded_bins(df: DataFrame, start: str, stop: str, width: float, name: str = "_bin") -> DataFrame:
    """One row per bin that [start, stop] touches."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    return df.where(F.col(start) <= F.col(stop)).withColumn(name, F.explode(bins))


def fitting_width(*sides: tuple[DataFrame, tuple[str, str]]) -> float:
    """The intervals' mean length: with bins of this width they touch two each on the average, and few meet that do not
    overlap. One row of each side goes to the driver."""
    sums = [df.where(F.col(lo) <= F.col(hi)).agg(F.count("*").alias("n"), F.sum((F.col(hi) - F.col(lo) + 1).cast("double")).alias("s")).first() for df, (lo, hi) in sides]
    n = sum(r.n for r in sums)
    return max(sum(r.s or 0.0 for r in sums) / n, 1.0) if n else 1.0


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float | None = 10_000) -> DataFrame:
    """Inner join on keys and inclusive overlap; each pair meets once, in the bin where the overlap begins. width: of the
    bins; None for the one that fits the intervals, which are then read once more."""
    width = fitting_width((a, a_range), (b, b_range)) if width is None else width
    left, right = exploded_bins(a, *a_range, width), exploded_bins(b, *b_range, width)
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_rbin"), *[c for c in b.columns if c not in keys])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_bin") == F.col("_rbin")]
    on += [F.col(a_range[0]) <= F.col(b_range[1]), F.col(b_range[0]) <= F.col(a_range[1]), F.col("_bin") == F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width)]
    return left.join(renamed, on).drop("_bin", "_rbin", *[f"_k_{k}" for k in keys])


def contained_in(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], slack: float = 0, width: float | None = 10_000) -> DataFrame:
    """Rows of a inside an interval of b widened by slack."""
    wide = b.withColumn("_lo", F.col(b_range[0]) - slack).withColumn("_hi", F.col(b_range[1]) + slack)
    return overlap_join(a, wide, keys, a_range, ("_lo", "_hi"), width).where((F.col(a_range[0]) >= F.col("_lo")) & (F.col(a_range[1]) <= F.col("_hi"))).drop("_lo", "_hi")


def tolerance_join(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, tol: float) -> DataFrame:
    """Inner join on keys and |left - right| <= tol: a's bin meets b's three neighbouring bins."""
    width = tol if tol > 0 else 1.0
    x = a.withColumn("_bin", F.floor(F.col(left) / width))
    around = F.array(*[F.floor(F.col(right) / width) + d for d in (-1, 0, 1)])
    y = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys], F.explode(around).alias("_rbin"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_bin") == F.col("_rbin"), F.abs(F.col(left) - F.col(right)) <= tol]
    return x.join(y, on).drop("_bin", "_rbin", *[f"_k_{k}" for k in keys])


def kmers(seqs: DataFrame, seq: str, k: int, carry: list[str]) -> DataFrame:
    """(carry..., kmer, pos from 1) of every k-mer."""
    kept = seqs.select(*carry, F.col(seq).alias("_seq"))
    shape = StructType([*kept.schema.fields[:-1], StructField("pos", IntegerType()), StructField("kmer", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, kmer in grams.grams_of(batch, "_seq", k):
                cells = [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(at + 1, pa.int32()), kmer], [*batch.schema.names[:-1], "pos", "kmer"])

    return kept.mapInArrow(cut, shape)


def looked_up(peptides: DataFrame, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """(aminos, size, offset, code): each peptide's stretch with the least hash, of the size for its length; sizes: (size,
    least length, longest)."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(0), np.array([len(t) for t in batch.column(0).to_pylist()])
            for size, shortest, longest in sizes:
                own = texts.take(pa.array(np.flatnonzero((n >= shortest) & (n <= longest))))
                row, at, code = grams.places(own.to_pylist(), size, 1, None)
                order = np.lexsort((at, code, row))
                first = order[np.append(True, np.diff(row[order]) > 0)] if len(order) else order
                yield pa.RecordBatch.from_arrays([own.take(pa.array(row[first])), pa.array(np.full(len(first), size), pa.int32()), pa.array(at[first], pa.int32()), pa.array(code[first].view(np.int64))], ["aminos", "size", "offset", "code"])

    return peptides.select("aminos").mapInArrow(least, "aminos string, size int, offset int, code long")


def seeds(sequences: DataFrame, sizes: list[tuple[int, int, int]], wanted: dict[int, np.ndarray] | None) -> DataFrame:
    """(seq_id, size, code, pos from 0): places of the sequences under which `looked_up` peptides may stand. With `wanted`
    (rising hashes of each size) only those; else the least of each window that the shortest peptide of the size spans,
    two of width + 1."""
    kept = sequences.select("seq_id", "seq").where("seq is not null")
    shape = StructType([kept.schema["seq_id"], StructField("size", IntegerType()), StructField("code", LongType()), StructField("pos", IntegerType())])
    shared = kept.sparkSession.sparkContext.broadcast(wanted)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, shortest, _ in sizes:
                codes, width = (None, shortest - size + 1) if shared.value is None else (shared.value[size], 1)
                for row, at, code in grams.of_batch(batch, "seq", size, width, codes):
                    yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(row)), pa.array(np.full(len(row), size), pa.int32()), pa.array(code.view(np.int64)), pa.array(at, pa.int32())], ["seq_id", "size", "code", "pos"])

    return kept.mapInArrow(found, shape)


def held_places(sequences: DataFrame, sizes: list[tuple[int, int, int]], anchors: pa.Table, dealt: bool = False) -> DataFrame:
    """(aminos, seq_id, pos from 1, prefix, suffix): all places of `looked_up` peptides (anchors), compared in the task that
    finds their hashes, where the sequence is at hand. Sequences are dealt over all cores, unless they are (dealt)."""
    kept = sequences.select("seq_id", "seq").where("seq is not null")
    shape = StructType([StructField("aminos", StringType()), kept.schema["seq_id"], StructField("pos", IntegerType()), StructField("prefix", StringType()), StructField("suffix", StringType())])
    by_size = {}
    for size, _, _ in sizes:
        own = anchors.filter(pc.equal(anchors["size"], size))
        code = own["code"].to_numpy().view(np.uint64)
        order = np.argsort(code, kind="stable")
        by_size[size] = code[order], own["offset"].to_numpy()[order], own["aminos"].combine_chunks().take(pa.array(order))
    shared = kept.sparkSession.sparkContext.broadcast(by_size)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("seq").to_pylist()
            for size, (codes, offsets, peptides) in shared.value.items():
                for row, at, code in grams.of_batch(batch, "seq", size, 1, codes):
                    first = np.searchsorted(codes, code)
                    n = np.searchsorted(codes, code, "right") - first
                    peptide = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    row, start = np.repeat(row, n), np.repeat(at, n) - offsets[peptide]
                    out: list[list] = [[] for _ in range(5)]
                    for i, a, p in zip(row.tolist(), start.tolist(), peptides.take(pa.array(peptide)).to_pylist(), strict=True):
                        text = texts[i]
                        if a >= 0 and text.startswith(p, a):
                            stop = a + len(p)
                            for c, x in zip(out, (p, i, a + 1, text[a - 1] if a else None, text[stop] if stop < len(text) else None), strict=True):
                                c.append(x)
                    cells = [pa.array(out[0], pa.string()), batch.column("seq_id").take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())]
                    yield pa.RecordBatch.from_arrays(cells, ["aminos", "seq_id", "pos", "prefix", "suffix"])

    return (kept if dealt else spread(kept)).mapInArrow(found, shape)


def compared_places(sequences: DataFrame, begin: DataFrame) -> DataFrame:
    """`held_places` of peptides (aminos) that may begin at (seq_id, pos), by a join with their sequences."""
    spots = sequences.select("seq_id", "seq").join(small(begin.select("seq_id").distinct()), "seq_id", "left_semi")
    found = spots.join(begin.groupBy("seq_id").agg(F.collect_list(F.struct("aminos", "pos")).alias("at")), "seq_id")
    letter = lambda i: F.substr(F.col("seq"), i, F.lit(1))
    stop = lambda x: x["pos"] + F.length(x["aminos"])
    true = F.filter("at", lambda x: F.substr(F.col("seq"), x["pos"], F.length(x["aminos"])) == x["aminos"])
    seen = F.transform(true, lambda x: F.struct(x["aminos"].alias("aminos"), x["pos"].alias("pos"), F.when(x["pos"] > 1, letter(x["pos"] - 1)).alias("prefix"), F.when(stop(x) <= F.length("seq"), letter(stop(x))).alias("suffix")))
    return found.select("seq_id", F.explode(seen).alias("x")).select("x.aminos", "seq_id", "x.pos", "x.prefix", "x.suffix")


def map_peptides(peptides: DataFrame, sequences: DataFrame, k: int = 6, max_broadcast: int = 1_000_000, max_letters: int = 32_000_000, dealt: bool = False) -> DataFrame:
    """All exact places (aminos, seq_id, pos from 1, prefix, suffix, n_places, is_unique, tryptic_n, tryptic_c).

    Peptides: aminos. Sequences: seq_id, seq. A peptide is looked up under the one of its stretches that has the least
    hash, and compared where that stands; shorter ones than k under themselves. Up to `max_broadcast` peptides: their
    hashes are sent to the tasks, stretches of k or 2k letters, with the peptides where these have `max_letters` in all,
    and only places that have one leave the task. Beyond: sequences shuffle the least stretch of each window that the
    shortest peptide spans. Overlapping places count. dealt: sequences are of a stored table of many, which all cores read.
    """
    wanted = stored(peptides.select("aminos").where("aminos is not null and aminos <> ''").distinct())
    lengths = {r.n: r.rows for r in wanted.groupBy(F.length("aminos").alias("n")).agg(F.count("*").alias("rows")).collect()}  # a row for each length
    few = sum(lengths.values()) <= max_broadcast
    sizes = [(n, n, n) for n in sorted(lengths) if n < k]
    if few:
        sizes += [(size, min(own), max(own)) for size, own in ((k, [n for n in lengths if k <= n < 2 * k]), (2 * k, [n for n in lengths if n >= 2 * k])) if own]
    elif own := [n for n in lengths if n >= k]:
        sizes.append((min(max(k, min(own) - 2), 2 * k), min(own), max(own)))
    anchors = stored(looked_up(wanted, sizes))
    if few and sum(n * rows for n, rows in lengths.items()) <= max_letters:
        found = stored(held_places(sequences, sizes, anchors.toArrow(), dealt))
    else:
        codes = None
        if few:
            rows = anchors.select("size", "code").distinct().toPandas()
            codes = {size: np.sort(rows["code"][rows["size"] == size].to_numpy(np.int64).view(np.uint64)) for size, _, _ in sizes}
        begin = seeds(sequences, sizes, codes).join(small(anchors), ["size", "code"]).select("seq_id", "aminos", (F.col("pos") - F.col("offset") + 1).alias("pos")).where("pos > 0")
        found = stored(compared_places(sequences, stored(begin)))
    n = found.groupBy("aminos").agg(F.count("*").alias("n_places"))
    first, last = F.substr(F.col("aminos"), F.lit(1), F.lit(1)), F.substr(F.col("aminos"), F.length("aminos"), F.lit(1))
    out = found.join(n, "aminos").withColumn("is_unique", F.col("n_places") == 1)
    tryptic_n = F.coalesce(F.col("prefix").isin("K", "R") & (first != "P"), F.lit(False))
    tryptic_c = F.col("suffix").isNull() | (last.isin("K", "R") & (F.col("suffix") != "P"))
    return out.withColumn("tryptic_n", tryptic_n).withColumn("tryptic_c", tryptic_c)


def nearest_peak(targets: DataFrame, peaks: DataFrame, keys: list[str], target: str, mz: str, intensity: str, tol: float) -> DataFrame:
    """Per target row the intensity of the nearest peak within tol, 0 if none (ties: the lower mz)."""
    ids = [*keys, target]
    met = tolerance_join(targets.select(*ids).distinct(), peaks.select(*keys, mz, intensity), keys, target, mz, tol)
    best = met.groupBy(*ids).agg(F.min_by(intensity, F.struct(F.abs(F.col(mz) - F.col(target)), F.col(mz))).alias("intensity"))
    return targets.join(best, ids, "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def group_by_gap(df: DataFrame, keys: list[str], start: str, stop: str, gap: float, tie: list[str]) -> DataFrame:
    """group_no per key; a feature more than gap behind all before it begins a group. A key's features are dealt by
    ranges of start; ranges hand on their largest stop, and then their number of groups."""
    order = [start, stop, *tie]
    rows = carried(placed(df, keys, [start]), keys, _far=(F.max(stop), F.max))
    w = inside(keys, order)
    before = F.greatest(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    rows = stored(rows.withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)).drop("_far"))
    rows = carried(rows, keys, _groups=(F.sum("_new"), F.sum))
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_groups", F.lit(0))
    return rows.withColumn("group_no", number).select(*df.columns, "group_no")


def runs_above(coverage: DataFrame, keys: list[str], pos: str, n: str, least: float) -> DataFrame:
    """Stretches of contiguous positions with n above least: (keys, start, stop, top). A key's positions (each of
    them once) are dealt by ranges."""
    rows = carried(placed(coverage.where(F.col(n) > least), keys, [pos]), keys, _rows=(F.count("*"), F.sum))
    island = F.col(pos) - F.row_number().over(inside(keys, [pos])) - F.coalesce("_rows", F.lit(0))
    return rows.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.max(n).alias("top")).drop("_i")


def coverage_of(intervals: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """(keys, start, stop, n): stretches of equal depth above zero, by sums over interval ends dealt by ranges;
    positions are never exploded."""
    ends = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).union(intervals.select(*keys, (F.col(stop) + 1).alias("at"), F.lit(-1).alias("d")))
    steps = following(placed(ends.groupBy(*keys, "at").agg(F.sum("d").alias("d")), keys, ["at"]), keys, "at", "next")
    steps = carried(steps, keys, _depth=(F.sum("d"), F.sum))
    depth = F.sum("d").over(inside(keys, ["at"]).rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_depth", F.lit(0))
    return steps.select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("stop"), depth.alias("n")).where("n > 0")


def split_disjoint(intervals: DataFrame, keys: list[str], start: str, stop: str, members: list[str] | None = None) -> DataFrame:
    """U4: disjoint pieces of overlapping intervals: (keys, start, stop, n, piece, next_piece): the number of intervals
    over each, a number of its own within the key, and that of the piece that begins where it ends. With `members`
    (columns of the intervals) a row for each piece and interval over it instead, which hands the intervals' links on."""
    cuts = intervals.select(*keys, F.col(start).alias("at")).union(intervals.select(*keys, (F.col(stop) + 1).alias("at"))).distinct()
    pieces = following(placed(cuts, keys, ["at"]), keys, "at", "next").where("next is not null")
    pieces = pieces.select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("stop"))
    over = intervals.select(*keys, F.col(start).alias("_a"), F.col(stop).alias("_z"), *[F.col(m).alias(f"_m_{m}") for m in members or []])
    if members:
        return overlap_join(pieces, over, keys, ("start", "stop"), ("_a", "_z")).select(*keys, "start", "stop", *[F.col(f"_m_{m}").alias(m) for m in members])
    deep = coverage_of(intervals, keys, start, stop).select(*keys, F.col("start").alias("_a"), F.col("stop").alias("_z"), "n")
    found = overlap_join(pieces, deep, keys, ("start", "stop"), ("_a", "_z")).select(*keys, "start", "stop", "n")
    rows = carried(following(placed(found, keys, ["start"]), keys, "start", "_next"), keys, _rows=(F.count("*"), F.sum))
    piece = F.row_number().over(inside(keys, ["start"])) + F.coalesce("_rows", F.lit(0))
    return rows.withColumn("piece", piece.cast("long")).select(*keys, "start", "stop", "n", "piece", F.when(F.col("_next") == F.col("stop") + 1, F.col("piece") + 1).alias("next_piece"))


def relink(pieces: DataFrame, intervals: DataFrame, links: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """U4: (keys, from_piece, to_piece, kind, links): links between intervals handed on to their pieces (`split_disjoint`):
    what led into an interval leads into its first piece, what led out of it leaves its last, equal ones being added up;
    and a link of kind adjacent from each piece to the one that begins where it ends.

    intervals: id and place; links: (from_id, to_id) of intervals of one key. Every step is an equality join.
    """
    place = lambda of, at, name: intervals.select(F.col("id").alias(of), *keys, F.col(at).alias(name))
    ends = links.join(place("from_id", stop, "_leaves"), "from_id").join(place("to_id", start, "_enters").drop(*keys), "to_id")
    last = pieces.select(*keys, F.col("stop").alias("_leaves"), F.col("piece").alias("from_piece"))
    first = pieces.select(*keys, F.col("start").alias("_enters"), F.col("piece").alias("to_piece"))
    moved = ends.join(last, [*keys, "_leaves"]).join(first, [*keys, "_enters"]).groupBy(*keys, "from_piece", "to_piece").agg(F.count("*").alias("links"))
    beside = pieces.where("next_piece is not null").select(*keys, F.col("piece").alias("from_piece"), F.col("next_piece").alias("to_piece"), F.lit(0).cast("long").alias("links"))
    return moved.withColumn("kind", F.lit("link")).unionByName(beside.withColumn("kind", F.lit("adjacent"))).select(*keys, "from_piece", "to_piece", "kind", "links")


def bin_spine(df: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """Every bin between the least and the largest of each key."""
    ends = df.groupBy(*keys).agg(F.min(bin_col).alias("_a"), F.max(bin_col).alias("_z")) if keys else df.agg(F.min(bin_col).alias("_a"), F.max(bin_col).alias("_z"))
    # in two steps, so that a far outlier makes many rows and not one endless array
    steps = ends.where("_a is not null").select(*keys, F.explode(F.sequence(F.col("_a"), F.col("_z"), F.lit(100_000).cast("long"))).alias("_s"), "_z")
    return steps.select(*keys, F.explode(F.sequence("_s", F.least(F.col("_s") + 99_999, F.col("_z")))).alias(bin_col))


def histogram(df: DataFrame, value: str | Column, width: float, keys: list[str] | None = None, origin: float = 0.0) -> DataFrame:
    """(keys, bin, n, cum, share) with every bin between the ends; bins are floor((x - origin) / width)."""
    keys = keys or []
    x = F.col(value) if isinstance(value, str) else value
    counts = df.where(x.isNotNull()).groupBy(*keys, F.floor((x - origin) / width).alias("bin")).agg(F.count("*").alias("n"))
    full = bin_spine(counts, keys, "bin").join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bin")
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return full.withColumn("cum", cum).withColumn("share", F.col("cum") / total)


def attribute_histogram(df: DataFrame, value: str, width: float, decoy: str = "is_decoy") -> DataFrame:
    """(bin, true_hits, false_hits, true_above, false_above) of an attribute: true hits less decoys and decoys in
    each bin with rows, and in it or any higher one. The running sums are over bins dealt by ranges."""
    n = df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count_if(~F.col(decoy)).alias("t"), F.count_if(F.col(decoy)).alias("f"))
    up = running_above(n, "bin", ["t", "f"])
    return up.select("bin", (F.col("t") - F.col("f")).alias("true_hits"), F.col("f").alias("false_hits"), (F.col("t_above") + F.col("t") - F.col("f_above") - F.col("f")).alias("true_above"), (F.col("f_above") + F.col("f")).alias("false_above"))
