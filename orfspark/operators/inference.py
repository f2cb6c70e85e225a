"""Protein inference, coverage, abundance and group comparison."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import ranges
from .graph import components
from .ranges import small, stored


def entries(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of these rows' entries in a table that holds a row's from first[row] on, and how many each row has."""
    n = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


#: Rows that are counted or given numbers at once.
AT_ONCE = 1 << 20


class Cover:
    """The rounds of `select_proteins` on pairs of numbers (proteins in the order of their names).

    A protein that is not taken keeps a better one and a peptide they share as its witness; it is looked at again only
    when that peptide is gone or that protein no better. So a round costs what it takes away and one look at each witness.
    """

    def __init__(self, p: np.ndarray, a: np.ndarray, spectra: np.ndarray, least: int) -> None:
        self.proteins, peptides = int(p.max(initial=-1)) + 1, int(a.max(initial=-1)) + 1
        self.gone, self.least = np.zeros(peptides, dtype=bool), max(least, 1)
        self.exact = spectra.dtype.kind == "i" or (bool((spectra == np.floor(spectra)).all()) and float(np.abs(spectra).sum()) < 2**53)
        self.n, self.total = np.zeros(self.proteins, dtype=np.int64), np.zeros(self.proteins)
        for i in range(0, len(p), AT_ONCE):  # in parts, since bincount copies what it counts
            own = p[i : i + AT_ONCE]
            self.n += np.bincount(own, minlength=self.proteins)
            self.total += np.bincount(own, spectra[i : i + AT_ONCE], minlength=self.proteins)
        self.alive = self.n >= self.least
        self.witness, self.through = np.full(self.proteins, -1), np.zeros(self.proteins, dtype=np.int64)
        self.p, self.peptide_of, self.spectra = p, a, spectra
        self.protein_of = None  # not laid out yet, so that the caller can let go of the pairs

    def lay(self) -> None:
        """Lay out the pairs that are left by protein and by peptide, a column at a time."""
        self.protein_of = self.spectra_of = None
        keep = self.alive[self.p] & ~self.gone[self.peptide_of]
        if not keep.all():
            self.p, self.peptide_of, self.spectra = self.p[keep], self.peptide_of[keep], self.spectra[keep]
        order = np.argsort(self.p, kind="stable")
        self.p = self.p[order]
        self.peptide_of = self.peptide_of[order]
        self.spectra = self.spectra[order]
        self.of_protein = np.searchsorted(self.p, np.arange(self.proteins + 1, dtype=self.p.dtype))
        order = np.argsort(self.peptide_of, kind="stable")
        self.protein_of, self.spectra_of = self.p[order], self.spectra[order]
        del order
        self.of_peptide = np.append(0, np.cumsum(np.bincount(self.peptide_of, minlength=len(self.gone))))
        self.taken_away = 0

    def better(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        n, t = self.n[q] - self.n[p], self.total[q] - self.total[p]
        return (n > 0) | ((n == 0) & ((t > 0) | ((t == 0) & (q < p))))

    def best_of(self, peptides: np.ndarray) -> np.ndarray:
        """The best protein left on each of these peptides, which have one each."""
        at, n = entries(self.of_peptide, peptides)
        begin, q = np.cumsum(n) - n, self.protein_of[at]
        top = np.where(self.alive[q], self.n[q], -1)
        fits = top == np.repeat(np.maximum.reduceat(top, begin), n)
        total = np.where(fits, self.total[q], -np.inf)
        fits &= total == np.repeat(np.maximum.reduceat(total, begin), n)
        return np.minimum.reduceat(np.where(fits, q, self.proteins), begin)

    def beaten(self, rows: np.ndarray, reach: int | None) -> np.ndarray:
        """Whether a better protein shares one of the first `reach` peptides (or any) with each of rows: its new witness."""
        size = self.of_protein[rows + 1] - self.of_protein[rows]
        if reach is not None:
            size = np.minimum(size, reach)
        row = np.repeat(np.arange(len(rows)), size)
        a = self.peptide_of[np.repeat(self.of_protein[rows] - np.cumsum(size) + size, size) + np.arange(len(row))]
        left = ~self.gone[a]
        row, a = row[left], a[left]
        if not len(row):
            return np.zeros(len(rows), dtype=bool)
        wanted, own = np.unique(a, return_inverse=True)
        q = self.best_of(wanted)[own]
        lost = np.flatnonzero(q != rows[row])
        lost = lost[np.argsort(self.n[q[lost]], kind="stable")]  # of several the one with most peptides stays
        self.witness[rows[row[lost]]], self.through[rows[row[lost]]] = q[lost], a[lost]
        found = np.zeros(len(rows), dtype=bool)
        found[row[lost]] = True
        return found

    def next_round(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs that one round takes; None when no protein is left."""
        if self.protein_of is None:
            self.lay()
        live = np.flatnonzero(self.alive)
        if not len(live):
            return None
        q = self.witness[live]
        known = (q >= 0) & self.alive[q] & ~self.gone[self.through[live]]
        known[known] = self.better(q[known], live[known])
        rows = live[~known]
        for reach in (8, None):
            rows = rows[~self.beaten(rows, reach)]
        at, n = entries(self.of_protein, rows)
        p, a = np.repeat(rows, n), self.peptide_of[at]
        left = ~self.gone[a]
        p, a = p[left], a[left]
        self.gone[a], self.alive[rows] = True, False
        at, _ = entries(self.of_peptide, a)
        q = self.protein_of[at]
        self.n = self.n - np.bincount(q, minlength=self.proteins)
        self.alive &= self.n >= self.least
        if self.exact:
            self.total = self.total - np.bincount(q, self.spectra_of[at], minlength=self.proteins)
        else:  # differences of fractions would drift from sums
            changed = np.unique(q)
            at, n = entries(self.of_protein, changed)
            self.total[changed] = np.bincount(np.repeat(np.arange(len(changed)), n), np.where(self.gone[self.peptide_of[at]], 0, self.spectra[at]), minlength=len(changed))
        self.taken_away += len(q)
        if 2 * self.taken_away > len(self.p):
            self.lay()
        return p, a


class Numbered:
    """A column's values as numbers, gathered batch by batch: four bytes a row, and each value once."""

    def __init__(self) -> None:
        self.parts: list[pa.DictionaryArray] = []
        self.rows, self.values = 0, pa.chunked_array([pa.array([]).dictionary_encode()])

    def add(self, column: pa.Array) -> None:
        self.parts.append(column.dictionary_encode())
        self.rows += len(column)
        if self.rows >= AT_ONCE:
            self.fold()

    def fold(self) -> None:
        """Give what has come in one dictionary with what was there."""
        old = [c for c in self.values.chunks if len(c)]
        if self.parts:
            self.values = pa.chunked_array([*old, *self.parts]).unify_dictionaries()
            self.values = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.concat_arrays([c.indices for c in self.values.chunks]), self.values.chunk(self.values.num_chunks - 1).dictionary)])
        self.parts, self.rows = [], 0

    def in_order(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the values, in their order, and the values."""
        self.fold()
        coded = self.values.chunk(0)
        order = pc.sort_indices(coded.dictionary)
        number = np.empty(len(order), dtype=np.int32)
        number[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        return number[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def counts_of(column: pa.Array) -> np.ndarray:
    """Numbers as 32-bit integers where they are that small, else in double precision."""
    x = column.to_numpy(zero_copy_only=False)
    return x.astype(np.int32) if x.dtype.kind == "i" and np.abs(x).max(initial=0) < 2**31 else x.astype(np.float64)


def cover_rounds(batches: Iterable[pa.RecordBatch], min_peptides: int, first: int) -> pa.Table:
    """(protein, aminos, round) of some components' pairs (aminos, protein, spectra): the rounds of `select_proteins`. Of
    batches only numbers stay."""
    proteins, peptides, spectra = Numbered(), Numbered(), []
    for batch in batches:
        proteins.add(batch.column("protein"))
        peptides.add(batch.column("aminos"))
        spectra.append(counts_of(batch.column("spectra")))
    if not sum(map(len, spectra)):
        return pa.table({"protein": pa.nulls(0), "aminos": pa.nulls(0), "round": pa.array([], pa.int64())})
    p, proteins = proteins.in_order()
    a, peptides = peptides.in_order()
    spectra = np.concatenate(spectra)
    cover, out, number = Cover(p, a, spectra, min_peptides), [], first
    del p, a, spectra
    while taken := cover.next_round():
        out.append((*taken, np.full(len(taken[0]), number)))
        number += 1
    p, a, rounds = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
    return pa.table({"protein": proteins.take(pa.array(p)), "aminos": peptides.take(pa.array(a)), "round": pa.array(rounds, pa.int64())})


def covering(min_peptides: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cover_rounds(batches, min_peptides, first).combine_chunks().to_batches()

    return covered


def best_around(left: DataFrame, min_peptides: int, number: int) -> tuple[DataFrame, DataFrame]:
    """One round of `select_proteins` on Spark: the pairs taken, and what is left of the pairs."""
    size = left.groupBy("protein").agg(F.count("*").alias("peptides"), F.sum("spectra").alias("total")).where(F.col("peptides") >= min_peptides)
    # larger is better; the protein's name decides ties
    scored = stored(left.join(size, "protein").select("aminos", "protein", "spectra", F.struct(-F.col("peptides"), -F.col("total"), F.col("protein")).alias("key")))
    best = scored.groupBy("aminos").agg(F.min("key").alias("best"))
    wins = scored.join(best, "aminos").groupBy("protein").agg(F.every(F.col("key") == F.col("best")).alias("wins")).where("wins").select("protein")
    taken = stored(scored.join(wins, "protein", "left_semi").select("protein", "aminos", F.lit(number).cast("long").alias("round")))
    return taken, stored(scored.join(taken.select("aminos").distinct(), "aminos", "left_anti").select("aminos", "protein", "spectra"))


def select_proteins(pep_protein: DataFrame, min_peptides: int = 1, task_pairs: int = 1_000_000, whole_pairs: int = 40_000_000, rounds: int = 8) -> DataFrame:
    """Parsimonious proteins by greedy cover: (protein, aminos, round); each peptide has one owner.

    pep_protein: (aminos, protein, spectra). The order is (peptides, spectra)
    descending, then protein. A round takes every protein that no better one
    shares a peptide with, which is what taking the best one at a time comes to;
    the number of a protein's round depends on its own component of the
    peptide-protein graph alone. Components of up to `task_pairs` pairs are dealt
    over tasks, some to a task; those of up to `whole_pairs`, whose rounds wait for
    one another, are a task each, as arrays of numbers (see `Cover`; 1.5 GB for 36
    million pairs, measured). Larger ones go
    through `rounds` rounds on Spark and then come apart into components anew.
    Peptides count once per protein; rows without aminos or protein are left out.
    """
    left = stored(pep_protein.where("aminos is not null and protein is not null").groupBy("aminos", "protein").agg(F.max("spectra").alias("spectra")))
    kinds = dict(left.dtypes)
    shape = f"protein {kinds['protein']}, aminos {kinds['aminos']}, round long"
    chosen, number = [], 0
    while True:
        # two proteins with one hash share a component: more than needed, never less
        node = F.xxhash64("protein")
        heads = left.groupBy("aminos").agg(F.min(node).alias("b"))
        parts = components(left.join(heads, "aminos").select(node.alias("a"), "b"))
        named = stored(left.withColumn("node", node).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"))
        sizes = stored(named.groupBy("component").agg(F.count("*").alias("pairs")))
        fit = sizes.where(F.col("pairs") <= task_pairs)
        tasks = int((fit.agg(F.sum("pairs")).first()[0] or 0) // max(task_pairs, 1)) + 1
        dealt = named.join(small(fit.select("component")), "component", "left_semi").withColumn("task", F.pmod("component", F.lit(tasks)))

        chosen.append(dealt.groupBy("task").applyInArrow(covering(min_peptides, number), shape))
        whole = sizes.where(F.col("pairs").between(task_pairs + 1, whole_pairs)).select("component")
        chosen.append(named.join(small(whole), "component", "left_semi").groupBy("component").applyInArrow(covering(min_peptides, number), shape))
        large = sizes.where(F.col("pairs") > max(task_pairs, whole_pairs))
        if not large.limit(1).count():
            return union_all(*chosen)
        left = stored(named.join(large, "component", "left_semi").select("aminos", "protein", "spectra"))
        for _ in range(rounds):
            taken, left = best_around(left, min_peptides, number)
            chosen.append(taken)
            number += 1


def indistinguishable(pep_protein: DataFrame, least: int = 2) -> DataFrame:
    """(protein, set_of, n_proteins, n_peptides) of proteins that share their whole peptide set with others;
    set_of is the least of them.

    Sets are compared by counts and two order-free digests of their members, so no set is gathered.
    """
    pairs = pep_protein.select("aminos", "protein").distinct()
    sets = pairs.groupBy("protein").agg(F.count("*").alias("n_peptides"), F.expr("bit_xor(xxhash64(aminos))").alias("x"), F.expr("bit_xor(xxhash64(aminos, 1))").alias("y")).where(F.col("n_peptides") >= least)
    sets = stored(sets)
    groups = stored(sets.groupBy("n_peptides", "x", "y").agg(F.min("protein").alias("set_of"), F.count("*").alias("n_proteins")).where("n_proteins > 1"))
    return sets.join(groups, ["n_peptides", "x", "y"]).select("protein", "set_of", "n_proteins", "n_peptides")


def protein_report(pep_protein: DataFrame) -> DataFrame:
    """A10: per protein the numbers of unique and shared peptides and of spectra."""
    shared = pep_protein.groupBy("aminos").agg(F.count_distinct("protein").alias("n"))
    rows = pep_protein.join(shared, "aminos")
    return rows.groupBy("protein").agg(F.count_if(F.col("n") == 1).alias("unique_peptides"), F.count_if(F.col("n") > 1).alias("shared_peptides"), F.sum("spectra").alias("spectra"))


def residue_coverage(mapped: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, covered, percent) from mapped (seq_id, pos, stop) without exploding residues."""
    depth = ranges.coverage_of(mapped.select("seq_id", F.col("pos").alias("start"), "stop"), ["seq_id"], "start", "stop")
    covered = depth.groupBy("seq_id").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("covered"))
    out = sequences.select("seq_id", F.length("seq").alias("length")).join(covered, "seq_id", "left")
    return out.select("seq_id", "length", F.coalesce("covered", F.lit(0)).alias("covered"), (100 * F.coalesce("covered", F.lit(0)) / F.col("length")).alias("percent"))


def modified_coverage(mapped: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per sequence the residues covered by any peptide, by unmodified and by modified ones, and by both kinds.

    mapped: (seq_id, pos, stop, is_modified). |A and B| is |A| + |B| - |A or B|.
    """
    part = lambda df, name: residue_coverage(df, sequences).select("seq_id", F.col("covered").alias(name))
    bare, mod = mapped.where(~F.col("is_modified")), mapped.where("is_modified")
    out = residue_coverage(mapped, sequences).join(part(bare, "unmodified"), "seq_id").join(part(mod, "modified"), "seq_id")
    return out.withColumn("both", F.col("unmodified") + F.col("modified") - F.col("covered"))


def coverage_histogram(coverage: DataFrame) -> DataFrame:
    """(decile, proteins): sequences by tenths of the share that is covered, 10 for the whole."""
    decile = F.least(F.floor(F.col("percent") / 10), F.lit(10))
    return coverage.where("length > 0").groupBy(decile.alias("decile")).agg(F.count("*").alias("proteins"))


def most_shared(lists: DataFrame, protein: StructField) -> DataFrame:
    """(protein, sister, shared): of each protein's lists (protein, sisters array) the sister that stands in most of them
    (ties: the least name). A protein's lists follow one another in a task, and its sisters are counted in parts."""
    shape = StructType([StructField("protein", protein.dataType), StructField("sister", protein.dataType), StructField("shared", LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None  # the protein at hand and its counts (sister, n)

        def best() -> pa.RecordBatch:
            top = known.filter(pc.equal(known["n"], pc.max(known["n"])))
            return pa.RecordBatch.from_arrays([pa.array([now], known["sister"].type), pa.array([pc.min(top["sister"]).as_py()], known["sister"].type), pa.array([pc.max(known["n"]).as_py()], pa.int64())], ["protein", "sister", "shared"])

        for batch in batches:
            names = batch.column("protein")
            if not len(names):
                continue
            row = pc.list_parent_indices(batch.column("sisters"))
            flat = pa.table({"protein": names.take(row), "sister": pc.list_flatten(batch.column("sisters")), "n": pa.array(np.ones(len(row), dtype=np.int64))})
            flat = flat.filter(pc.not_equal(flat["protein"], flat["sister"]))
            if known is not None:
                flat = pa.concat_tables([pa.table({"protein": pa.array([now] * len(known), names.type), "sister": known["sister"], "n": known["n"]}), flat])
            sums = flat.group_by(["protein", "sister"]).aggregate([("n", "sum")])
            last = names[len(names) - 1]
            own, done = pc.equal(sums["protein"], last), sums.filter(pc.not_equal(sums["protein"], last))
            top = done.join(done.group_by("protein").aggregate([("n_sum", "max")]), "protein")
            first = top.filter(pc.equal(top["n_sum"], top["n_sum_max"])).group_by(["protein", "n_sum_max"]).aggregate([("sister", "min")])
            for part in first.select(["protein", "sister_min", "n_sum_max"]).rename_columns(["protein", "sister", "shared"]).combine_chunks().to_batches():
                yield part
            rest = sums.filter(own)
            now, known = (last.as_py(), pa.table({"sister": rest["sister"], "n": rest["n_sum"]})) if len(rest) else (None, None)
        if known is not None:
            yield best()

    return ranges.spread(lists, "protein").sortWithinPartitions("protein").mapInArrow(counted, shape)


def sister_proteins(pep_protein: DataFrame, report: DataFrame, most: int = 1_000) -> DataFrame:
    """(protein, sister, shared): for proteins without a peptide of their own, the one that has most of their
    peptides (ties: the least name). report is `protein_report`.

    A peptide sends the list of its proteins to each that is in need, in parts of up to `most`, and pairs are made and
    counted there.
    """
    alone = report.where("unique_peptides = 0").select("protein")
    wanted = pep_protein.select("aminos", "protein").where("aminos is not null and protein is not null").distinct()
    n = F.pmod(F.xxhash64("protein"), F.ceil(F.col("n") / most))
    parts = wanted.join(wanted.groupBy("aminos").agg(F.count("*").alias("n")).where("n > 1"), "aminos")
    lists = parts.groupBy("aminos", n.alias("part")).agg(F.collect_list("protein").alias("sisters"))
    mine = wanted.join(small(alone), "protein", "left_semi")
    return most_shared(mine.join(lists, "aminos").select("protein", "sisters"), pep_protein.schema["protein"])


def unique_shared_hist(report: DataFrame) -> DataFrame:
    """Proteins by classes (0, 1, 2-4, 5+) of unique against shared peptides."""
    def bucket(c: str) -> Column:
        return F.when(F.col(c) == 0, "0").when(F.col(c) == 1, "1").when(F.col(c) < 5, "2-4").otherwise("5+")

    names = ["0", "1", "2-4", "5+"]
    classed = report.select(bucket("unique_peptides").alias("unique_class"), bucket("shared_peptides").alias("shared_class"))
    table = classed.groupBy("unique_class").pivot("shared_class", names)
    return table.agg(F.count(F.lit(1))).na.fill(0, names)


def nsaf(psm: DataFrame, sequences: DataFrame) -> DataFrame:
    """(protein, spectra, nsaf); sequences: (protein, length)."""
    n = psm.groupBy("protein").agg(F.count("*").alias("spectra")).join(sequences, "protein")
    rate = n.withColumn("_r", F.col("spectra") / F.col("length"))
    total = rate.agg(F.sum("_r").alias("_t"))
    return rate.join(F.broadcast(total)).select("protein", "spectra", (F.col("_r") / F.col("_t")).alias("nsaf"))  # one row


def expression_class(quant: DataFrame, least: int = 2) -> DataFrame:
    """Genes whose class (-1, 0, 1 beyond a third of a deviation from the sample's mean) differs by `least` between samples."""
    stats = quant.groupBy("sample").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    c = F.when(F.col("value") > F.col("m") + F.col("s") / 3, 1).when(F.col("value") < F.col("m") - F.col("s") / 3, -1).otherwise(0)
    classed = quant.join(stats, "sample").withColumn("class", c)
    return classed.groupBy("gene").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("samples")).where(F.col("high") - F.col("low") >= least)


def quant_summary(q: DataFrame, keys: list[str]) -> DataFrame:
    """A15."""
    return q.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.avg("ratio").alias("mean"), F.median("ratio").alias("median"))


def join_abundance(summary: DataFrame, absolute: DataFrame, key: str) -> DataFrame:
    """Ratios with the absolute abundance (key, amount) of their protein; fold_amount is amount times mean ratio."""
    return summary.join(absolute, key, "left").withColumn("fold_amount", F.col("amount") * F.col("mean"))


def compare_groups(psm: DataFrame, groups: list[str], least: int = 2) -> DataFrame:
    """Proteins with at least `least` peptides in some group: peptides and spectra per group."""
    n = psm.groupBy("protein", "group").agg(F.count_distinct("aminos").alias("peptides"), F.count("*").alias("spectra"))
    keep = n.groupBy("protein").agg(F.max("peptides").alias("m")).where(F.col("m") >= least)
    return n.join(keep, "protein", "left_semi").groupBy("protein").pivot("group", groups).agg(F.max("peptides").alias("peptides"), F.max("spectra").alias("spectra")).na.fill(0)


def compare_modified(psm: DataFrame, groups: list[str], least: int = 2) -> DataFrame:
    """Modified sites (protein, db_pos) with at least `least` modified spectra in all: per group the modified
    spectra and all spectra over the place."""
    n = psm.groupBy("protein", "db_pos", "group").agg(F.count_if("is_modified").alias("modified"), F.count("*").alias("total"))
    keep = n.groupBy("protein", "db_pos").agg(F.sum("modified").alias("m")).where(F.col("m") >= least)
    return n.join(keep, ["protein", "db_pos"], "left_semi").groupBy("protein", "db_pos").pivot("group", groups).agg(F.max("modified").alias("modified"), F.max("total").alias("total")).na.fill(0)


def list_peptides(psm: DataFrame, groups: list[str]) -> DataFrame:
    """Spectra per peptide and group; a file belongs to each group whose name it contains."""
    match = F.filter(F.array(*[F.lit(g) for g in groups]), lambda g: F.col("spectrum_file").contains(g))
    return psm.withColumn("group", F.explode(match)).groupBy("group", "aminos").agg(F.count("*").alias("spectra"))


def merge_listed(listed: DataFrame, stripped: DataFrame) -> DataFrame:
    """A24 after X6: peptides whose modification is needless (aminos, new_aminos) count under the longer peptide."""
    new = stripped.where("new_aminos is not null").groupBy("aminos").agg(F.min("new_aminos").alias("new_aminos"))
    merged = listed.join(new, "aminos", "left").withColumn("aminos", F.coalesce("new_aminos", "aminos"))
    return merged.groupBy("group", "aminos").agg(F.sum("spectra").alias("spectra"))


def modified_overlap(psm: DataFrame) -> DataFrame:
    """One row: peptides seen modified, unmodified, and both."""
    by = psm.groupBy("aminos").agg(F.max("is_modified").alias("m"), F.min("is_modified").alias("u"))
    return by.agg(F.count_if("m").alias("modified"), F.count_if(~F.col("u")).alias("unmodified"), F.count_if(F.col("m") & ~F.col("u")).alias("both"))


def nonredundant(psm: DataFrame) -> DataFrame:
    """Per peptide its best row; peptides of several proteins are flagged."""
    w = Window.partitionBy("aminos").orderBy(F.desc("mq_score"), "spectrum_file", "scan", "rank")
    n = psm.groupBy("aminos").agg((F.count_distinct("protein") > 1).alias("several"))
    best = psm.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("aminos", "spectrum_file", "scan", "mq_score")
    return best.join(n, "aminos")


def localized_sites(psm: DataFrame, certain: float = 13.0) -> DataFrame:
    """(protein, db_pos, peptides, best, certain): modified places by their best localisation score."""
    by = psm.where("is_modified").groupBy("protein", "db_pos").agg(F.count_distinct("aminos").alias("peptides"), F.max("localization").alias("best"))
    return by.withColumn("certain", F.coalesce(F.col("best") >= certain, F.lit(False)))


def gel_spots(psm: DataFrame, contaminants: list | None = None, top: int = 3, least: int = 2) -> DataFrame:
    """(spot, place, protein, spectra, total, contaminating): the `top` proteins of each spot by spectra, with the
    spot's spectra and those of contaminants, which take no place, nor do proteins of fewer than `least` spectra. A
    number of spectra names one protein, of several the last by name."""
    n = psm.groupBy("spot", "protein").agg(F.count("*").alias("spectra")).withColumn("bad", F.col("protein").isin(contaminants or []))
    whole = n.groupBy("spot").agg(F.sum("spectra").alias("total"), F.sum(F.when(F.col("bad"), F.col("spectra")).otherwise(0)).alias("contaminating"))
    named = n.where(~F.col("bad") & (F.col("spectra") >= least)).groupBy("spot", "spectra").agg(F.max("protein").alias("protein"))
    place = F.row_number().over(Window.partitionBy("spot").orderBy(F.desc("spectra")))
    return named.withColumn("place", place).where(F.col("place") <= top).join(whole, "spot").select("spot", "place", "protein", "spectra", "total", "contaminating")


def passing_proteins(psm: DataFrame, contaminants: list | None = None, least: int = 2) -> DataFrame:
    """Psm counted as (gel, spot, protein, spectra) without contaminants and proteins of fewer spectra."""
    n = psm.groupBy("gel", "spot", "protein").agg(F.count("*").alias("spectra"))
    return n.where(~F.col("protein").isin(contaminants or []) & (F.col("spectra") >= least))


def gel_pairs(passing: DataFrame, least: int = 3) -> DataFrame:
    """(major, minor, gels, spots): the major protein of a spot with every other one that passes there (see
    `passing_proteins`), on at least `least` gels. The major one has most spectra (ties: the lesser name)."""
    best = passing.groupBy("gel", "spot").agg(F.min(F.struct((-F.col("spectra")).alias("n"), F.col("protein"))).alias("b")).select("gel", "spot", F.col("b.protein").alias("major"))
    pairs = passing.join(best, ["gel", "spot"]).where("protein <> major")
    return pairs.groupBy("major", F.col("protein").alias("minor")).agg(F.count_distinct("gel").alias("gels"), F.count("*").alias("spots")).where(F.col("gels") >= least)


def spot_coverage(psm: DataFrame, spots: int = 2) -> DataFrame:
    """For proteins in at least `spots` spots the covered stretches in each spot: (protein, spot, first, last,
    covered), first and last residue seen and residues covered."""
    many = psm.groupBy("protein").agg(F.count_distinct("spot").alias("n")).where(F.col("n") >= spots)
    rows = psm.join(small(many.select("protein")), "protein", "left_semi").select("protein", "spot", "start", "stop")
    runs = ranges.coverage_of(rows, ["protein", "spot"], "start", "stop")
    return runs.groupBy("protein", "spot").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.sum(F.col("stop") - F.col("start") + 1).alias("covered"))


def pair_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs (major, minor) with their weights (protein, weight) and the major's less the minor's."""
    w = lambda c: weights.select(F.col("protein").alias(c), F.col("weight").alias(f"{c}_weight"))
    return pairs.join(w("major"), "major", "left").join(w("minor"), "minor", "left").withColumn("difference", F.col("major_weight") - F.col("minor_weight"))


def sticky_proteins(spots: DataFrame, contaminants: list | None = None, least: int = 2) -> DataFrame:
    """(spot, protein) with `least` spectra in this spot and in the one picked before it, contaminants left out.

    spots: (spot, protein, spectra); spots are picked in the order of their names, and one without a passing protein is
    still the one before the next. Spots are dealt by ranges to find their successors.
    """
    good = spots.where(~F.col("protein").isin(contaminants or []) & (F.col("spectra") >= least)).select("spot", "protein")
    order = ranges.following(ranges.placed(spots.select("spot").distinct(), [], ["spot"]), [], "spot", "next").where("next is not null")
    carried = good.join(order.select("spot", "next"), "spot").select(F.col("next").alias("spot"), "protein")
    return good.join(carried, ["spot", "protein"], "left_semi")


def best_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 3) -> DataFrame:
    """O3: the first n rows of each key in the given order, numbered by n."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= n)


def report_order(report: DataFrame, protein: str = "protein") -> DataFrame:
    """A report by falling numbers of peptides and spectra, then by name: a range sort on Spark."""
    return report.orderBy(F.desc("peptides"), F.desc("spectra"), protein)


def union_all(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, matched by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def peptide_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aminos, in_a, in_b): the distinct peptides of two results and where they are."""
    both = a.select("aminos").distinct().withColumn("in_a", F.lit(True)).join(b.select("aminos").distinct().withColumn("in_b", F.lit(True)), "aminos", "full_outer")
    return both.na.fill(False, ["in_a", "in_b"])


def annotate(psm: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a lookup table; Spark broadcasts it where its size allows."""
    return psm.join(table, key, "left")


def peptide_gaps(located: DataFrame) -> DataFrame:
    """Gap of each peptide to the one before in its ORF; overlapping peptides have 0."""
    w = Window.partitionBy("orf_name").orderBy("start", "stop", "aminos")
    gap = F.greatest(F.col("start") - F.lag("stop").over(w), F.lit(0))
    return located.withColumn("gap", gap)


def gap_summary(gaps: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(orf_name, largest) per protein, and the histogram (bin, n) of all gaps."""
    largest = gaps.where("gap is not null").groupBy("orf_name").agg(F.max("gap").alias("largest"))
    return largest, gaps.where("gap is not null").groupBy(F.floor(F.col("gap") / width).alias("bin")).agg(F.count("*").alias("n"))


def ranked_hits(psm: DataFrame) -> DataFrame:
    """(spectrum_file, scan, place, aminos, protein, p_value) of the hits with a score of 0 or more, each peptide once
    a spectrum, where it comes first; place counts from 1."""
    good = psm.where("mq_score >= 0").groupBy("spectrum_file", "scan", "aminos").agg(F.min(F.struct("rank", "protein", "p_value")).alias("h"))
    w = Window.partitionBy("spectrum_file", "scan").orderBy("h.rank", "aminos")
    return good.select("spectrum_file", "scan", F.row_number().over(w).alias("place"), "aminos", "h.protein", "h.p_value", "h.rank")


def candidate_summary(psm: DataFrame, floor: float = 1e-5) -> DataFrame:
    """(aminos, protein, top_hits, runners_up, best_p, score) per peptide: protein of its first hit, the spectra in
    which it comes first and those in which it does not, the best p-value of the first (1 without any), and the sum over
    these, i from 1, of -ln(best p) / i, the best p (at least `floor`) standing in every term."""
    top = F.col("place") == 1
    by = ranked_hits(psm).groupBy("aminos").agg(
        F.min(F.struct("spectrum_file", "scan", "rank", "protein")).alias("first"), F.count_if(top).alias("top_hits"), F.count_if(~top).alias("runners_up"), F.min(F.when(top, F.col("p_value"))).alias("p")
    )
    best = F.least(F.coalesce("p", F.lit(1.0)), F.lit(1.0))
    # the harmonic number: exact up to 64, beyond that by its series, whose next term is below 1e-14
    n = F.col("top_hits").cast("double")
    series = F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n, F.lit(4)))
    exact = F.aggregate(F.sequence(F.lit(1), F.least(F.col("top_hits"), F.lit(64)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)
    terms = F.when(F.col("top_hits") == 0, 0.0).when(F.col("top_hits") <= 64, exact).otherwise(series)
    return by.select("aminos", F.col("first.protein").alias("protein"), "top_hits", "runners_up", best.alias("best_p"), (-F.log(F.greatest(best, F.lit(floor))) * terms).alias("score"))


def runner_up_chains(psm: DataFrame) -> DataFrame:
    """(spectrum_file, scan, place, aminos, better, worse): each hit of a spectrum with the spectrum's first peptide
    (null for itself) and the next one down (null for the last)."""
    w = Window.partitionBy("spectrum_file", "scan").orderBy("place")
    rows = ranked_hits(psm)
    better = F.when(F.col("place") > 1, F.first("aminos").over(w))
    return rows.select("spectrum_file", "scan", "place", "aminos", better.alias("better"), F.lead("aminos").over(w).alias("worse"))


def half_overlap(a: str, b: str, reach: int = 20) -> bool:
    """Whether the second or the first half of a stands in b (at its first place) and fits on from the half point,
    back or forth, up to the end of either; a fit that `reach` residues do not decide is none."""
    half = len(a) // 2
    at = b.find(a[half:])
    back = min(half, at) + 1  # residues at and before the half point
    if at >= 0 and back < reach and a[half - back + 1 : half + 1] == b[at - back + 1 : at + 1]:
        return True
    to = b.find(a[:half])
    on = min(len(a) - half, len(b) - to - half)
    return to >= 0 and on < reach and a[half : half + on] == b[to + half : to + half + on]


def crowned(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(protein, aminos, king_score, king) within each pair of parts of a task (see `kings`)."""
    def of_parts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "aminos"])
        names, held, rows = group["aminos"].tolist(), {}, []
        for place in np.flatnonzero(group["holds"]):
            b = names[place]
            for gram in {b[i : i + size] for size in range(1, k + 1) for i in range(len(b) - size + 1)}:
                held.setdefault(gram, []).append(place)
        for place in np.flatnonzero(group["asks"]):
            a = names[place]
            # a single letter's first half is empty, and says no more than its second
            grams = {a[len(a) // 2 :][:k], a[: len(a) // 2][:k]} - {""}
            lists = [(above, bisect.bisect_right(above, place)) for above in (held.get(g, []) for g in grams)]
            found = [next((x for x in itertools.islice(above, first, None) if half_overlap(a, names[x])), len(names)) for above, first in lists]
            rows.append((place, min(found)))
        own, king = np.array([r for r in rows if r[1] < len(names)], dtype=np.int64).reshape(-1, 2).T
        crowns = group.iloc[king]
        return group.iloc[own][["protein", "aminos"]].assign(king_score=crowns["score"].to_numpy(), king=crowns["aminos"].to_numpy())

    def of_task(task: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([of_parts(g) for _, g in task.groupby(["protein", "i", "j"], sort=False)], ignore_index=True)

    return of_task


def kings(candidates: DataFrame, least: float = 0.0, k: int = 3, part_rows: int = 20_000) -> DataFrame:
    """(protein, aminos, king) of candidates (protein, aminos, score) above `least`: the candidate of the same
    protein with the least score above its own (ties: by name) that it overlaps by half; candidates without one are
    left out.

    Proteins are dealt over tasks; one of more than `part_rows` candidates comes apart, and its parts meet two by two. In a
    task a half is compared with the candidates that hold its first letters (`k`, or all of a shorter half), from its
    own score on until one fits.
    """
    rows = candidates.where((F.col("score") > least) & (F.length("aminos") > 0) & F.col("protein").isNotNull()).select("protein", "aminos", "score").distinct()
    rows = stored(rows)
    sizes = rows.groupBy("protein").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    tasks = max(rows.count() // part_rows, rows.sparkSession.sparkContext.defaultParallelism)
    apart = rows.join(sizes, "protein").withColumn("_part", F.pmod(F.xxhash64("aminos"), F.col("_parts")).cast("int"))
    meets = lambda x: F.struct(F.col("_part").alias("i"), x.alias("j"), F.lit(True).alias("asks"), (x == F.col("_part")).alias("holds"))
    waits = lambda x: F.struct(x.alias("i"), F.col("_part").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("holds"))
    others = F.sequence(F.lit(0), F.col("_parts") - 1)
    roles = F.concat(F.transform(others, meets), F.transform(F.filter(others, lambda x: x != F.col("_part")), waits))
    dealt = apart.select("protein", "aminos", "score", F.explode(roles).alias("r")).select("protein", "aminos", "score", "r.*")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("protein", "i", "j"), F.lit(tasks)))
    kinds = dict(rows.dtypes)
    found = dealt.groupBy("task").applyInPandas(crowned(k), f"protein {kinds['protein']}, aminos string, king_score {kinds['score']}, king string")
    return found.groupBy("protein", "aminos").agg(F.min(F.struct("king_score", "king")).alias("b")).select("protein", "aminos", F.col("b.king").alias("king"))


def merge_half_overlaps(candidates: DataFrame, share: float = 0.5) -> DataFrame:
    """(region, chrom, start, stop, n): candidates (chrom, name, start, stop) that overlap one before them by at
    least `share` of the shorter one are one region; the region's name is its first candidate's number.

    One before, b, begins no later, so it shares min(stops) - start + 1 with this one: enough of this one if b's stop
    is far enough, enough of b if b without the last share of it reaches this start. Both ask for the largest so far, so
    no pairs are made.
    """
    order = ["start", "stop", "name"]
    sound = F.col("chrom").isNotNull() & (F.col("start") <= F.col("stop"))
    length = F.col("stop") - F.col("start") + 1
    rows = candidates.withColumn("_far", F.when(sound, F.col("stop")))
    rows = rows.withColumn("_reach", F.least("_far", F.col("_far") + 1 - F.ceil(share * length)))
    dealt = ranges.carried(ranges.placed(rows, ["chrom"], order), ["chrom"], _far_before=(F.max("_far"), F.max), _reach_before=(F.max("_reach"), F.max))
    before = ranges.inside(["chrom"], order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.greatest(F.max(c).over(before), F.col(f"{c}_before"))
    of_own = (so_far("_far") >= F.col("start")) & (F.least(so_far("_far"), F.col("stop")) - F.col("start") + 1 >= share * length)
    joins = F.lit(share <= 1) & sound & (of_own | (so_far("_reach") >= F.col("start")))
    heads = ranges.stored(dealt.withColumn("head", F.when(joins, 0).otherwise(1)).select("chrom", *order, "head", "_p"))
    heads = ranges.carried(heads, ["chrom"], _heads=(F.sum("head"), F.sum))
    region = F.sum("head").over(ranges.inside(["chrom"], order).rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_heads", F.lit(0))
    return heads.withColumn("region", region).groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))
