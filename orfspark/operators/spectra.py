"""Peaks and spectra: ranks, windows, consensus, similarity, search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import expr as X
from . import ranges


def rank_peaks(peaks: DataFrame) -> DataFrame:
    """W7."""
    return peaks.withColumn("intensity_rank", F.row_number().over(Window.partitionBy("spectrum").orderBy(F.desc("intensity"), "mz")))


def window_filter(peaks: DataFrame, width: float = 50.0, k: int = 6) -> DataFrame:
    """Peaks among the k most intense within width / 2 on either side."""
    half = width / 2
    o = peaks.select("spectrum", F.col("mz").alias("_m"), F.col("intensity").alias("_i"))
    met = ranges.tolerance_join(peaks, o, ["spectrum"], "mz", "_m", half)
    rank = met.groupBy("spectrum", "mz", "intensity").agg(F.count_if((F.col("_i") > F.col("intensity")) | ((F.col("_i") == F.col("intensity")) & (F.col("_m") < F.col("mz")))).alias("stronger"))
    return rank.where(F.col("stronger") < k).select("spectrum", "mz", "intensity")


def spectrum_quality(peaks: DataFrame, least: int = 10) -> DataFrame:
    """(spectrum, peaks, signal_to_noise, good). Signal is the third strongest of five peaks or more, of fewer the
    one at half their number from the top (rounded up); noise is the median, the upper one of two; null without noise."""
    by = peaks.groupBy("spectrum").agg(F.count("*").alias("peaks"), F.sort_array(F.collect_list("intensity"), False).alias("i"))
    n = F.size("i")
    signal = F.get("i", F.ceil(F.least(n, F.lit(5)) / 2).cast("int") - 1)
    noise = F.get("i", n - 1 - F.floor(n / 2).cast("int"))
    return by.select("spectrum", "peaks", F.try_divide(signal, noise).alias("signal_to_noise"), (F.col("peaks") > least).alias("good"))


def most_intense(peaks: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The spectra of each charge in the upper part by total intensity."""
    total = peaks.groupBy("spectrum", "charge").agg(F.sum("intensity").alias("total"))
    w = Window.partitionBy("charge").orderBy(F.desc("total"), "spectrum")
    return total.withColumn("place", F.percent_rank().over(w)).where(F.col("place") < fraction).select("spectrum", "charge", "total")


def pair_scans(scans: DataFrame, mass_tol: float | None = None) -> DataFrame:
    """Partner scan of each level-2 scan: inside a run of level-2 scans odd members pair with the next, others stand
    alone. With mass_tol both need the same parent_mass within it, or each stands alone."""
    w = Window.partitionBy("spectrum_file").orderBy("scan")
    runs = scans.withColumn("_run", F.sum((F.col("ms_level") != 2).cast("int")).over(w)).where("ms_level = 2")
    r = Window.partitionBy("spectrum_file", "_run").orderBy("scan")
    other = lambda c: F.when(F.row_number().over(r) % 2 == 1, F.lead(c).over(r)).otherwise(F.lag(c).over(r))
    partner = other("scan")
    if mass_tol is not None:
        partner = F.when(F.abs(other("parent_mass") - F.col("parent_mass")) <= mass_tol, partner)
    return runs.select("spectrum_file", "scan", F.coalesce(partner, F.col("scan")).alias("partner"))


def count_scans(peaks: DataFrame, least: int = 10) -> DataFrame:
    """Per file, and for all files, the scans with more than `least` peaks and the largest scan."""
    good = peaks.groupBy("spectrum_file", "scan").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return good.rollup("spectrum_file").agg(F.count("*").alias("scans"), F.max("scan").alias("max_scan"))


def binned(peaks: DataFrame, width: float = 1.0) -> DataFrame:
    return peaks.groupBy("spectrum", F.floor(F.col("mz") / width).alias("bin")).agg(F.sum("intensity").alias("v"))


def similarity(peaks: DataFrame, pairs: DataFrame, method: str = "dot", width: float = 1.0) -> DataFrame:
    """(a, b, score) of stated pairs: dot (cosine of binned intensities), shared (peaks in common bins over the
    smaller count), noise (dot of intensities above each spectrum's mean)."""
    v = binned(peaks, width)
    if method == "noise":
        mean = v.groupBy("spectrum").agg(F.avg("v").alias("_m"))
        v = v.join(mean, "spectrum").select("spectrum", "bin", F.greatest(F.col("v") - F.col("_m"), F.lit(0.0)).alias("v"))
    norm = v.groupBy("spectrum").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.count("*").alias("n"))
    x = pairs.join(v.select(F.col("spectrum").alias("a"), "bin", F.col("v").alias("va")), "a").join(v.select(F.col("spectrum").alias("b"), "bin", F.col("v").alias("vb")), ["b", "bin"])
    both = x.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.count("*").alias("common"))
    full = pairs.join(both, ["a", "b"], "left").join(norm.select(F.col("spectrum").alias("a"), F.col("norm").alias("na"), F.col("n").alias("ca")), "a").join(norm.select(F.col("spectrum").alias("b"), F.col("norm").alias("nb"), F.col("n").alias("cb")), "b")
    score = F.coalesce("common", F.lit(0)) / F.least("ca", "cb") if method == "shared" else F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))
    return full.select("a", "b", score.alias("score"))


def correlation(peaks: DataFrame, pairs: DataFrame, width: float = 1.0) -> DataFrame:
    """(a, b, score): correlation of two spectra's binned intensities over all bins between the ends of both, from
    sums; empty bins count as zero. Null where one of them has no spread."""
    v = peaks.groupBy("spectrum", F.round(F.col("mz") / width).cast("long").alias("bin")).agg(F.sum("intensity").alias("v"))
    own = v.groupBy("spectrum").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    side = lambda c: own.select(F.col("spectrum").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("s", "q", "lo", "hi")])
    x = pairs.join(v.select(F.col("spectrum").alias("a"), "bin", F.col("v").alias("va")), "a").join(v.select(F.col("spectrum").alias("b"), "bin", F.col("v").alias("vb")), ["b", "bin"])
    dot = x.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    full = pairs.join(dot, ["a", "b"], "left").join(side("a"), "a").join(side("b"), "b")
    n = F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo") + 1
    cov = F.coalesce("dot", F.lit(0.0)) - F.col("a_s") * F.col("b_s") / n
    spread = (F.col("a_q") - F.col("a_s") * F.col("a_s") / n) * (F.col("b_q") - F.col("b_s") * F.col("b_s") / n)
    return full.select("a", "b", F.when(spread > 0, cov / F.sqrt(spread)).alias("score"))


def shifted_peaks(peaks: DataFrame, mods: DataFrame, tol: float = 0.5) -> DataFrame:
    """Peaks as if a spectrum's peptide were unmodified: those at b, y or a ions (or their losses) that carry the
    modification move down by its mass, so a modified and a bare spectrum can be compared.

    mods: (spectrum, aminos, mod_pos from 0, mod_mass); spectra without one stay as they are. Ions are made once for each
    different peptide, and meet a spectrum's peaks as one row.
    """
    species = ranges.spread(mods.select("aminos", "mod_pos", "mod_mass").distinct())
    ions = X.fragment_ions(F.col("aminos"), F.array(F.struct(F.col("mod_pos").alias("pos"), F.col("mod_mass").alias("mass"))))

    def carries(i: Column) -> Column:
        prefix = i["series"].startswith("b") | i["series"].startswith("a")
        return F.when(prefix, i["n"] > F.col("mod_pos")).otherwise(F.length("aminos") - i["n"] <= F.col("mod_pos"))

    species = ranges.stored(species.withColumn("ions", F.transform(F.filter(ions, carries), lambda i: i["mz"])))
    lists = ranges.stored(peak_lists(peaks))
    known = mods.select("spectrum", "aminos", "mod_pos", "mod_mass").distinct().join(lists.select("spectrum"), "spectrum", "left_semi")
    met = known.join(ranges.small(species, 100_000), ["aminos", "mod_pos", "mod_mass"]).select("spectrum", "mod_mass", "ions").join(lists, "spectrum")
    near = met.select("spectrum", "mod_mass", F.explode(peaks_met(tol)("ions", "mzs")).alias("mz")).groupBy("spectrum", "mz").agg(F.max("mod_mass").alias("shift"))
    return peaks.join(near, ["spectrum", "mz"], "left").withColumn("mz", F.col("mz") - F.coalesce("shift", F.lit(0.0))).drop("shift")


def consensus_bins(peaks: DataFrame, width: float = 0.1) -> DataFrame:
    """A27, mergeable part: (key, bin, intensity, spectra, near) of intensities scaled to each spectrum's sum; near: the
    peaks of the bin and of two bins on either side, all summed over the key's spectra."""
    total = Window.partitionBy("key", "spectrum")
    scaled = peaks.withColumn("_s", F.col("intensity") / F.sum("intensity").over(total)).withColumn("bin", F.round(F.col("mz") / width).cast("long"))
    own = scaled.groupBy("key", "bin").agg(F.sum("_s").alias("intensity"), F.count_distinct("spectrum").alias("spectra"), F.count("*").alias("_peaks"))
    spread = own.select("key", F.explode(F.array(*[F.col("bin") + k for k in range(-2, 3)])).alias("bin"), "_peaks").groupBy("key", "bin").agg(F.sum("_peaks").alias("near"))
    return own.join(spread, ["key", "bin"]).select("key", "bin", "intensity", "spectra", "near")


def consensus(bins: DataFrame, reach: int = 3, width: float = 0.1, sizes: DataFrame | None = None) -> DataFrame:
    """Greedy step per key: the strongest bin absorbs its neighbours within `reach`, and so on; a key is one peptide,
    whose bins are as many as its mass range has. With sizes (key, size: spectra of the key) the peaks of keys of more
    than four spectra are scaled by the share of spectra with a peak near by."""

    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {int(b): (v, n, k) for b, v, n, k in zip(pdf["bin"], pdf["intensity"], pdf["spectra"], pdf["near"], strict=True)}
        rows = []
        for b in sorted(left, key=lambda b: (-left[b][0], b)):
            if b not in left:
                continue
            own = [x for x in range(b - reach, b + reach + 1) if x in left]
            v, n, near = sum(left[x][0] for x in own), max(left[x][1] for x in own), left[b][2]
            for x in own:
                del left[x]
            rows.append((pdf["key"].iloc[0], b * width, float(v), int(n), int(near)))
        return pd.DataFrame(rows, columns=["key", "mz", "intensity", "spectra", "near"])

    kind = dict(bins.dtypes)["key"]
    out = bins.groupBy("key").applyInPandas(absorb, f"key {kind}, mz double, intensity double, spectra long, near long")
    if sizes is not None:
        presence = F.when(F.col("size") > 4, F.least(F.col("near") / F.col("size"), F.lit(1.0))).otherwise(1.0)
        out = out.join(sizes, "key").withColumn("intensity", F.col("intensity") * presence).drop("size")
    return out.drop("near")


def linked_pairs(want: DataFrame, peptides: DataFrame, top: int) -> DataFrame:
    """(target, a, b, least) of the `top` peptide pairs, a <= b, within 1 Da of each target mass; least is the smaller
    abundance.

    Whole daltons meet first: a target's bin and a first peptide's bin leave four bins for the second.
    """
    bins = peptides.select("id", "mass", "abundance", F.floor("mass").alias("bin"))
    firsts = bins.select(F.col("bin").alias("i")).distinct()
    # a target's first peptide weighs less than the target: daltons of the mass range, as a range of bins and not a product
    lightest = firsts.agg(F.min("i").alias("least"))
    combos = want.select("t").distinct().join(F.broadcast(lightest)).where("t >= least").select("t", F.explode(F.sequence("least", "t")).alias("i")).join(firsts, "i", "left_semi")  # one row
    combos = combos.select("t", "i", F.explode(F.sequence(F.col("t") - F.col("i") - 2, F.col("t") - F.col("i") + 1)).alias("j")).join(bins.select(F.col("bin").alias("j")).distinct(), "j", "left_semi")
    first = bins.select(F.col("id").alias("a"), F.col("mass").alias("am"), F.col("abundance").alias("aa"), F.col("bin").alias("i"))
    second = bins.select(F.col("id").alias("b"), F.col("mass").alias("bm"), F.col("abundance").alias("ba"), F.col("bin").alias("j"))
    met = combos.join(want, "t").join(first, "i").join(second, "j").where((F.abs(F.col("am") + F.col("bm") - F.col("target")) <= 1) & (F.col("a") <= F.col("b")))
    # equal rows share a place, so that tasks drop what is beyond it before rows are told apart
    place = F.dense_rank().over(Window.partitionBy("target").orderBy(F.desc("least"), "a", "b"))
    return met.select("target", "a", "b", F.least("aa", "ba").alias("least")).withColumn("_n", place).where(F.col("_n") <= top).drop("_n").distinct()


def crosslink_candidates(peptides: DataFrame, spectra: DataFrame, linker: float, top: int = 5, shares: tuple = (1 / 4096, 1 / 1024, 1 / 256, 1 / 64, 1 / 16, 1 / 4)) -> DataFrame:
    """(scan, a, b, least, place) of peptide pairs whose masses and the linker meet the precursor within 1 Da at charge
    2 or 3; the `top` per scan by the smaller abundance (ties: a, b). Peptides: id, mass, abundance; spectra: scan, mz.

    Pairs are sought for each different target mass, and scans take the best of their two targets'. A pair of two
    peptides above some abundance comes before any other, so pairs are sought among the most abundant 4096th of the
    peptides first, then among four times as many, up to all: a target with `top` pairs leaves, and only targets that are
    still short meet more peptides. Where the cuts lie is of no matter for the result.
    """
    charged = spectra.select("scan", F.explode(F.array(F.lit(2), F.lit(3))).alias("z"), "mz")
    asked = ranges.stored(charged.select("scan", (X.parent_mass(F.col("mz"), F.col("z")) - linker).alias("target")).distinct())
    want = ranges.stored(asked.select("target").distinct().withColumn("t", F.floor("target")))
    cuts = peptides.agg(F.percentile_approx("abundance", F.array(*[F.lit(1 - x) for x in shares])).alias("c")).first().c or []
    out = None
    for cut in [*sorted(set(cuts), reverse=True), None]:
        some = peptides if cut is None else peptides.where(F.col("abundance") >= cut)
        found = ranges.stored(linked_pairs(want, some, top))
        done = found.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("target")
        full = found if cut is None else found.join(done, "target", "left_semi")
        out = full if out is None else out.unionByName(full)
        if cut is not None:
            want = ranges.stored(want.join(done, "target", "left_anti"))
    rows = asked.join(out, "target").select("scan", "a", "b", "least").distinct()
    w = Window.partitionBy("scan").orderBy(F.desc("least"), "a", "b")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def peak_lists(peaks: DataFrame) -> DataFrame:
    """(spectrum, mzs): each spectrum's distinct peaks in one row."""
    return peaks.groupBy("spectrum").agg(F.sort_array(F.collect_set("mz")).alias("mzs"))


def have_peak(ions: np.ndarray, mzs: np.ndarray, tol: float) -> np.ndarray:
    """Of each ion whether one of the peaks (rising) is within tol."""
    at = np.searchsorted(mzs, ions)
    return (np.abs(mzs[np.minimum(at, len(mzs) - 1)] - ions) <= tol) | (np.abs(mzs[np.maximum(at - 1, 0)] - ions) <= tol)


def ions_met(tol: float) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """How many of a row's ions have one of its peaks within tol; none of null."""
    def count(ions: pd.Series, mzs: pd.Series) -> pd.Series:
        both = zip(ions, mzs, strict=True)
        return pd.Series([0 if i is None or m is None or not len(i) or not len(m) else int(have_peak(i, m, tol).sum()) for i, m in both], dtype="int64")

    return F.pandas_udf(count, "long")


def peaks_met(tol: float) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A row's peaks that have one of its ions within tol."""
    def found(ions: pd.Series, mzs: pd.Series) -> pd.Series:
        return pd.Series([m[have_peak(m, np.sort(i), tol)] if len(i) and len(m) else m[:0] for i, m in zip(ions, mzs, strict=True)])

    return F.pandas_udf(found, "array<double>")


def main_ions_of(peptides: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mz, peptide's number) of the b and y ions of all peptides, summed residue by residue as in `X.main_ions`."""
    mass = np.zeros(128)
    for letter, m in X.RESIDUE_MASS.items():
        mass[ord(letter)] = m
    mzs, owner = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
    size = np.array([len(p) for p in peptides], dtype=np.int64)
    for n in np.unique(size[size > 1]):
        own = np.flatnonzero(size == n)
        letters = np.frombuffer("".join(peptides[i] for i in own).encode("utf-32-le"), dtype="<u4").reshape(len(own), n)
        b = np.cumsum(np.where(letters < 128, mass[np.minimum(letters, 127)], 0.0), axis=1)
        y = b[:, -1:] - b[:, :-1]
        mzs += [(b[:, :-1] + X.PROTON).ravel(), (y + X.WATER + X.PROTON).ravel()]
        owner += [np.repeat(own, n - 1)] * 2
    return np.concatenate(mzs), np.concatenate(owner)


def best_in_part(tol: float, peak_tol: float, k: int, moved: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best peptides, and those alone, that some spectra have among some peptides: (lead, aminos, delta_mass, shared).

    Spectra: lead, masses and mzs, both rising; a peptide is compared under the least mass within `tol` of its own. Its ions
    that have a peak count, and with `moved` those that have one once both are less their peptide's and their spectrum's
    mass. All ions of the peptides are looked up at once.
    """
    def best(asked: pa.Table, peptides: pa.Table) -> pa.Table:
        out = []
        peptides = peptides.take(pc.sort_indices(peptides["aminos"]))  # of equal ones the first comes first
        p_mass = peptides["p_mass"].to_numpy()
        ions, owner = main_ions_of(peptides["aminos"].to_pylist())
        less = ions - p_mass[owner]
        known, bare = None, None
        for row, (masses, mzs) in enumerate(zip(asked["masses"].to_pylist(), asked["mzs"].combine_chunks(), strict=True)):
            mzs = mzs.values.to_numpy(zero_copy_only=False)
            if not len(mzs):
                continue
            mass = np.full(len(p_mass), np.nan)
            for m in reversed(masses):
                mass[np.abs(m - p_mass) <= tol] = m
            if known is None or not np.array_equal(known, mzs):  # spectra with the same peaks follow one another
                known, bare = mzs, have_peak(ions, mzs, peak_tol)
            met = bare
            if moved:
                met = bare.copy()
                for m in masses:
                    own = np.flatnonzero((mass[owner] == m) & ~bare)
                    met[own] = have_peak(less[own], mzs - m, peak_tol)
            shared = np.bincount(owner[met], minlength=len(p_mass))
            found = np.flatnonzero(~np.isnan(mass) & (shared > 0))
            delta = mass[found] - p_mass[found]
            keys = (np.abs(delta), -shared[found]) if moved else (-shared[found],)
            chosen = np.lexsort(keys)[:k]
            out.append((np.full(len(chosen), row), found[chosen], delta[chosen], shared[found[chosen]]))
        row, at, delta, shared = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 4
        return pa.table({"lead": asked["lead"].take(pa.array(row)), "aminos": peptides["aminos"].take(pa.array(at)), "delta_mass": pa.array(delta.astype(float)), "shared": pa.array(shared, pa.int64())})

    return best


def best_candidates(precursors: DataFrame, peaks: DataFrame, peptides: DataFrame, tol: float, peak_tol: float, k: int, moved: bool = False, most: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(lead, aminos, delta_mass, shared), in which stand each lead's k best, and (spectrum, lead): spectra with the same
    masses and peaks have the same candidates and follow one of them. The others meet the peptides of their mass window.

    Spectra and peptides meet in bins of mass, where up to `most` peptides and a quarter as many spectra are a part; a
    bin of more is dealt as all pairs of its parts. Pairs do not leave the part: its k best of each spectrum do.
    """
    width = tol if tol > 0 else 1.0
    masses = peptides.select("aminos").distinct().withColumn("p_mass", X.parent_mass_of(F.col("aminos"))).where("p_mass is not null")
    masses = ranges.stored(masses.withColumn("bin", F.floor(F.col("p_mass") / width)))
    own = precursors.groupBy("spectrum").agg(F.sort_array(F.collect_set("mass")).alias("masses")).join(peak_lists(peaks), "spectrum")
    own = ranges.stored(own.withColumn("lead", F.min("spectrum").over(Window.partitionBy("mzs", "masses"))))
    around = F.array_distinct(F.flatten(F.transform("masses", lambda m: F.sequence(F.floor(m / width) - 1, F.floor(m / width) + 1))))
    asked = own.where(F.col("spectrum") == F.col("lead")).select("lead", "masses", "mzs", F.explode(around).alias("bin"))
    parts = lambda df, n, name: df.groupBy("bin").agg(F.ceil(F.count("*") / n).alias(name))
    grid = ranges.small(ranges.stored(parts(masses, most, "p_parts").join(parts(asked, most // 4, "s_parts"), "bin")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(grid, "bin").withColumn("s", F.pmod(F.xxhash64("lead"), F.col("s_parts"))).withColumn("p", every("p_parts")).drop("s_parts", "p_parts")
    right = masses.join(grid, "bin").withColumn("p", F.pmod(F.xxhash64("aminos"), F.col("p_parts"))).withColumn("s", every("s_parts")).drop("s_parts", "p_parts")
    where = ["bin", "s", "p"]
    shape = StructType([StructField("lead", own.schema["lead"].dataType), StructField("aminos", StringType()), StructField("delta_mass", DoubleType()), StructField("shared", LongType())])
    met = ranges.spread(left, *where).groupBy(*where).cogroup(ranges.spread(right, *where).groupBy(*where)).applyInArrow(best_in_part(tol, peak_tol, k, moved), shape)
    return met, own.select("spectrum", "lead")


def search_spectra(precursors: DataFrame, peaks: DataFrame, peptides: DataFrame, tol: float = 2.5, peak_tol: float = 0.5, k: int = 3) -> DataFrame:
    """Candidates by parent mass, scored by shared b and y peaks: the k best (spectrum, aminos, shared, place).

    precursors: spectrum, mass; peaks: spectrum, mz, intensity; peptides: aminos. A pair is scored where it meets.
    """
    met, own = best_candidates(precursors, peaks, peptides, tol, peak_tol, k)
    w = Window.partitionBy("lead").orderBy(F.desc("shared"), "aminos")
    best = met.select("lead", "aminos", "shared", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
    return own.join(best, "lead").select("spectrum", "aminos", "shared", "place")


def open_search(precursors: DataFrame, peaks: DataFrame, peptides: DataFrame, widest: float = 200.0, peak_tol: float = 0.5, k: int = 3) -> DataFrame:
    """J21 with an open window: candidates whose mass differs by up to `widest`, the difference being one modification
    at any residue: (spectrum, aminos, delta_mass, shared, place). Peaks shared with the bare ions or with the same ions
    moved by the difference count; an ion counts once.

    Spectra meet the peptides of their mass window, and a pair is scored where it meets: postings of single ions, which met
    before the window filtered them, were many times as many.
    """
    met, own = best_candidates(precursors, peaks, peptides, widest, peak_tol, k, True)
    w = Window.partitionBy("lead").orderBy(F.desc("shared"), F.abs("delta_mass"), "aminos")
    best = met.select("lead", "aminos", "delta_mass", "shared", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
    return own.join(best, "lead").select("spectrum", "aminos", "delta_mass", "shared", "place")


def localize(psm: DataFrame, peaks: DataFrame, tol: float = 0.3) -> DataFrame:
    """P10: per (spectrum, aminos, n_sites 1 or 2) the best and second placement of phosphates and their score.

    A spectrum's peaks stand beside its peptides as one row; no ion is shuffled.
    """
    rows = ranges.spread(psm.select("spectrum", "aminos", "n_sites").distinct(), "spectrum").join(ranges.spread(peak_lists(peaks), "spectrum"), "spectrum", "left")
    sites = F.when(F.col("n_sites") == 1, X.alternate_sites(F.col("aminos"), 1)).otherwise(X.alternate_sites(F.col("aminos"), 2))
    alt = rows.select("spectrum", "aminos", "mzs", F.explode(sites).alias("sites"))
    mods = F.transform("sites", lambda p: F.struct(p.alias("pos"), F.lit(79.96633).alias("mass")))
    ions = alt.select("spectrum", "aminos", "sites", "mzs", F.transform(X.main_ions(F.col("aminos"), mods), lambda i: i["mz"]).alias("ions")).where("size(ions) > 0")
    n = ions.select("spectrum", "aminos", "sites", F.size("ions").cast("long").alias("n"), ions_met(tol)("ions", "mzs").alias("found"))
    w = Window.partitionBy("spectrum", "aminos").orderBy(F.desc("found"), "sites")
    best = n.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("found").over(w)).where("place = 1")
    return best.select("spectrum", "aminos", "sites", "found", X.localization_score(F.col("n").cast("int"), F.col("found").cast("int"), F.coalesce("second", F.lit(0)).cast("int")).alias("score"))


def offset_histogram(peaks: DataFrame, anchors: DataFrame, reach: float = 50, width: float = 1.0) -> DataFrame:
    """M9: (bin, n) of peak offsets from series anchors (spectrum, anchor) within reach."""
    met = ranges.tolerance_join(anchors, peaks.select("spectrum", "mz"), ["spectrum"], "anchor", "mz", reach)
    return met.groupBy(F.round((F.col("mz") - F.col("anchor")) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def pick_offsets(peaks: DataFrame, anchors: DataFrame, picks: int = 3, reach: float = 50, width: float = 1.0) -> DataFrame:
    """M9: the offsets that explain most, one after another: (place, bin, n, intensity).

    Each peak counts at its offsets to the nearest anchors below and above. The bin with the largest share of the
    unexplained peaks plus share of their intensity (a spectrum's intensities sum to one) is picked; peaks at an offset
    within two bins of it are explained and leave. A pick is one job whose result is one row.
    """
    total = peaks.groupBy("spectrum").agg(F.sum("intensity").alias("_t"))
    near = ranges.tolerance_join(anchors, peaks.select("spectrum", "mz", "intensity"), ["spectrum"], "anchor", "mz", reach)
    offset = F.col("mz") - F.col("anchor")
    below, above = F.min(F.when(offset > 0, offset)), F.max(F.when(offset < 0, offset))
    best = near.groupBy("spectrum", "mz", "intensity").agg(below.alias("lo"), above.alias("hi")).join(total, "spectrum")
    bins = F.array_distinct(F.filter(F.array(F.round(F.col("lo") / width).cast("long"), F.round(F.col("hi") / width).cast("long")), lambda b: b.isNotNull()))
    left = ranges.stored(best.select("spectrum", "mz", (F.col("intensity") / F.greatest("_t", F.lit(1e-4))).alias("v"), bins.alias("bins")).where("size(bins) > 0"))
    picked = None
    for place in range(1, picks + 1):
        all_ = left.agg(F.count("*").alias("_n"), F.sum("v").alias("_v"))
        spread = left.select("v", F.explode(F.array_distinct(F.flatten(F.transform("bins", lambda b: F.sequence(b - 2, b + 2))))).alias("bin"))
        score = F.col("n") / F.greatest("_n", F.lit(1)) + F.col("intensity") / F.greatest("_v", F.lit(1e-4))
        top = spread.groupBy("bin").agg(F.count("*").alias("n"), F.sum("v").alias("intensity")).join(F.broadcast(all_)).orderBy(F.desc(F.round(score, 9)), "bin").limit(1)  # one row
        top = ranges.stored(top.select(F.lit(place).alias("place"), "bin", "n", "intensity"))
        picked = top if picked is None else picked.unionByName(top)
        left = ranges.stored(left.join(F.broadcast(top.select("bin"))).where(~F.exists("bins", lambda b: F.abs(b - F.col("bin")) <= 2)).drop("bin"))
    return picked
