"""Column functions on peptides, proteins, DNA and coordinates.

All of them are built-in Spark expressions, so they stay inside code generation
or Spark's own higher-order functions; no Python runs per row.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses.
RESIDUE_MASS = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931}
#: Hydropathy index.
HYDROPATHY = {"I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "W": -0.9, "S": -0.8, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5}
#: Acid constants and the sign of the charge.
PKA = {"Nterm": (8.0, 1), "Cterm": (3.1, -1), "D": (4.4, -1), "R": (12.0, 1), "E": (4.4, -1), "H": (6.5, 1), "Y": (10.0, -1), "K": (9.8, 1), "C": (8.5, -1)}
#: Base frequencies around a splice junction, in the order A, C, G, T.
SPLICE = [(0.3501, 0.3420, 0.1873, 0.1207), (0.6085, 0.1094, 0.1220, 0.1601), (0.0956, 0.0381, 0.7933, 0.0730), (0.0028, 0.0010, 0.9949, 0.0014), (0.0028, 0.0124, 0.0012, 0.9836), (0.5512, 0.0304, 0.3846, 0.0338), (0.7011, 0.0764, 0.1142, 0.1084), (0.0787, 0.0545, 0.8026, 0.0642), (0.1570, 0.1569, 0.1926, 0.4935), (0.0560, 0.6400, 0.0094, 0.2947), (0.9937, 0.0011, 0.0013, 0.0039), (0.0011, 0.0014, 0.9943, 0.0032), (0.2453, 0.1438, 0.4948, 0.1160)]
#: The standard genetic code, codons in the order of BASES.
BASES, CODE = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in BASES for b in BASES for c in BASES]
WATER, PROTON = 18.010565, 1.0078


def literal_map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def letters(text: Column) -> Column:
    """Array of single characters; the empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def sum_of(text: Column, weight: dict[str, float], default: float = 0.0) -> Column:
    """Sum of the letters' weights: one pass of counting per distinct weight, no map lookups."""
    known = "".join(weight)
    by: dict[float, str] = {}
    for c, w in weight.items():
        by[w] = by.get(w, "") + c
    total = F.lit(0.0)
    for w, cs in by.items():
        total = total + F.lit(w) * (F.length(text) - F.length(F.translate(text, cs, "")))
    if default:
        total = total + F.lit(default) * F.length(F.translate(text, known, ""))
    return total


# --- annotations -------------------------------------------------------------------------------------------------


def parse_annotation(col: Column) -> Column:
    """``K.SEQ+16PEPT.R`` -> struct(prefix, aminos, suffix, mods array of (pos, name)).

    Flanks are read only from the form x.SEQ.y. A mod is whatever stands between
    two capital letters; pos counts residues from 0.
    """
    flanked = F.substr(col, F.lit(2), F.lit(1)).eqNullSafe(".") & F.substr(col, F.length(col) - 1, F.lit(1)).eqNullSafe(".") & (F.length(col) > 4)
    core = F.when(flanked, F.substr(col, F.lit(3), F.length(col) - 4)).otherwise(col)
    names = F.regexp_extract_all(core, F.lit("[A-Z]([^A-Z]*)"), F.lit(1))
    mods = F.filter(F.transform(names, lambda m, i: F.struct(i.alias("pos"), m.alias("name"))), lambda m: m["name"] != "")
    return F.struct(F.when(flanked, F.substr(col, F.lit(1), F.lit(1))).alias("prefix"), F.regexp_replace(core, "[^A-Z]", "").alias("aminos"), F.when(flanked, F.substr(col, F.length(col), F.lit(1))).alias("suffix"), mods.alias("mods"))


def format_annotation(p: Column) -> Column:
    """The inverse of parse_annotation."""
    mods = F.map_from_arrays(p["mods"]["pos"], p["mods"]["name"])
    core = F.array_join(F.transform(letters(p["aminos"]), lambda c, i: F.concat(c, F.coalesce(F.try_element_at(mods, i), F.lit("")))), "")
    return F.when(p["prefix"].isNotNull() & p["suffix"].isNotNull(), F.concat(p["prefix"], F.lit("."), core, F.lit("."), p["suffix"])).otherwise(core)


def ntt(p: Column) -> Column:
    """Number of tryptic ends (0..2); a sequence end counts, K or R before P does not."""
    first, last = F.substr(p["aminos"], F.lit(1), F.lit(1)), F.substr(p["aminos"], F.length(p["aminos"]), F.lit(1))
    ends = ("-", "*", "X")
    left = F.when(p["prefix"].isin(*ends) | (p["prefix"].isin("K", "R") & (first != "P")), 1).otherwise(0)
    right = F.when(p["suffix"].isin(*ends) | (last.isin("K", "R") & (p["suffix"] != "P")), 1).otherwise(0)
    return left + right


def fully_tryptic(p: Column) -> Column:
    """F10."""
    return ntt(p) == 2


def peptide_mass(aminos: Column, fixed: dict[str, float] | None = None) -> Column:
    """Sum of residue masses, with fixed modifications per residue."""
    return sum_of(aminos, {c: m + (fixed or {}).get(c, 0.0) for c, m in RESIDUE_MASS.items()})


def parent_mass_of(aminos: Column) -> Column:
    return peptide_mass(aminos) + 19


def canonical_il(aminos: Column) -> Column:
    """I reads as L, and Q as K."""
    return F.translate(aminos, "IQ", "LK")


def add_fixed_mod(annotation: Column, residue: str, mass: int) -> Column:
    """Put a fixed mass on each unmodified residue inside the peptide."""
    return F.regexp_replace(annotation, f"(?<!^){residue}(?![^A-Z.])(?!$)", f"{residue}{mass:+d}")


def drop_mods(p: Column, names: list[str]) -> Column:
    """The peptide without the named modifications (such as those of sample handling)."""
    return p.withField("mods", F.filter(p["mods"], lambda m: ~m["name"].isin(*names)))


# --- DNA ---------------------------------------------------------------------------------------------------------


def reverse_complement(dna: Column) -> Column:
    """X9."""
    return F.reverse(F.translate(dna, "ACGT", "TGCA"))


def translate_dna(dna: Column) -> Column:
    """Residues of whole codons; a codon that is not known reads as stop.

    Bases are written as digits, so a codon is a number that indexes an array.
    """
    at = {c: int(c.translate(str.maketrans("ACGT", "0123"))) for c in CODONS}
    table = ["*"] * 445
    for c, a in zip(CODONS, CODE, strict=True):
        table[at[c]] = a
    digits = F.translate(F.regexp_replace(dna, "[^ACGT]", "N"), "ACGTN", "01234")
    code = F.array(*[F.lit(a) for a in table])
    return F.array_join(F.transform(codons(digits), lambda c: F.get(code, c.cast("int"))), "")


def codons(dna: Column) -> Column:
    """Array of whole codons, in one pass over the text."""
    return F.regexp_extract_all(dna, F.lit("..."), F.lit(0))


def gc_percent(dna: Column) -> Column:
    """Share of G and C in percent, truncated."""
    return F.when(F.length(dna) > 0, F.floor(100 * (F.length(dna) - F.length(F.translate(dna, "GC", ""))) / F.length(dna)))


# --- proteins ----------------------------------------------------------------------------------------------------


def low_complexity(aminos: Column) -> Column:
    """shorter than 10, and fewer than a third of the residues (floored) are neither G nor A."""
    return (F.length(aminos) < 10) & (F.length(F.translate(aminos, "GA", "")) < F.floor(F.length(aminos) / 3))


def is_decoy(name: Column) -> Column:
    """F6."""
    return name.startswith("XXX")


def is_contaminant(name: Column, words: list[str]) -> Column:
    """the name holds one of the keywords, whatever the case."""
    return functools.reduce(lambda a, b: a | b, [F.lower(name).contains(w.lower()) for w in words], F.lit(False))


def hydropathy_plot(seq: Column, width: int = 5) -> Column:
    """X11: mean hydropathy of each stretch of `width` residues, to six places."""
    table = literal_map(HYDROPATHY)
    values = F.transform(letters(seq), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))
    n = F.length(seq) - width + 1
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # the array around the values keeps them from being made anew at each place
    plot = F.transform(F.array(values), lambda v: F.transform(places, lambda i: F.round(sum((F.get(v, i + k) for k in range(1, width)), F.get(v, i)) / width, 6)))
    return F.get(plot, F.lit(0))


def hydrophobic_patch(plot: Column, least: float = 0.5, run: int = 8) -> Column:
    """X11: start of the first run of `run` values above `least`; -1 if none."""
    state = F.aggregate(
        plot,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(-1).alias("found")),
        lambda s, x: F.struct(
            (s["i"] + 1).alias("i"),
            F.when(x > least, s["n"] + 1).otherwise(0).alias("n"),
            F.when((s["found"] < 0) & (x > least) & (s["n"] + 1 >= run), s["i"] - run + 1).otherwise(s["found"]).alias("found"),
        ),
    )
    return state["found"]


def signal_motif(prefix: Column) -> Column:
    """[ILVAGS] x [AGS] at the end."""
    return prefix.rlike("[ILVAGS].[AGS]$")


def has_basic(seq: Column, start: int = 0, stop: int | None = None) -> Column:
    """K or R among the residues from start up to stop."""
    part = F.substr(seq, F.lit(start + 1)) if stop is None else F.substr(seq, F.lit(start + 1), F.lit(stop - start))
    return part.rlike("[KR]")


def sequence_entropy(seq: Column) -> Column:
    """Entropy of the letters, natural logarithm."""
    n = F.length(seq).cast("double")
    return -F.aggregate(F.array_distinct(letters(seq)), F.lit(0.0), lambda s, c: s + (lambda p: p * F.log(p))((n - F.length(F.replace(seq, c, F.lit("")))) / n))


def isoelectric_point(seq: Column) -> Column:
    """Where the charge first falls to zero between whole pH values 1..12, interpolated; 13 if it never does."""

    def charge(ph: Column) -> Column:
        total = F.lit(0.0)
        for key, (pka, sign) in PKA.items():
            count = F.lit(1) if len(key) > 1 else F.length(seq) - F.length(F.replace(seq, F.lit(key), F.lit("")))
            power = F.pow(F.lit(10.0), sign * (F.lit(pka) - ph))
            total = total + sign * count * power / (power + 1)
        return total

    steps = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda ph: F.struct(ph.alias("ph"), charge(ph.cast("double")).alias("q")))
    state = F.aggregate(
        steps,
        F.struct(F.lit(99.0).alias("prev"), F.lit(None).cast("double").alias("pi")),
        lambda s, x: F.struct(x["q"].alias("prev"), F.when(s["pi"].isNull() & (x["q"] <= 0), x["ph"] - 1 + s["prev"] / (s["prev"] - x["q"])).otherwise(s["pi"]).alias("pi")),
    )
    return F.coalesce(state["pi"], F.lit(13.0))


def mean_hydropathy(seq: Column) -> Column:
    return sum_of(seq, HYDROPATHY) / F.length(seq)


def molecular_weight(seq: Column) -> Column:
    return peptide_mass(F.upper(seq)) + 19


def splice_score(signal: Column) -> Column:
    """Summed log frequency of a 13-base junction signal; another base counts 0.25."""
    total = F.lit(0.0)
    for i, row in enumerate(SPLICE):
        base = F.substr(signal, F.lit(i + 1), F.lit(1))
        value = F.when(base == "", 0.0)
        for b, p in zip("ACGT", row, strict=True):
            value = value.when(base == b, math.log(p))
        total = total + value.otherwise(math.log(0.25))
    return total


def main_ions(aminos: Column, mods: Column | None = None) -> Column:
    """Array of (series, n, mz) of the b and y ions alone (see `fragment_ions`)."""
    return fragment_ions(aminos, mods, True)


def fragment_ions(aminos: Column, mods: Column | None = None, main: bool = False) -> Column:
    """Array of (series, n, mz) of b, y and a ions and their water and ammonia losses, charge 1.

    mods: array of (pos, mass) to add to residues; main: only b and y.
    """
    base = literal_map(RESIDUE_MASS)
    masses = F.transform(letters(aminos), lambda c, i: F.coalesce(F.try_element_at(base, c), F.lit(0.0)) + (F.lit(0.0) if mods is None else F.aggregate(F.filter(mods, lambda m: m["pos"] == i), F.lit(0.0), lambda s, m: s + m["mass"])))
    whole = F.aggregate(masses, F.lit(0.0), lambda s, m: s + m)
    cuts = F.when(F.length(aminos) > 1, F.sequence(F.lit(1), F.length(aminos) - 1)).otherwise(F.array().cast("array<int>"))

    def of(i: Column) -> Column:
        b = F.aggregate(F.slice(masses, F.lit(1), i), F.lit(0.0), lambda s, m: s + m)
        n, y = F.length(aminos) - i, whole - b
        ion = lambda name, k, mz: F.struct(F.lit(name).alias("series"), k.alias("n"), mz.alias("mz"))
        if main:
            return F.array(ion("b", i, b + PROTON), ion("y", n, y + WATER + PROTON))
        return F.array(
            ion("b", i, b + PROTON), ion("y", n, y + WATER + PROTON), ion("a", i, b + PROTON - 27.9949),
            ion("b-h2o", i, b + PROTON - WATER), ion("b-nh3", i, b + PROTON - 17.0265),
            ion("y-h2o", n, y + PROTON), ion("y-nh3", n, y + WATER + PROTON - 17.0265),
        )

    return F.flatten(F.transform(cuts, of))


def localization_score(n: Column, winner: Column, runner_up: Column, p: float = 0.12, largest: int = 60) -> Column:
    """Difference of -10 log10 of binomial tails P(at least k of n)."""
    logs = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(largest + 1)])

    def tail(k: Column) -> Column:
        term = lambda i: F.exp(F.get(logs, n) - F.get(logs, i) - F.get(logs, n - i) + i * math.log(p) + (n - i) * math.log(1 - p))
        return F.aggregate(F.when(k <= n, F.sequence(k, n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + term(i))

    return -10 * F.log10(tail(winner)) + 10 * F.log10(tail(runner_up))


def alternate_sites(aminos: Column, sites: int, residues: str = "STY") -> Column:
    """All placements of one or two phosphates on S, T and Y, as arrays of positions from 0."""
    at = F.filter(F.transform(letters(aminos), lambda c, i: F.when(c.isin(*residues), i)), lambda i: i.isNotNull())
    if sites == 1:
        return F.transform(at, lambda i: F.array(i))
    return F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.array(i, j))))


def parent_mass(mz: Column, charge: Column) -> Column:
    """Mass with one proton."""
    return mz * charge - (charge - 1) * PROTON


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table without correction; null if a margin is zero."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / below)


def base_name(path: Column) -> Column:
    """The file's name, from Unix or Windows paths."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def gel_name(path: Column) -> Column:
    return F.regexp_extract(base_name(path), "^([A-Za-z]+)", 1)


def spot_name(path: Column) -> Column:
    return F.regexp_extract(base_name(path), "^([A-Za-z]+[0-9]+)", 1)


# --- coordinates -------------------------------------------------------------------------------------------------


def orf_header(name: Column) -> Column:
    """``Protein7.Chr:Chr1.Frame1.StartNuc831372.Strand-`` -> struct."""
    part = lambda i: F.try_element_at(F.split(name, r"\."), F.lit(i))
    chrom = F.regexp_replace(part(2), "^Chr:", "")
    return F.struct(
        chrom.alias("chrom"),
        F.concat(chrom, F.lit("."), part(1)).alias("orf_name"),
        F.regexp_extract(part(3), r"(\d+)", 1).try_cast("int").alias("frame"),
        F.regexp_extract(part(4), r"(\d+)", 1).try_cast("long").alias("start_nuc"),
        F.substr(part(5), F.lit(7), F.lit(1)).alias("strand"),
    )


def to_genome(strand: Column, start_nuc: Column, offset: Column, n: Column, add_stop: bool = False) -> Column:
    """struct(start, stop) of n residues at an offset in an ORF whose first base is start_nuc; not below 1."""
    span = n * 3 + (3 if add_stop else 0)
    plus = start_nuc + offset * 3
    minus = start_nuc - offset * 3
    start = F.when(strand == "-", minus - span + 1).otherwise(plus)
    stop = F.when(strand == "-", minus).otherwise(plus + span - 1)
    return F.struct(F.greatest(start, F.lit(1)).alias("start"), stop.alias("stop"))


def bp_overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """struct(start, stop) of an inclusive overlap; null if there is none."""
    lo, hi = F.greatest(a_start, b_start), F.least(a_stop, b_stop)
    return F.when(lo <= hi, F.struct(lo.alias("start"), hi.alias("stop")))


def five_prime(start: Column, stop: Column, strand: Column) -> Column:
    return F.when(strand == "-", stop).otherwise(start)


def three_prime(start: Column, stop: Column, strand: Column) -> Column:
    return F.when(strand == "-", start).otherwise(stop)
