"""Modifications: species, sites, features, counts and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import ranges


def pair_modless(species: DataFrame) -> DataFrame:
    """Modified species with the spectra of their unmodified counterpart (flanks, residues and charge alike)."""
    bare = species.where(~F.col("is_modified")).select("prefix", "aminos", "suffix", "charge", F.col("spectra").alias("modless_spectra"))
    return species.where("is_modified").join(bare, ["prefix", "aminos", "suffix", "charge"], "left")


def mod_type_counts(species: DataFrame) -> DataFrame:
    """(residue, mass, spectra, sites)."""
    return species.groupBy("residue", "mass").agg(F.sum("spectra").alias("spectra"), F.count_distinct("db_pos").alias("sites"))


def ptm_sites(species: DataFrame) -> DataFrame:
    """Site p-value is the product of its species' p-values."""
    return species.groupBy("db_pos", "mass").agg(F.count("*").alias("species"), F.sum("spectra").alias("spectra"), F.exp(F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("p"))


def ptm_features(psm: DataFrame, *also: Column) -> DataFrame:
    """Per (annotation, charge) best score, its delta, spectra and the share of spectra of its residues that are modified;
    also: further aggregates of the same rows."""
    own = psm.groupBy("annotation", "charge", "aminos").agg(F.max("mq_score").alias("best_score"), F.max_by("delta", F.struct("mq_score", "delta")).alias("best_delta"), F.count("*").alias("spectra"), F.max("is_modified").alias("is_modified"), *also)
    w = Window.partitionBy("aminos")
    share = F.sum(F.when(F.col("is_modified"), F.col("spectra")).otherwise(0)).over(w) / F.sum("spectra").over(w)
    return own.withColumn("modded_fraction", share).withColumn("log_spectra", F.log("spectra"))


def with_protein_coverage(features: DataFrame, coverage: DataFrame) -> DataFrame:
    """Features with a protein column and the covered percent (protein, percent) of that protein; 0 if unknown."""
    return features.join(coverage.select("protein", F.col("percent").alias("protein_coverage")), "protein", "left").na.fill(0.0, ["protein_coverage"])


def peptide_features(psm: DataFrame, best: int = 100) -> DataFrame:
    """Features of (annotation, charge) over its best spectra; log_length_5 is null up to five residues."""
    w = Window.partitionBy("annotation", "charge").orderBy(F.desc("f_score"), "spectrum_file", "scan", "rank")
    top = psm.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= best)
    return top.groupBy("annotation", "charge").agg(
        F.max("f_score").alias("best_f"), F.max_by("delta", -F.col("_n")).alias("best_f_delta"), F.max("mq_score").alias("best_mq"),
        F.log(F.count("*")).alias("log_n"), F.log(F.count("*") + 1).alias("log_n1"), F.log(F.max("length")).alias("log_length"),
        F.log(F.max("length") - 5).alias("log_length_5"),
    )


def ptm_counts(sites: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Sites kept by the walk over sorted p-values (decoys over all up to the row <= fdr at some row behind),
    counted by mass and by (mass, residue)."""
    bins = sites.groupBy("p").agg(F.count_if("is_decoy").alias("d"), F.count("*").alias("n"))
    below = ranges.running_above(bins.withColumn("_o", -F.col("p")), "_o", ["d", "n"])
    walk = below.withColumn("rate", (F.col("d_above") + F.col("d")) / (F.col("n_above") + F.col("n")))
    cut = walk.where(F.col("rate") <= fdr).agg(F.max("p").alias("cut"))
    kept = sites.join(F.broadcast(cut)).where((F.col("p") <= F.col("cut")) & ~F.col("is_decoy"))  # one row
    return kept.groupingSets([["mass"], ["mass", "residue"]], "mass", "residue").agg(F.count("*").alias("sites"), F.sum("spectra").alias("spectra"))


#: Mass, residues (any where none is named) and kind of modifications that handling is known to cause and of
#: known biological ones; the first that fits holds.
KNOWN_MODS = [
    (57, "", "adduct"), (-17, "NQ", "adduct"), (16, "MW", "adduct"), (32, "MW", "adduct"), (-48, "M", "adduct"), (58, "M", "adduct"),
    (161, "Q", "biological"), (-43, "C", "biological"), (-57, "C", "adduct"), (-18, "DEST", "adduct"), (22, "DEST", "adduct"),
    (38, "DEST", "adduct"), (80, "STY", "biological"), (160, "STY", "biological"), (42, "", "biological"), (72, "K", "biological"),
    (55, "R", "biological"), (58, "K", "biological"), (43, "", "adduct"), (14, "HK", "biological"), (12, "W", "adduct"),
    (28, "HK", "biological"), (28, "ST", "adduct"), (40, "Q", "adduct"), (4, "W", "biological"),
]


def mod_kind(mass: Column, residue: Column) -> Column:
    """Adduct, biological or unknown."""
    fits = [(mass == m) & (residue.isin(*r) if r else F.lit(True)) for m, r, _ in KNOWN_MODS]
    return F.coalesce(*[F.when(f, F.lit(kind)) for f, (_, _, kind) in zip(fits, KNOWN_MODS, strict=True)], F.lit("unknown"))


def classify_ptm_counts(counts: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Counts by (mass, residue) as classes (class, kinds, sites, spectra): adduct, biological, unknown; and the
    `top` unknown ones by sites, mass and residue, all falling."""
    named = counts.where("residue is not null").withColumn("class", mod_kind(F.col("mass"), F.col("residue")))
    classes = named.groupBy("class").agg(F.count("*").alias("kinds"), F.sum("sites").alias("sites"), F.sum("spectra").alias("spectra"))
    return classes, named.where("class = 'unknown'").orderBy(F.desc("sites"), F.desc("mass"), F.desc("residue")).limit(top).drop("class")


def choose_known(sites: DataFrame, known: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Each site (site, mass, p) with a known explanation (site, known_mass, known_p) instead of its own where the
    logarithms of the p-values differ by less than `tolerance` or the known one is better; ties: the least mass."""
    best = known.groupBy("site").agg(F.min(F.struct("known_p", "known_mass")).alias("k"))
    rows = sites.join(best, "site", "left")
    log = lambda c: F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(1e-300))))
    take = F.coalesce(log(F.col("k.known_p")) - log(F.col("p")) < tolerance, F.lit(False))
    return rows.select("site", F.when(take, F.col("k.known_mass")).otherwise(F.col("mass")).alias("mass"), F.when(take, F.col("k.known_p")).otherwise(F.col("p")).alias("p"), take.alias("known"))


def compare_ptm_rates(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two samples (keys, modified, total) as rates in percent, chi-square and a note: B where a has no spectra over
    the site (also if neither has: the original's C for that is overwritten by its next test), A where b has none, else
    empty; chi-square only where the note is empty."""
    keys = keys or ["site"]
    side = lambda df, m: df.select(*keys, F.col("modified").alias(f"{m}_mod"), F.col("total").alias(f"{m}_all"))
    two = side(a, "a").join(side(b, "b"), keys, "full_outer").na.fill(0, ["a_mod", "a_all", "b_mod", "b_all"])
    note = F.when(F.col("a_all") == 0, "B").when(F.col("b_all") == 0, "A").otherwise("")
    chi = X.chi2_2x2(F.col("a_mod"), F.col("a_all") - F.col("a_mod"), F.col("b_mod"), F.col("b_all") - F.col("b_mod"))
    rate = lambda m: 100 * F.col(f"{m}_mod") / F.greatest(f"{m}_all", F.lit(1))
    return two.withColumn("a_rate", rate("a")).withColumn("b_rate", rate("b")).withColumn("chi2", F.when(note == "", chi)).withColumn("note", note)


def chi2_p(chi2: DataFrame, column: str = "chi2") -> DataFrame:
    """P of one degree of freedom."""
    return chi2.withColumn("p", erfc(F.sqrt(F.col(column) / 2)))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about seven digits (a rational fit from a handbook of functions)."""
    terms = [0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638]
    total = F.lit(1.0)
    for k, a in enumerate(terms, 1):
        total = total + a * F.pow(x, F.lit(k))
    return 1 / F.pow(total, F.lit(16))


def first_places(places: DataFrame) -> DataFrame:
    """The first place of each peptide in a sequence, of (aminos, seq_id, pos)."""
    return ranges.stored(places.groupBy("aminos", "seq_id").agg(F.min("pos").alias("pos")))


def modified_residues(psm: DataFrame, first: DataFrame) -> DataFrame:
    """(protein, pos from 1, mass, modified): spectra of modified residues by rounded mass (half away from zero); a
    mod that rounds to 0 counts as none. psm: (aminos, mods array of (pos from 0, mass), spectra)."""
    mods = psm.select("aminos", "spectra", F.explode("mods").alias("m")).groupBy("aminos", F.col("m.pos").alias("at"), F.round("m.mass").cast("int").alias("mass")).agg(F.sum("spectra").alias("spectra"))
    return mods.where("mass <> 0").join(first, "aminos").groupBy(F.col("seq_id").alias("protein"), (F.col("pos") + F.col("at")).alias("pos"), "mass").agg(F.sum("spectra").alias("modified"))


def residue_totals(psm: DataFrame, first: DataFrame, points: DataFrame) -> DataFrame:
    """(protein, pos, total): spectra over each point (protein, pos), modified or not. Depths run up over the ends of
    the peptides, dealt by ranges: no residue is exploded."""
    seen = psm.groupBy("aminos").agg(F.sum("spectra").alias("spectra")).join(first, "aminos")
    ends = seen.select(F.col("seq_id").alias("protein"), F.col("pos").alias("x"), F.col("spectra").alias("d")).union(seen.select("seq_id", F.col("pos") + F.length("aminos"), -F.col("spectra")))
    ends = ends.groupBy("protein", "x").agg(F.sum("d").alias("d"))
    rows = ends.select("protein", "x", "d", F.lit(False).alias("point")).unionByName(points.select("protein", F.col("pos").alias("x")).distinct().withColumn("d", F.lit(0).cast("long")).withColumn("point", F.lit(True)))
    dealt = ranges.carried(ranges.placed(rows, ["protein"], ["x"]), ["protein"], _before=(F.sum("d"), F.sum))
    depth = F.sum("d").over(ranges.inside(["protein"], ["x"]).rangeBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    return dealt.withColumn("total", depth).where("point").select("protein", F.col("x").alias("pos"), "total")


def residue_mods(psm: DataFrame, places: DataFrame) -> DataFrame:
    """(protein, pos, mass, modified, total): modified residues of each sequence with all spectra over them. places:
    (aminos, seq_id, pos) as `ranges.map_peptides` finds them, of which a peptide counts at its first in a sequence."""
    first = first_places(places)
    spots = ranges.stored(modified_residues(psm, first))
    return spots.join(residue_totals(psm, first, spots), ["protein", "pos"])


def compare_residues(a: DataFrame, b: DataFrame, places: DataFrame, least: int = 5) -> DataFrame:
    """`site_diff` of two samples of hits (aminos, mods, spectra) over the same sequences."""
    first = first_places(places)
    spots = [ranges.stored(modified_residues(x, first)) for x in (a, b)]
    keys = ["protein", "pos", "mass"]
    every = ranges.stored(spots[0].select(keys).union(spots[1].select(keys)).distinct())
    full = [every.join(s, keys, "left").join(residue_totals(x, first, every), ["protein", "pos"], "left").na.fill(0, ["modified", "total"]) for s, x in zip(spots, (a, b), strict=True)]
    return site_diff(*full, least=least)


def site_diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None, ratio: float = 2, least: int = 5) -> DataFrame:
    """Sites (keys: protein, pos, mass) of two samples (keys, modified, total; see `residue_mods`) with at least
    `least` modified spectra on one side: A or B where its rate is more than `ratio` times the other's, else Both; with
    the lesser count and rate (percent)."""
    keys = keys or ["protein", "pos", "mass"]
    two = compare_ptm_rates(a, b, keys).where((F.col("a_mod") >= least) | (F.col("b_mod") >= least))
    ra, rb = F.col("a_mod") / F.greatest("a_all", F.lit(1)), F.col("b_mod") / F.greatest("b_all", F.lit(1))
    call = F.when(ra > ratio * rb, "A").when(rb > ratio * ra, "B").otherwise("Both")
    return two.select(*keys, "a_mod", "a_all", "b_mod", "b_all", call.alias("call"), F.least("a_mod", "b_mod").alias("min_count"), F.least("a_rate", "b_rate").alias("min_rate"))


def explain_ptm(sites: DataFrame, mods: DataFrame, substitutions: DataFrame) -> DataFrame:
    """(site, names): catalogue entries of the site's residue and rounded mass, and substitutions within 1 Da.

    mods: (mass, residue, name), and terminus (N, C or null) where the catalogue has it: such an entry needs the site
    at that end (column terminus of sites) and no residue. A mass that is a residue's fixed modification less the mass
    itself (columns base and mass of sites; base null if none) is named "unmodified". Catalogues are broadcast if small.
    """
    whole = mods.select(F.round("mass").alias("mass"), "residue", "name", *[c for c in ("terminus",) if c in mods.columns])
    at_end = "terminus" in mods.columns and "terminus" in sites.columns
    plain = whole.where("terminus is null").drop("terminus") if "terminus" in whole.columns else whole
    found = sites.join(ranges.small(plain), ["mass", "residue"]).select("site", "name")
    if at_end:
        found = found.union(sites.drop("residue").join(ranges.small(whole.where("terminus is not null").drop("residue")), ["mass", "terminus"]).select("site", "name"))
    if "base" in sites.columns:
        found = found.union(sites.where("mass = -base").select("site", F.lit("unmodified").alias("name")))
    subs = substitutions.select(F.col("from_aa").alias("residue"), "to_aa", F.col("delta").cast("double").alias("delta"))
    close = ranges.tolerance_join(sites.select("site", "residue", F.col("mass").cast("double").alias("_m")), subs, ["residue"], "_m", "delta", 1.0).where(F.abs(F.col("_m") - F.col("delta")) < 1.0)
    found = found.union(close.select("site", F.concat("residue", F.lit("->"), "to_aa").alias("name")))
    return found.distinct().groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def ptm_mass(psm: DataFrame, trim: float = 0.5, proton: float = 1.0078) -> DataFrame:
    """Per site mean and deviation of its masses (less a proton), their modal isotope (ties: the least), and number,
    mean and deviation of the masses within `trim` of it."""
    rows = psm.select("site", (F.col("delta_mass") - proton).alias("m"))
    modal = rows.groupBy("site").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.mode(F.round("m"), True).alias("isotope"))
    near = rows.join(modal.select("site", "isotope"), "site").where(F.abs(F.col("m") - F.col("isotope")) <= trim)
    near = near.groupBy("site").agg(F.count("*").alias("trimmed_n"), F.avg("m").alias("trimmed_mean"), F.stddev_pop("m").alias("trimmed_sd"))
    return modal.join(near, "site", "left")


def reconcile_species(species: DataFrame, tol: float = 0.02) -> DataFrame:
    """Each species with its best compatible partner: (id, partner) share a database position where both the
    prefix and the suffix mass agree within tol; the better score wins.

    Points shuffle once, by position and cells of 64 bins of prefix (a bin is a little wider than tol), those of a border
    bin to the next cell too, and see the points of their own bin and of both beside it. Of equal points the best alone is
    offered as a partner: it is the best of all for any other one, and for itself none of them is better.
    """
    rows = species.where("id is not null").select("id", "score", F.explode("points").alias("pt")).select("id", "score", "pt.pos", "pt.prefix", "pt.suffix")
    binned = F.floor(F.col("prefix") / (1.001 * tol if tol > 0 else 1.0))
    cells = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: F.floor((binned + d) / 64)))
    rows = rows.where("pos is not null and prefix is not null").withColumn("_cell", F.explode(cells)).repartition("pos", "_cell").withColumn("_bin", binned)
    me, other = F.struct(F.col("score").alias("p_score"), F.col("id").alias("partner")), F.struct("score", "id", "prefix", "suffix")
    top = F.max(me).over(Window.partitionBy("pos", "_cell", "prefix", "suffix")) == me
    near = Window.partitionBy("pos", "_cell").orderBy("_bin").rangeBetween(-1, 1)
    seen = rows.withColumn("_top", top).withColumn("_near", F.collect_list(F.when(F.col("_top"), other)).over(near)).where(F.col("_cell") == F.floor(F.col("_bin") / 64))
    fits = lambda x: (F.abs(F.col("prefix") - x["prefix"]) <= tol) & (F.abs(F.col("suffix") - x["suffix"]) <= tol) & (x["id"] != F.col("id")) & (x["score"] > F.col("score"))
    best = F.array_max(F.transform(F.filter("_near", fits), lambda x: F.struct(x["score"].alias("p_score"), x["id"].alias("partner"))))
    return seen.select("id", best.alias("_best")).where("_best is not null").groupBy("id").agg(F.max("_best").alias("_best")).select("id", F.col("_best.partner").alias("partner"))


def merge_species(*parts: DataFrame) -> DataFrame:
    """Union of shards: counts add up, the best row stays."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("annotation", "charge").agg(F.sum("spectra").alias("spectra"), F.max("best_score").alias("best_score"), F.max_by("best_delta", F.struct("best_score", "best_delta")).alias("best_delta"))


def bigdb_delta(species: DataFrame, hits: DataFrame) -> DataFrame:
    """Species with the difference of their score to the spectrum's best in the large database."""
    top = hits.groupBy("spectrum_file", "scan").agg(F.max("mq_score").alias("_m"))
    return species.join(top, ["spectrum_file", "scan"], "left").withColumn("bigdb_delta", F.col("mq_score") - F.col("_m")).drop("_m")


def strip_needless_mod(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Rows (aminos, mod_pos, mod_mass, seq, pos from 1): a mod that one to three flanking residues explain within
    2 Da, on the side where it stands, becomes a longer peptide (new_aminos, new_pos); else both are null."""
    n = F.length("aminos")
    left = F.array(*[F.when(F.col("pos") > k, F.substr(F.col("seq"), F.col("pos") - k, F.lit(k))) for k in range(1, reach + 1)])
    right = F.array(*[F.when(F.col("pos") + n + k - 1 <= F.length("seq"), F.substr(F.col("seq"), F.col("pos") + n, F.lit(k))) for k in range(1, reach + 1)])
    fits = lambda a: F.try_element_at(F.filter(a, lambda s: s.isNotNull() & (F.abs(X.peptide_mass(s) - F.col("mod_mass")) <= 2)), F.lit(1))
    l, r = F.when(F.col("mod_pos") < reach, fits(left)), F.when(F.col("mod_pos") >= n - reach, fits(right))
    return rows.withColumn("new_aminos", F.coalesce(F.concat(l, "aminos"), F.concat("aminos", r))).withColumn("new_pos", F.when(l.isNotNull(), F.col("pos") - F.length(l)).when(r.isNotNull(), F.col("pos")))
