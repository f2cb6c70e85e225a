"""Pipelines composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import genome, inference, ml, psm as P, ptm, ranges, spectra


def named(hits: DataFrame, peptides: DataFrame | None) -> DataFrame:
    """Rows by peptide (aminos), where hits name it by a number (aminos) of peptides (aminos, peptide); a number may stand
    for several, or for none."""
    return hits if peptides is None else hits.join(peptides, "aminos").withColumn("aminos", F.col("peptide")).drop("peptide")


def run_report(psm: DataFrame, located: DataFrame, calls: DataFrame, signal: DataFrame, peptides: DataFrame | None = None) -> DataFrame:
    """One row of counts; every part is a single-row aggregate. peptides: see `run_all`."""
    # counted by peptide first: rows shuffle as one per peptide and task, and not twice as pairs to be told apart
    by = named(psm.groupBy("aminos").agg(F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d")), peptides)
    some = lambda c: F.count_if(F.col("aminos").isNotNull() & (F.col(c) > 0))
    one = by.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("spectra"), some("t").alias("true_peptides"), some("d").alias("decoy_peptides"))
    two = located.agg(F.count_distinct("aminos").alias("mapped_peptides"))
    three = calls.agg(F.count_if(F.col("call") == "NOVEL").alias("novel"), F.count_if(F.col("call") == "UNDERPREDICTED").alias("wrong_start"))
    four = signal.agg(F.count_if(F.col("decision") == 5).alias("signal"))
    return one.join(F.broadcast(two)).join(F.broadcast(three)).join(F.broadcast(four))  # one row each


def summary_report(psm: DataFrame, mapped: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per protein of the parsimonious set peptides, spectra, modified peptides, coverage and weight."""
    owned = inference.select_proteins(psm.groupBy("aminos", "protein").agg(F.count("*").alias("spectra")))
    rows = psm.join(owned.select("protein", "aminos"), ["protein", "aminos"])
    counts = rows.groupBy("protein").agg(F.count_distinct("aminos").alias("peptides"), F.count("*").alias("spectra"), F.count_distinct(F.when(F.col("is_modified"), F.col("aminos"))).alias("modified_peptides"))
    covered = inference.residue_coverage(mapped.select("seq_id", "pos", (F.col("pos") + F.length("aminos") - 1).alias("stop")), sequences)
    weight = sequences.select("seq_id", X.molecular_weight(F.col("seq")).alias("weight"))
    return counts.join(covered.withColumnRenamed("seq_id", "protein"), "protein", "left").join(weight.withColumnRenamed("seq_id", "protein"), "protein", "left")


def gene_subset(report: DataFrame, genes: DataFrame) -> DataFrame:
    """The report's rows of a list of proteins (protein)."""
    return report.join(ranges.small(genes.select("protein").distinct()), "protein", "left_semi")


def unique_substrings(queries: DataFrame, sequences: DataFrame) -> DataFrame:
    """(aminos, seq_id, pos) of the queried strings that stand in exactly one place of all sequences."""
    return ranges.map_peptides(queries, sequences).where("is_unique").select("aminos", "seq_id", "pos")


def calibrated(psm: DataFrame, decoy_fraction: float = 0.5, retain: bool = False, top: DataFrame | None = None) -> DataFrame:
    """A2, A3, A1 and A4 in a row. top: the spectra's first rows, where they are known without sorting psm."""
    top = ranges.stored((P.top_hit(psm) if top is None else top).select("charge", "mq_score", "delta", "length", "is_decoy"))
    deltas = ranges.stored(P.mean_delta(top, first=True))
    table = P.fdr_table(P.score_histogram(P.with_f_score(top, deltas), first=True), decoy_fraction, retain)
    return P.assign_pvalue(P.with_f_score(psm, deltas), table)


def locate(peptides: DataFrame, orfs: DataFrame) -> DataFrame:
    """Peptides on the genome: J1 on the ORFs' residues, then X22."""
    name = F.struct("orf_name", "chrom", "strand", "start_nuc")  # comes back with each place
    rows = ranges.map_peptides(peptides, orfs.select(name.alias("seq_id"), "seq"), dealt=True).select("*", "seq_id.*")
    place = X.to_genome(F.col("strand"), F.col("start_nuc"), F.col("pos") - 1, F.length("aminos"))
    return rows.select("orf_name", "aminos", "chrom", "strand", place["start"].alias("start"), place["stop"].alias("stop"), (F.col("pos") - 1).alias("aa_offset"), "is_unique", "tryptic_n", "tryptic_c")


def named_orfs(contigs: DataFrame, min_aa: int = 7) -> DataFrame:
    """G1 with orf_name and the place on the genome. Not stored once more: `six_frame` stores what it translated, and the
    rest of it is cheap."""
    orfs = genome.six_frame(contigs, min_aa).withColumn("orf_name", F.concat_ws(".", "chrom", "strand", "frame", "start_nuc"))
    span = X.to_genome(F.col("strand"), F.col("start_nuc"), F.lit(0), F.col("length"), add_stop=True)
    return orfs.select("*", span["start"].alias("start"), span["stop"].alias("stop"))


def supportable(orfs: DataFrame, cds: DataFrame, seen: DataFrame, most: int = 3_000_000) -> DataFrame:
    """The ORFs that a CDS ends with or that peptides were seen in (seen: orf_name), and by hash perhaps some others; all
    of them where those are more than `most` and their hashes too many to be broadcast."""
    end = F.xxhash64(F.col("chrom").cast("string"), X.three_prime(F.col("start"), F.col("stop"), F.col("strand")).cast("long"), "strand")
    ended, found = inference.stored(cds.select(end.alias("_e")).distinct()), inference.stored(seen.select(F.xxhash64("orf_name").alias("_o")).distinct())
    if ended.count() + found.count() > most:
        return orfs
    rows = orfs.withColumn("_e", end).withColumn("_o", F.xxhash64("orf_name"))
    for name, known in (("_e", ended), ("_o", found)):
        rows = rows.join(F.broadcast(known.withColumn(f"{name}_is", F.lit(True))), name, "left")
    return rows.where("_e_is or _o_is").select(orfs.columns)


def run_all(contigs: DataFrame | None, psm: DataFrame, cds: DataFrame, p: float = 1e-2, min_aa: int = 7, top: DataFrame | None = None, peptides: DataFrame | None = None, orfs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Six frames, calibrated hits, mapping, filters, conflicts and calls.

    psm: aminos are residues, or numbers of peptides (aminos, peptide, each of them once): a hit then stands for one of
    each peptide of its number, and numbers meet residues when hits are counted. top: see `calibrated`; orfs: `named_orfs`,
    where they are known. Boundaries that several parts read are stored; psm is not, and leaves its tasks by peptide alone.
    """
    orfs = named_orfs(contigs, min_aa) if orfs is None else orfs
    good = P.confident(calibrated(psm, top=top).where(~F.col("is_decoy")).withColumn("lfdr", F.lit(None).cast("double")), p)
    located = inference.stored(locate(named(good.select("aminos").distinct(), peptides), orfs))
    kept = genome.filter_orfs(located).where("killed_by is null").select("orf_name")
    held = located.join(kept, "orf_name", "left_semi")
    seen = inference.stored(held.groupBy("orf_name").agg(F.count("*").alias("spectra"), F.min("start").alias("seen_start"), F.max("stop").alias("seen_stop")))
    near = supportable(orfs.select("orf_name", "chrom", "strand", "start", "stop"), cds, seen)
    linked = genome.link_orfs_to_cds(near, cds).join(seen, "orf_name", "left")
    supported = inference.stored(linked.where("spectra is not null or protein_id is not null").withColumn("spectra", F.coalesce("spectra", F.lit(0))).withColumn("named", F.col("protein_id").isNotNull()))
    # residues between the annotated start of an ORF's protein and its first unique peptide
    minus = F.col("strand") == "-"
    offset = F.when(minus, F.col("stop") - F.col("protein_stop")).otherwise(F.col("protein_start") - F.col("start")) / 3
    proteins = supported.where("protein_id is not null").select("orf_name", F.floor(offset).cast("int").alias("protein_offset"))
    first = inference.stored(genome.first_peptide(held, True).select("orf_name", "aminos").join(proteins, "orf_name"))
    first = first.join(orfs.select("orf_name", "seq").join(ranges.small(first.select("orf_name").distinct()), "orf_name", "left_semi"), "orf_name")
    first = first.join(held.groupBy("orf_name", "aminos").agg(F.min("aa_offset").alias("aa_offset"), F.min("tryptic_n").alias("tryptic_n")), ["orf_name", "aminos"])
    ahead = F.greatest(F.col("aa_offset") - F.col("protein_offset"), F.lit(0))
    signal = genome.signal_peptides(first.select("orf_name", F.substr(F.col("seq"), F.col("protein_offset") + 1, ahead).alias("prefix"), "tryptic_n"))
    calls = genome.call_structure(supported, held)
    return {"orfs": supported, "located": held, "conflicts": genome.conflicts(supported), "calls": calls, "signal": signal, "report": run_report(psm, held, calls, signal, peptides)}


def run_ptm(psm: DataFrame, fdr: float = 0.05, second: DataFrame | None = None, points: DataFrame | None = None, known: DataFrame | None = None, top: DataFrame | None = None) -> dict[str, DataFrame]:
    """P9 from hits with sites: psm adds annotation, residue, mass, db_pos.

    second: hits of the large database (J13); points: (annotation, charge, points) of species for J20; known:
    (site, known_mass, known_p), explanations of sites "db_pos:mass". Each of them may be missing. A species' p-value
    is one less the model's probability; species that a better one explains leave before sites are made. top: see
    `calibrated`. Rows are stored with the columns that are read again; with `second` they need no order in their spectra,
    and meet it with what the gap needs alone.
    """
    used = ["spectrum_file", "scan", "annotation", "charge", "aminos", "mq_score", "delta", "is_modified", "is_decoy", "db_pos", "mass", "residue"]
    rows = inference.stored(calibrated(psm, top=top).select(*used, *(["rank"] if second is None else [])))
    about = [F.max("is_decoy").alias("is_decoy"), F.min("db_pos").alias("db_pos"), F.min("mass").alias("mass"), F.min("residue").alias("residue")]
    if second is None:
        features = inference.stored(ptm.ptm_features(rows))
        gaps = P.top_hit(rows).groupBy("annotation", "charge").agg(F.max("delta").alias("gap"), *about)
    else:
        whole = inference.stored(ptm.ptm_features(rows, *[x.alias(f"_{n}") for x, n in zip(about, ("is_decoy", "db_pos", "mass", "residue"), strict=True)]))
        features = whole.drop("_is_decoy", "_db_pos", "_mass", "_residue")
        gap = ptm.bigdb_delta(rows.select("spectrum_file", "scan", "annotation", "charge", "mq_score"), second).groupBy("annotation", "charge").agg(F.max(F.coalesce("bigdb_delta", F.lit(0.0))).alias("gap"))
        own = whole.groupBy("annotation", "charge").agg(F.max("_is_decoy").alias("is_decoy"), *[F.min(f"_{n}").alias(n) for n in ("db_pos", "mass", "residue")])
        gaps = gap.join(own, ["annotation", "charge"])
    table = features.select("annotation", "charge", "best_score", "modded_fraction", "log_spectra", "spectra").join(gaps, ["annotation", "charge"])
    table = inference.stored(table.withColumn("label", (~F.col("is_decoy")).cast("int")))
    scored = ml.fit_peptide_model(table, ["best_score", "modded_fraction", "log_spectra", "gap"])
    species = scored.select("annotation", "charge", "spectra", "is_decoy", "db_pos", "mass", "residue", F.greatest(1 - F.col("score"), F.lit(1e-12)).alias("p"))
    if points is not None:
        named = species.join(points, ["annotation", "charge"]).select(F.concat_ws("/", "annotation", "charge").alias("id"), (1 - F.col("p")).alias("score"), "points")
        explained = ptm.reconcile_species(named).select(F.col("id").alias("_id")).distinct()
        species = species.join(explained, F.concat_ws("/", "annotation", "charge") == F.col("_id"), "left_anti")
    species = inference.stored(species)
    sites = ptm.ptm_sites(species).join(species.groupBy("db_pos", "mass").agg(F.min("residue").alias("residue"), F.max("is_decoy").alias("is_decoy")), ["db_pos", "mass"])
    if known is not None:
        named = sites.withColumn("site", F.concat_ws(":", "db_pos", "mass"))
        chosen = ptm.choose_known(named.select("site", "mass", "p"), known)
        sites = named.drop("mass", "p").join(chosen, "site").drop("site")
    sites = inference.stored(sites)
    counts = inference.stored(ptm.ptm_counts(sites, fdr))
    classes, unknown = ptm.classify_ptm_counts(counts)
    return {"features": features, "species": species, "sites": sites, "counts": counts, "classes": classes, "unknown": unknown}


def consensus_of(peaks: DataFrame) -> DataFrame:
    return spectra.consensus(spectra.consensus_bins(peaks))
