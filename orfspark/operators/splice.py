"""Exons, junctions, splicing and variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import expr as X, grams, signals
from . import ranges


def junctions_of(alignments: DataFrame) -> DataFrame:
    """Junctions (chrom, strand, donor, acceptor, n) between neighbouring blocks of an alignment."""
    w = Window.partitionBy("alignment", "chrom", "strand").orderBy("start", "stop")
    rows = alignments.withColumn("acceptor", F.lead("start").over(w)).where("acceptor is not null and acceptor > stop")
    return rows.groupBy("chrom", "strand", F.col("stop").alias("donor"), "acceptor").agg(F.count("*").alias("n"))


def interval_counts(alignments: DataFrame) -> DataFrame:
    """(chrom, strand, start, stop, n)."""
    return alignments.groupBy("chrom", "strand", "start", "stop").agg(F.count("*").alias("n"))


def accept_junctions(junctions: DataFrame, least: int = 2, score: float = -12.75) -> DataFrame:
    """enough witnesses, or a signal that scores above the cut."""
    return junctions.withColumn("score", X.splice_score(F.col("signal"))).where((F.col("n") >= least) | (F.col("score") > score))


def best_signals(contigs: DataFrame) -> DataFrame:
    """(chrom, n, best, at): per contig (chrom, seq) the number of its stretches of 13 bases, the best score to five
    decimals and the first place (from 1) that has it. Stretches are scored where they stand; a few leave their task."""
    shape = StructType([contigs.schema["chrom"], StructField("n", LongType()), StructField("score", DoubleType()), StructField("pos", IntegerType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, score, pos = [], [], [], []
            for number, first, parts in grams.groups(batch.column("seq").to_pylist(), signals.LENGTH - 1):
                for i, at, part in zip(number, first, parts, strict=True):
                    size, best, places = signals.best_of(part)
                    rows += [i] * len(best)
                    n += [size, *[0] * (len(best) - 1)][: len(best)]
                    score += best.tolist()
                    pos += (places + at + 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(pos, pa.int32())], ["chrom", "n", "score", "pos"])

    parts = ranges.spread(contigs.select("chrom", "seq")).mapInArrow(found, shape).withColumn("score", F.round("score", 5))
    return parts.groupBy("chrom").agg(F.sum("n").alias("n"), F.max("score").alias("best"), F.min_by("pos", F.struct(-F.col("score"), "pos")).alias("at"))


def accepted_signals(contigs: DataFrame, least: int = 2, score: float = -12.75, letters: int = 1 << 20) -> DataFrame:
    """(chrom, signal, n, score) of the stretches of 13 bases that a contig (chrom, seq) holds `least` times or that
    score above the cut (see `accept_junctions`).

    Contigs meet whole, dealt by name, and are counted in arrays, so stretches are not shuffled; those of more than
    `letters` bases are split into stretches, which are.
    """
    rows = contigs.select("chrom", "seq").where(F.length("seq") >= signals.LENGTH)
    large = ranges.stored(rows.groupBy("chrom").agg(F.sum(F.length("seq")).alias("n")).where(F.col("n") > letters).select("chrom"))
    shape = StructType([contigs.schema["chrom"], StructField("signal", StringType()), StructField("n", LongType()), StructField("score", DoubleType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, names, numbers, texts, size = None, [], [], [], 0

        def of_group() -> pa.RecordBatch:
            number, signal, n, value = signals.accepted(np.array(numbers), texts, least, score)
            return pa.RecordBatch.from_arrays([pa.array(names, kind).take(pa.array(number)), signal, pa.array(n, pa.int64()), pa.array(value, pa.float64())], ["chrom", "signal", "n", "score"])

        for batch in batches:
            kind = batch.column("chrom").type
            for name, text in zip(batch.column("chrom").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if not names or name != names[-1]:
                    if size >= letters:
                        yield of_group()
                        names, numbers, texts, size = [], [], [], 0
                    names.append(name)
                numbers.append(len(names) - 1)
                texts.append(text)
                size += len(text)
        if names:
            yield of_group()

    if not large.limit(1).count():
        return ranges.spread(rows, "chrom").sortWithinPartitions("chrom").mapInArrow(counted, shape)
    same = [F.col("a.chrom").eqNullSafe(F.col("b.chrom"))]
    few = rows.alias("a").join(ranges.small(large).alias("b"), same, "left_anti")
    many = rows.alias("a").join(ranges.small(large).alias("b"), same, "left_semi")
    split = accept_junctions(ranges.kmers(many, "seq", signals.LENGTH, ["chrom"]).groupBy("chrom", F.col("kmer").alias("signal")).agg(F.count("*").alias("n")), least, score)
    return ranges.spread(few, "chrom").sortWithinPartitions("chrom").mapInArrow(counted, shape).unionByName(split)


def introns(exons: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, start, stop, length) between a transcript's exons."""
    w = Window.partitionBy("gene_id", "transcript_id").orderBy("start", "stop")
    rows = exons.withColumn("_s", F.lead("start").over(w)).where(F.col("_s") > F.col("stop") + 1)
    return rows.select("gene_id", "transcript_id", (F.col("stop") + 1).alias("start"), (F.col("_s") - 1).alias("stop"), (F.col("_s") - F.col("stop") - 1).alias("length"))


def intron_lengths(exons: DataFrame, width: float = 100) -> DataFrame:
    """A42."""
    return ranges.histogram(introns(exons), "length", width)


def alt_splicing(exons: DataFrame) -> DataFrame:
    """Per gene the transcripts, introns in all of them, and pairs of other introns with one end in common that overlap."""
    rows = introns(exons).distinct()
    n = exons.groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("transcripts"))
    per = rows.groupBy("gene_id", "start", "stop").agg(F.count_distinct("transcript_id").alias("k")).join(n, "gene_id")
    shared = per.groupBy("gene_id").agg(F.count_if(F.col("k") == F.col("transcripts")).alias("shared_introns"))
    some = per.where("k < transcripts")
    partners = lambda end, other: some.groupBy("gene_id", end).agg(F.count("*").alias("c")).groupBy("gene_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias(f"alt_{other}"))
    out = n.join(shared, "gene_id", "left").join(partners("start", "acceptor"), "gene_id", "left").join(partners("stop", "donor"), "gene_id", "left")
    return out.na.fill(0)


def multi_partner_ends(junctions: DataFrame) -> DataFrame:
    """Donors and acceptors with two partners or more: (kind, chrom, at, partners)."""
    d = junctions.groupBy("chrom", F.col("donor").alias("at")).agg(F.count_distinct("acceptor").alias("partners")).withColumn("kind", F.lit("donor"))
    a = junctions.groupBy("chrom", F.col("acceptor").alias("at")).agg(F.count_distinct("donor").alias("partners")).withColumn("kind", F.lit("acceptor"))
    return d.unionByName(a).where("partners >= 2").select("kind", "chrom", "at", "partners")


def alt_ends_by_category(hits: DataFrame, delta: float = -0.1, score: float = -1.0, anchor: int = 7) -> DataFrame:
    """(kind, category, ends, observed): donors and acceptors with two partners or more among confident junction
    hits, by the least category seen there, and the hits over them.

    hits: chrom, donor, acceptor, category, delta, score, left_nt, right_nt. Categories 8 and 9, weak scores and short
    anchor segments do not count.
    """
    good = hits.where(~F.col("category").isin(8, 9) & (F.col("delta") >= delta) & (F.col("score") >= score) & (F.least("left_nt", "right_nt") > anchor))
    side = lambda kind, at, other: good.groupBy("chrom", F.col(at).alias("at")).agg(F.count_distinct(other).alias("partners"), F.min("category").alias("category"), F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    ends = side("donor", "donor", "acceptor").unionByName(side("acceptor", "acceptor", "donor")).where("partners >= 2")
    return ends.groupBy("kind", "category").agg(F.count("*").alias("ends"), F.sum("n").alias("observed"))


def isoforms_per_gene(exons: DataFrame) -> DataFrame:
    """(isoforms, genes): genes by the number of transcripts with different exon chains."""
    n = drop_redundant_transcripts(exons).groupBy("gene_id").agg(F.count("*").alias("isoforms"))
    return n.groupBy("isoforms").agg(F.count("*").alias("genes"))


def exons_per_transcript(exons: DataFrame) -> DataFrame:
    """(exons, transcripts)."""
    n = exons.groupBy("gene_id", "transcript_id").agg(F.count("*").alias("exons"))
    return n.groupBy("exons").agg(F.count("*").alias("transcripts"))


def drop_redundant_transcripts(exons: DataFrame) -> DataFrame:
    """One transcript per gene and exon chain, the one with the least name."""
    chain = exons.groupBy("gene_id", "transcript_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", F.lpad(F.col("start").cast("string"), 12, "0"), "stop"))), ",").alias("chain"))
    return chain.groupBy("gene_id", "chain").agg(F.min("transcript_id").alias("transcript_id"))


def exon_support(exons: DataFrame, intervals: DataFrame) -> DataFrame:
    """Covered for an interval with the same ends, else the best overlap in bases as touched, else none."""
    key = ["chrom", "strand", "start", "stop"]
    met = ranges.overlap_join(exons.select(*key), intervals.select("chrom", "strand", F.col("start").alias("i_start"), F.col("stop").alias("i_stop")), ["chrom", "strand"], ("start", "stop"), ("i_start", "i_stop"), None)
    shared = F.least("stop", "i_stop") - F.greatest("start", "i_start") + 1
    best = met.groupBy(*key).agg(F.max(shared).alias("bases"), F.max((F.col("start") == F.col("i_start")) & (F.col("stop") == F.col("i_stop"))).alias("same"))
    out = exons.select(*key).distinct().join(best, key, "left")
    return out.select(*key, F.when(F.col("same"), "covered").when(F.col("bases") > 0, "touched").otherwise("none").alias("support"), F.coalesce("bases", F.lit(0)).alias("bases"))


def junction_support(wanted: DataFrame, seen: DataFrame, near: int = 20) -> DataFrame:
    """Exact witnesses n, else the distance to the nearest junction with both ends within `near`."""
    exact = wanted.join(seen.select("chrom", "donor", "acceptor", "n"), ["chrom", "donor", "acceptor"], "left")
    other = seen.select("chrom", F.col("donor").alias("_d"), F.col("acceptor").alias("_a"))
    close = ranges.tolerance_join(wanted.select("chrom", "donor", "acceptor").distinct(), other, ["chrom"], "donor", "_d", near).where(F.abs(F.col("acceptor") - F.col("_a")) <= near)
    best = close.groupBy("chrom", "donor", "acceptor").agg(F.min(F.abs(F.col("donor") - F.col("_d")) + F.abs(F.col("acceptor") - F.col("_a"))).alias("distance"))
    return exact.join(best, ["chrom", "donor", "acceptor"], "left").select("chrom", "donor", "acceptor", F.coalesce("n", F.lit(0)).alias("n"), "distance")


def snp_evidence(peptides: DataFrame, snps: DataFrame) -> DataFrame:
    """Per variant the peptides over it for each allele and their best scores; peptides: chrom, start, stop, allele_of, score."""
    points = snps.select("chrom", F.col("pos").alias("p"), F.col("pos").alias("q"), "snp")
    met = ranges.overlap_join(points, peptides, ["chrom"], ("p", "q"), ("start", "stop"))
    return met.groupBy("snp").agg(F.count_if(F.col("allele") == "ref").alias("ref_peptides"), F.count_if(F.col("allele") == "alt").alias("alt_peptides"), F.max(F.when(F.col("allele") == "ref", F.col("score"))).alias("ref_best"), F.max(F.when(F.col("allele") == "alt", F.col("score"))).alias("alt_best"))


def annotation_level_coverage(genes: DataFrame) -> DataFrame:
    """(level, genes, with_evidence, peptides); genes named hypothetical, putative or otherwise."""
    level = F.when(F.lower("product").contains("hypothetical"), "hypothetical").when(F.lower("product").contains("putative"), "putative").otherwise("named")
    return genes.groupBy(level.alias("level")).agg(F.count("*").alias("genes"), F.count_if(F.col("peptides") > 0).alias("with_evidence"), F.sum("peptides").alias("peptides"))


def unexplained_genes(hits: DataFrame, known: tuple = (1, 4)) -> DataFrame:
    """(gene_id, hits): genes with hits (gene_id, category) of which none is in the known proteins."""
    by = hits.where("gene_id is not null and category > 0").groupBy("gene_id").agg(F.count("*").alias("hits"), F.count_if(F.col("category").isin(*known)).alias("k"))
    return by.where("k = 0").select("gene_id", "hits")


def known_coverage(coverage: DataFrame, proteins: DataFrame) -> DataFrame:
    """(level, proteins, seen, residues, covered) of known proteins (seq_id, product) with their coverage
    (seq_id, length, covered)."""
    level = F.when(F.lower("product").contains("hypothetical"), "hypothetical").when(F.lower("product").contains("putative"), "putative").otherwise("named")
    both = proteins.join(coverage, "seq_id")
    return both.groupBy(level.alias("level")).agg(F.count("*").alias("proteins"), F.count_if(F.col("covered") > 0).alias("seen"), F.sum("length").alias("residues"), F.sum("covered").alias("covered"))


def nearest_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits (hit, chrom, start, stop) with the gene that ends last before the start (left) and the one that begins
    first behind the stop (right), null if there is none. Places of a chromosome are dealt by ranges, which hand on
    their last gene."""

    def before(points: DataFrame, ends: DataFrame, name: str) -> DataFrame:
        rows = points.select("chrom", "at", F.lit(0).alias("is_gene"), "hit", F.lit(None).cast(ends.schema["gene_id"].dataType).alias("gene_id"))
        rows = rows.unionByName(ends.select("chrom", "at", F.lit(1).alias("is_gene"), F.lit(None).cast(points.schema["hit"].dataType).alias("hit"), "gene_id"))
        last = F.when(F.col("is_gene") == 1, F.struct("at", "gene_id"))
        dealt = ranges.carried(ranges.placed(rows.withColumn("g", last), ["chrom"], ["at"]), ["chrom"], far=(F.max("g"), F.max))
        seen = F.greatest(F.max("g").over(ranges.inside(["chrom"], ["at", "is_gene"]).rowsBetween(Window.unboundedPreceding, 0)), F.col("far"))
        return dealt.select("is_gene", "hit", seen["gene_id"].alias(name)).where("is_gene = 0").select("hit", name)

    left = before(hits.select("hit", "chrom", F.col("start").alias("at")), genes.select("chrom", F.col("stop").alias("at"), "gene_id"), "left_gene")
    right = before(hits.select("hit", "chrom", (-F.col("stop")).alias("at")), genes.select("chrom", (-F.col("start")).alias("at"), "gene_id"), "right_gene")
    return left.join(right, "hit")


def categorize_hits(hits: DataFrame, exons: DataFrame) -> DataFrame:
    """Category 0 for weak or short hits; one segment: 1 inside an exon of its strand with the peptide in the
    gene's protein, 2 inside without, 3 not inside, 8 with more than one mismatch; two or three segments: 5 all edges
    known and all segments inside exons of one gene, 6 some edge, 7 none, 8 mismatches, 4 if the protein has it; more: 9.

    hits: hit, chrom, strand, segments array of (start, stop), p_value, length, mismatches, in_protein.
    """
    base = hits.withColumn("n", F.size("segments"))
    # hits of the same segments fit the same genes, and genes of the same exons the same hits: one of each stands for all
    alike = base.where("hit is not null").groupBy("hit").agg(F.array_sort(F.collect_set(F.struct("chrom", "strand", "segments"))).alias("at"))
    alike = ranges.stored(alike.withColumn("lead", F.min("hit").over(Window.partitionBy("at"))))
    placed = alike.where(F.col("hit") == F.col("lead")).select("lead", F.explode("at").alias("a")).select("lead", "a.*").withColumn("n", F.size("segments"))
    seg = placed.select("lead", "n", "chrom", "strand", F.posexplode("segments").alias("no", "s")).select("lead", "n", "no", "chrom", "strand", F.col("s.start").alias("s_start"), F.col("s.stop").alias("s_stop"))
    genes = exons.groupBy("gene_id").agg(F.array_sort(F.collect_set(F.struct("chrom", "strand", "start", "stop"))).alias("e")).groupBy("e").agg(F.min("gene_id").alias("gene_id"))
    genes = ranges.stored(genes.select("gene_id", F.explode("e").alias("e")).select("gene_id", "e.*"))
    inside = ranges.contained_in(seg, genes, ["chrom", "strand"], ("s_start", "s_stop"), ("start", "stop"), width=None)
    donor = F.when((F.col("no") < F.col("n") - 1) & (F.col("s_stop") == F.col("stop")), F.col("no"))
    acceptor = F.when((F.col("no") > 0) & (F.col("s_start") == F.col("start")), F.col("no"))
    fit = inside.groupBy("lead", "n", "gene_id").agg(F.count_distinct("no").alias("fits"), (F.count_distinct(donor) + F.count_distinct(acceptor)).alias("edges"))
    best = fit.groupBy("lead").agg(F.max("fits").alias("fits"), F.max((F.col("fits") == F.col("n")) & (F.col("edges") == 2 * F.col("n") - 2)).alias("both"), F.max(F.col("edges") > 0).alias("edge"))
    j = base.join(alike.select("hit", "lead").join(best, "lead").drop("lead"), "hit", "left").na.fill(0, ["fits"]).na.fill(False, ["both", "edge"])
    one = F.when(F.col("fits") > 0, F.when(F.col("in_protein"), 1).otherwise(2)).when(F.col("mismatches") > 1, 8).when(F.col("in_protein"), 1).otherwise(3)
    more = F.when(F.col("both"), F.when(F.col("in_protein"), 4).otherwise(5)).when(F.col("edge"), F.when(F.col("in_protein"), 4).otherwise(6)).when(F.col("mismatches") > 1, 8).otherwise(7)
    c = F.when((F.col("p_value") > 0.05) | (F.col("length") < 8), 0).when(F.col("n") == 1, one).when(F.col("n") <= 3, more).otherwise(9)
    return j.select("hit", c.alias("category"))


#: Rank of each category; the higher one wins a spectrum, and 0 is not worth reporting.
CATEGORY_RANK = {0: 0, 8: 1, 9: 1, 7: 2, 3: 3, 6: 3, 2: 4, 5: 4, 1: 5, 4: 5}


def best_category(hits: DataFrame) -> DataFrame:
    """(spectrum, rank, category, ties): the best rank among a spectrum's hits, the least category that has it, and the
    hits of that rank. Spectra with hits of category 0 alone are left out."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(r)) for c, r in CATEGORY_RANK.items()], F.lit(0))
    by = hits.withColumn("rank", rank).groupBy("spectrum", "rank").agg(F.min("category").alias("category"), F.count("*").alias("ties"))
    best = by.groupBy("spectrum").agg(F.max(F.struct("rank", "category", "ties")).alias("b"))
    return best.where("b.rank > 0").select("spectrum", "b.*")


def evaluate_signal(pred: DataFrame, cleaved: DataFrame, observed: DataFrame, slack: int = 3) -> DataFrame:
    """(score, predicted, accepted, rejected) of predictions (protein, score, cut_pos) by score to two decimals.

    Accepted: the protein is in the set of observed signal cleavages (cleaved: protein); rejected: it is not, and its
    first observed residue (observed: protein, first_pos) lies more than `slack` before the predicted place.
    """
    sure = cleaved.select("protein").distinct().withColumn("sure", F.lit(True))
    rows = pred.join(sure, "protein", "left").join(observed.groupBy("protein").agg(F.min("first_pos").alias("first_pos")), "protein", "left")
    accepted = F.coalesce("sure", F.lit(False))
    rejected = ~accepted & F.coalesce(F.col("cut_pos") - F.col("first_pos") > slack, F.lit(False))
    return rows.groupBy(F.round("score", 2).alias("score")).agg(F.count("*").alias("predicted"), F.count_if(accepted).alias("accepted"), F.count_if(rejected).alias("rejected"))


def observed_column(row: Column, offset: Column) -> Column:
    """Column from 0 of the residue at `offset` (from 0) behind an aligned row's leading gaps; a row of gaps alone
    counts as if its last one were a residue; null for an empty row."""
    lead = F.length(F.regexp_extract(row, "^(-*)", 1))
    return F.when(F.length(row) > 0, F.least(lead, F.length(row) - 1) + offset)


def ortholog_start_check(alignments: DataFrame, observed: DataFrame) -> DataFrame:
    """(cluster, target, column, genome, state) of every aligned row (cluster, genome, row) of clusters in which a
    target's first observed residue is known (observed: cluster, target, offset).

    state: suspect if the row has a gap in that column and only gaps before it, short if the row ends before the column,
    else ok. Targets whose own row is missing or empty give no rows.
    """
    own = alignments.select("cluster", F.col("genome").alias("target"), F.col("row").alias("own"))
    at = observed.join(own, ["cluster", "target"]).select("cluster", "target", observed_column(F.col("own"), F.col("offset")).cast("int").alias("column")).where("column is not null")
    rows = alignments.join(at, "cluster")
    letter = F.substr(F.col("row"), F.col("column") + 1, F.lit(1))
    ahead = F.substr(F.col("row"), F.lit(1), F.col("column"))
    state = F.when(F.col("column") >= F.length("row"), "short").when((letter == "-") & ahead.rlike("^-*$"), "suspect").otherwise("ok")
    return rows.select("cluster", "target", "column", "genome", state.alias("state"))


def missing_genomes(alignments: DataFrame) -> DataFrame:
    """(cluster, genome): genomes of the table that have no member in a cluster. The genomes are one array."""
    every = alignments.agg(F.array_sort(F.collect_set("genome")).alias("every"))  # one row, a name per genome
    have = alignments.groupBy("cluster").agg(F.collect_set("genome").alias("have"))
    return have.join(F.broadcast(every)).select("cluster", F.explode(F.array_except("every", "have")).alias("genome"))
