"""ORFs, decoys, mapping to the genome, filters, conflicts and calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests, expr as X
from . import ranges


def chunked(contigs: DataFrame, size: int = 30_000) -> DataFrame:
    """(chrom, n, at from 0, seq): (chrom, seq) in chunks of `size` bases (a multiple of 3), each with the two bases that
    follow, dealt over tasks, so that a contig is no task of its own. One pass cuts a contig up."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = contigs.where("seq <> ''").select("chrom", F.length("seq").cast("long").alias("n"), parts.alias("parts"))
    tail = F.transform("parts", lambda c, i: F.concat(c, F.coalesce(F.left(F.get("parts", i + 1), F.lit(2)), F.lit(""))))
    rows = rows.select("chrom", "n", F.posexplode(tail).alias("k", "seq")).select("chrom", "n", (F.col("k").cast("long") * size).alias("at"), "seq")
    return rows.repartition("chrom", "at")


def cut_out(segments: DataFrame, chunks: DataFrame, keys: list[str], size: int = 30_000) -> DataFrame:
    """(keys, dna): the bases of each segment (keys, chrom, start, stop, from 1, both ends in) of contigs in chunks (see
    `chunked`). A segment meets the chunks it lies in by equality; its parts are joined in their order, so it may cross any
    number of borders. Bases beyond a contig are missing; a segment without any gives no row.
    """
    touched = F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.col("stop") - 1) / size))
    rows = segments.where((F.col("start") <= F.col("stop")) & (F.col("stop") >= 1)).select(*keys, F.col("chrom").alias("_c"), "start", "stop", F.explode(touched).alias("_k"))
    met = rows.join(chunks.select(F.col("chrom").alias("_c"), (F.col("at") / size).cast("long").alias("_k"), "at", "seq"), ["_c", "_k"])
    a = F.greatest(F.col("start") - 1 - F.col("at"), F.lit(0))
    z = F.least(F.col("stop") - F.col("at"), F.lit(size))
    part = F.substr("seq", (a + 1).cast("int"), (z - a).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("at", part.alias("p"))))
    return met.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("dna")).where("dna <> ''")


def genome_match(hits: DataFrame, chunks: DataFrame, size: int = 30_000) -> DataFrame:
    """(hit, genome_aminos, mismatches) of hits (hit, chrom, strand, aminos, segments array of (start, stop)): the
    segments' bases in their order, along the strand, translated and compared with the peptide. Sequences of unlike
    length count as many mismatches as the peptide has residues, or none if the genome's holds it."""
    seg = hits.select("hit", "chrom", F.posexplode("segments").alias("no", "s")).select("hit", "chrom", "no", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))
    dna = cut_out(seg, chunks, ["hit", "no"], size).groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("no", "dna"))).alias("p"))
    whole = F.upper(F.array_join(F.transform("p", lambda x: x["dna"]), ""))
    rows = hits.select("hit", "strand", "aminos").join(dna.select("hit", whole.alias("dna")), "hit", "left").withColumn("dna", F.coalesce("dna", F.lit("")))
    rows = rows.withColumn("genome_aminos", X.translate_dna(F.when(F.col("strand") == "-", X.reverse_complement(F.col("dna"))).otherwise(F.col("dna"))))
    unlike = F.size(F.filter(F.zip_with(F.split("aminos", ""), F.split("genome_aminos", ""), lambda x, y: x != y), lambda d: d))
    same = F.length("aminos") == F.length("genome_aminos")
    return rows.select("hit", "genome_aminos", F.when(same, unlike).when(F.contains("genome_aminos", "aminos"), 0).otherwise(F.length("aminos")).alias("mismatches"))


def protein_match(hits: DataFrame, exons: DataFrame, proteins: DataFrame) -> DataFrame:
    """(hit, in_protein, terminus) of hits (as in `genome_match`): whether a gene with an exon around one of the hit's
    segments (exons: gene_id, chrom, strand, start, stop) has a protein (gene_id, seq) that holds the peptide, and if that
    stands at its first (N) or last (C) residue; of several genes the least decides the terminus."""
    seg = hits.select("hit", "chrom", "strand", F.explode("segments").alias("s")).select("hit", "chrom", "strand", F.col("s.start").alias("s_start"), F.col("s.stop").alias("s_stop"))
    genes = ranges.contained_in(seg, exons.select("chrom", "strand", "start", "stop", "gene_id"), ["chrom", "strand"], ("s_start", "s_stop"), ("start", "stop")).select("hit", "gene_id").distinct()
    held = genes.join(proteins.select("gene_id", "seq"), "gene_id").join(hits.select("hit", "aminos"), "hit").where(F.contains("seq", "aminos"))
    end = F.when(F.startswith("seq", "aminos"), "N").when(F.instr("seq", F.col("aminos")) + F.length("aminos") - 1 == F.length("seq"), "C").otherwise("")
    best = held.groupBy("hit").agg(F.min_by(end, "gene_id").alias("terminus"))
    return hits.select("hit").join(best, "hit", "left").select("hit", F.col("terminus").isNotNull().alias("in_protein"), F.coalesce("terminus", F.lit("")).alias("terminus"))


def junction_signals(junctions: DataFrame, chunks: DataFrame, size: int = 30_000) -> DataFrame:
    """Junctions (chrom, strand, donor: last base of a block, acceptor: first of the next, from 1) with their signal of
    13 bases along the strand: three bases of the block and six of the intron, three of the intron and one of the block
    behind it; null where the contig lacks bases."""
    minus = F.col("strand") == "-"
    one = F.struct(F.when(minus, F.col("donor")).otherwise(F.col("donor") - 2).alias("a"), F.when(minus, F.col("donor") + 3).otherwise(F.col("donor") + 6).alias("z"))
    two = F.struct(F.when(minus, F.col("acceptor") - 6).otherwise(F.col("acceptor") - 3).alias("a"), F.when(minus, F.col("acceptor") + 2).otherwise(F.col("acceptor")).alias("z"))
    keys = ["chrom", "strand", "donor", "acceptor"]
    seg = junctions.select(*keys, F.posexplode(F.array(one, two)).alias("no", "s")).select(*[F.col(k).alias(f"j_{k}") for k in keys], "no", "chrom", F.col("s.a").alias("start"), F.col("s.z").alias("stop"))
    named = [f"j_{k}" for k in keys]
    dna = cut_out(seg.where("start >= 1"), chunks, [*named, "no"], size).groupBy(*named).agg(F.array_sort(F.collect_list(F.struct("no", "dna"))).alias("p"))
    whole = F.upper(F.array_join(F.transform("p", lambda x: x["dna"]), ""))
    dna = dna.select(*[F.col(n).alias(k) for n, k in zip(named, keys, strict=True)], whole.alias("w")).where(F.length("w") == 13)
    return junctions.join(dna, keys, "left").withColumn("signal", F.when(minus, X.reverse_complement(F.col("w"))).otherwise(F.col("w"))).drop("w")


def codon_letters() -> np.ndarray:
    """Residue of each code 16a + 4b + c of three bases A, C, G, T; a stop for all above."""
    table = np.full(65, ord("*"), dtype=np.uint8)
    for codon, letter in zip(X.CODONS, X.CODE, strict=True):
        a, b, c = ("ACGT".index(x) for x in codon)
        table[16 * a + 4 * b + c] = ord(letter)
    return table


def base_numbers(seq: str) -> np.ndarray:
    """0 to 3 for A, C, G, T; 64 for any other letter, one per code point."""
    table = np.full(256, 64, dtype=np.int64)
    for i, b in enumerate("ACGT"):
        table[ord(b)] = i
    codes = np.frombuffer(seq.encode("utf-32-le"), dtype=np.uint32)
    return table[np.minimum(codes, 255)]


#: Bases of chunks translated together.
BASES_AT_ONCE = 600_000


def texts_of(letters: np.ndarray, begin: np.ndarray, end: np.ndarray, back: bool) -> pa.StringArray:
    """letters (ASCII) from each begin to its end, read backwards if `back`."""
    to = np.append(0, np.cumsum(end - begin))
    place = np.arange(to[-1]) - np.repeat(to[:-1], end - begin)
    taken = letters[np.repeat(end - 1, end - begin) - place if back else np.repeat(begin, end - begin) + place]
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes()))


def chunk_frames(seqs: list[str], at: np.ndarray, n: np.ndarray, size: int, min_aa: int) -> Iterator[tuple[np.ndarray, str, int, np.ndarray, np.ndarray, pa.StringArray, np.ndarray, np.ndarray]]:
    """(chunks, strand, offset, first codons, last codons, residues, open left, open right) of the stretches between stops
    of each of the six frames of all chunks (their bases, places and contigs' lengths) at once: places of codons on the
    plus strand from 0, residues along the strand; open where the stretch may go on in the chunk before or behind. Closed
    ones have `min_aa` residues at least."""
    letters, b = codon_letters(), base_numbers("".join(seqs))
    length = np.array([len(x) for x in seqs], dtype=np.int64)
    start = np.cumsum(length) - length
    for offset in range(3):
        m = np.maximum(np.minimum(length - offset, size - offset + 2) // 3, 0)
        row, rows = np.repeat(np.arange(len(m)), m), np.flatnonzero(m)
        first = np.cumsum(m) - m  # a chunk's first codon
        place = start[row] + offset + 3 * (np.arange(len(row)) - first[row])
        x, y, z = b[place], b[place + 1], b[place + 2]
        bad = np.maximum(np.maximum(x, y), z) > 3
        for strand, code in (("+", 16 * x + 4 * y + z), ("-", 63 - 16 * z - 4 * y - x)):
            residues = letters[np.where(bad, 64, code)]
            stops = np.flatnonzero(residues == ord("*"))
            # stretches begin with a chunk or behind a stop and end before a stop or with the chunk
            owner = np.append(rows, row[stops])
            begin, end = np.append(first[rows], stops + 1), np.append(first[rows] + m[rows], stops)
            by_begin, by_end = np.lexsort((begin, owner)), np.lexsort((np.append(np.ones(len(rows)), np.zeros(len(stops))), end, owner))
            owner, begin, end = owner[by_begin], begin[by_begin], end[by_end]
            left = (np.append(True, owner[1:] != owner[:-1])[: len(owner)]) & (at[owner] > 0)
            right = (np.append(owner[1:] != owner[:-1], True)[: len(owner)]) & (at[owner] + size < n[owner])
            kept = np.flatnonzero((end - begin >= max(min_aa, 1)) | left | right)
            owner, begin, end, left, right = owner[kept], begin[kept], end[kept], left[kept], right[kept]
            lo = at[owner] + offset + 3 * (begin - first[owner])
            yield owner, strand, offset, lo, lo + 3 * (end - begin - 1), texts_of(residues, begin, end, strand == "-"), left, right


def six_frame(contigs: DataFrame, min_aa: int = 7, size: int = 30_000) -> DataFrame:
    """G1: stop-to-stop ORFs (chrom, strand, frame, start_nuc, length, seq) of (chrom, seq).

    Both strands and three frames of each; start_nuc is the first base of the first codon, counted on the plus strand
    from 1. An unknown codon is a stop. Contigs are translated chunk by chunk, wherever the chunks are; only the open
    ends of chunks, two per frame at most, meet again to be joined, in the order of their places.
    """
    kind = dict(contigs.dtypes)["chrom"]
    shape = f"chrom {kind}, n long, at long, strand string, off int, lo long, hi long, seq string, open_left boolean, open_right boolean"

    def translated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(BASES_AT_ONCE // size, 1)
        for whole in batches:
            for begin in range(0, whole.num_rows, few):
                batch = whole.slice(begin, few)
                at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
                for row, strand, off, lo, hi, seqs, left, right in chunk_frames(batch.column("seq").to_pylist(), at, n, size, min_aa):
                    same = [pa.array([strand] * len(row), pa.string()), pa.array(np.full(len(row), off, np.int32))]
                    cells = [batch.column("chrom").take(pa.array(row)), pa.array(n[row]), pa.array(at[row]), *same, pa.array(lo), pa.array(hi), seqs, pa.array(left), pa.array(right)]
                    yield pa.RecordBatch.from_arrays(cells, ["chrom", "n", "at", "strand", "off", "lo", "hi", "seq", "open_left", "open_right"])

    pieces = ranges.stored(chunked(contigs, size).mapInArrow(translated, shape))
    whole = pieces.where("not open_left and not open_right").select("chrom", "n", "strand", "lo", "hi", "seq")
    # a stretch begins where the left is closed and ends where the right is; those between are of chunks without a stop
    ends = pieces.where("open_left or open_right")
    begun = F.sum((~F.col("open_left")).cast("long")).over(Window.partitionBy("chrom", "strand", "off").orderBy("at", "open_right"))
    parts = ends.withColumn("orf", begun).groupBy("chrom", "n", "strand", "off", "orf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    texts = F.transform("p", lambda x: x["seq"])
    joined = parts.select("chrom", "n", "strand", "lo", "hi", F.array_join(F.when(F.col("strand") == "+", texts).otherwise(F.reverse(texts)), "").alias("seq"))
    rows = whole.unionByName(joined.where(F.length("seq") >= min_aa))
    minus = F.col("strand") == "-"
    frame = F.when(minus, (F.col("n") - F.col("lo") - 3) % 3).otherwise(F.col("lo") % 3) + 1
    return rows.select("chrom", "strand", frame.cast("int").alias("frame"), F.when(minus, F.col("hi") + 3).otherwise(F.col("lo") + 1).alias("start_nuc"), F.length("seq").alias("length"), "seq")


def by_digest(seq: Column, begin: Column) -> Column:
    """The letters of seq in the order of md5(begin followed by their place from 0)."""
    @F.pandas_udf("string")
    def ordered(texts: pd.Series, begins: pd.Series) -> pd.Series:
        return pd.Series(digests.ordered(texts.tolist(), begins.tolist()), dtype=object)

    return ordered(seq, begin)


def decoys(seqs: DataFrame, mode: str = "shuffle", copies: int = 1, avoid_k: int | None = None, tries: int = 10) -> DataFrame:
    """(seq_id, name, seq, copy) with names XXX. or XXX.i. in front.

    shuffle sorts residues by md5 of (seq_id, try, copy, place), so it is the same
    anywhere. avoid_k takes the try with the fewest k-mers (I = L) shared with
    the true sequences.
    """
    many = seqs.select("seq_id", "name", "seq", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    mark = F.when(F.lit(copies) == 1, F.lit("XXX.")).otherwise(F.concat(F.lit("XXX."), F.col("copy"), F.lit(".")))
    if mode == "reverse":
        return many.select("seq_id", F.concat(mark, "name").alias("name"), F.reverse("seq").alias("seq"), "copy")

    def shuffled(t: Column) -> Column:
        return by_digest(F.col("seq"), F.concat_ws(",", F.col("seq_id"), t, F.col("copy"), F.lit("")))

    if not avoid_k:
        return ranges.spread(many).select("seq_id", F.concat(mark, "name").alias("name"), shuffled(F.lit(0)).alias("seq"), "copy")
    tried = ranges.spread(many.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))).withColumn("new", shuffled(F.col("t")))
    true = ranges.kmers(seqs.select(F.translate("seq", "I", "L").alias("seq")), "seq", avoid_k, []).select("kmer").distinct()
    made = ranges.kmers(tried.select("seq_id", "copy", "t", F.translate("new", "I", "L").alias("new")), "new", avoid_k, ["seq_id", "copy", "t"])
    bad = made.join(true, "kmer", "left_semi").groupBy("seq_id", "copy", "t").agg(F.count("*").alias("bad"))
    best = tried.join(bad, ["seq_id", "copy", "t"], "left").groupBy("seq_id", "copy").agg(F.min_by(F.struct("name", "new"), F.struct(F.coalesce("bad", F.lit(0)), F.col("t"))).alias("b"))
    return best.select("seq_id", F.concat(mark, "b.name").alias("name"), F.col("b.new").alias("seq"), "copy")


def digest(seqs: DataFrame, missed: int = 1, shortest: int = 6, longest: int = 40) -> DataFrame:
    """Tryptic peptides (seq_id, pos from 1, aminos) with up to `missed` uncut sites.

    A piece ends behind K or R that no P follows; its place is the number of residues ahead of it, a running sum over
    the sequence's pieces, of which only those up to `longest` residues and the `missed` ones behind them are joined.
    """
    cut = F.posexplode(F.filter(F.split("seq", r"(?<=[KR])(?!P)"), lambda p: p != "")).alias("i", "piece")
    rows = seqs.select("seq_id", cut)
    w = Window.partitionBy("seq_id").orderBy("i")
    before = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.collect_list("piece").over(w.rowsBetween(0, missed))
    rows = rows.select("seq_id", (before + 1).cast("int").alias("pos"), ahead.alias("p"))
    joined = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), ""))
    fit = F.filter(joined, lambda x: F.length(x).between(shortest, longest))
    return rows.select("seq_id", "pos", F.explode(fit).alias("aminos"))


def fabricate(seqs: DataFrame, n: int = 20_000, shortest: int = 100, longest: int = 1000, suppressed: dict[str, float] | None = None) -> DataFrame:
    """N random proteins (seq_id, seq) with the residue frequencies of seqs, from hashes of (protein, place).

    suppressed: letters and the share of their frequency that stays.
    """
    spark = seqs.sparkSession
    counts = seqs.select(F.explode(X.letters(F.col("seq"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    for letter_, share in (suppressed or {}).items():
        counts = counts.withColumn("n", F.when(F.col("c") == letter_, F.col("n") * share).otherwise(F.col("n")))
    counts = counts.where("n > 0")
    w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)  # an alphabet's rows
    steps = counts.withColumn("to", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0)))).agg(F.array_sort(F.collect_list(F.struct("to", "c"))).alias("steps"))
    unit = lambda *cs: F.pmod(F.xxhash64(*cs), F.lit(1 << 40)) / float(1 << 40)
    made = spark.range(n).select(F.col("id").alias("seq_id"), (shortest + F.floor(unit("id", F.lit(-1)) * (longest - shortest))).cast("int").alias("n")).join(F.broadcast(steps))  # one row
    letter = lambda i: F.element_at(F.filter("steps", lambda s: s["to"] > unit("seq_id", i)), 1)["c"]
    return made.select("seq_id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), letter), "").alias("seq"))


def link_orfs_to_cds(orfs: DataFrame, cds: DataFrame, use_strand: bool = True) -> DataFrame:
    """Left join on the 3' end; kind is simple (one CDS), complex (several), other (none)."""
    def end(df: DataFrame) -> DataFrame:
        return df.withColumn("_e", X.three_prime(F.col("start"), F.col("stop"), F.col("strand")))

    keys = ["chrom", "_e"] + (["strand"] if use_strand else [])
    named = end(cds).select(*keys, "protein_id", F.col("start").alias("protein_start"), F.col("stop").alias("protein_stop"))
    best = named.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(F.struct("protein_id", "protein_start", "protein_stop"), "protein_id").alias("_p"))
    kind = F.when(F.col("_n").isNull(), "other").when(F.col("_n") == 1, "simple").otherwise("complex")
    return end(orfs).join(best, keys, "left").withColumn("kind", kind).select(*orfs.columns, "kind", "_p.protein_id", "_p.protein_start", "_p.protein_stop")


def overlaps(orfs: DataFrame, width: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, bp) of overlapping ORFs of a contig, one of them with evidence; bp = stop - start of the overlap.
    Columns of the ORFs to `carry` come along as a_... and b_..., so that pairs need no join to have them."""
    side = lambda m: orfs.select("chrom", F.col("orf_name").alias(m), F.col("start").alias(f"{m}_start"), F.col("stop").alias(f"{m}_stop"), F.col("spectra").alias(f"{m}_n"), *[F.col(c).alias(f"{m}_{c}") for c in carry if c not in ("start", "stop")])
    met = ranges.overlap_join(side("a"), side("b"), ["chrom"], ("a_start", "a_stop"), ("b_start", "b_stop"), width)
    bp = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    return met.where("a < b and (a_n > 0 or b_n > 0)").select("chrom", "a", "b", bp.alias("bp"), "a_n", "b_n", *[f"{m}_{c}" for m in "ab" for c in carry])


def five_prime_keys(df: DataFrame) -> list[Column]:
    """O2: sort keys along the strand."""
    minus = F.col("strand") == "-"
    return [F.when(minus, -F.col("stop")).otherwise(F.col("start")), F.when(minus, -F.col("start")).otherwise(F.col("stop"))]


def genomic_sort(df: DataFrame) -> DataFrame:
    """O1."""
    return df.orderBy("chrom", "start", "stop")


def drop_isolated(located: DataFrame, far: int = 750) -> DataFrame:
    """Drop peptides farther than `far` from both neighbours along the ORF's strand; a lone peptide goes."""
    w = Window.partitionBy("orf_name").orderBy(*five_prime_keys(located), "aminos")
    before = F.abs(F.col("start") - F.lag("stop").over(w))
    after = F.abs(F.lead("start").over(w) - F.col("stop"))
    isolated = F.coalesce(before > far, F.lit(True)) & F.coalesce(after > far, F.lit(True))
    return located.withColumn("_i", isolated).where(~F.col("_i")).drop("_i")


def first_peptide(located: DataFrame, unique_only: bool = False) -> DataFrame:
    """The 5'-most (unique) peptide of each ORF."""
    rows = located.where("is_unique") if unique_only else located
    along = F.struct(*five_prime_keys(located), F.col("aminos"))
    return rows.groupBy("orf_name").agg(F.min_by(F.struct("aminos", "start", "stop", "strand"), along).alias("p")).select("orf_name", "p.*")


def observed_region(located: DataFrame, orfs: DataFrame, unique_only: bool = False) -> DataFrame:
    """(orf_name, start, stop): from the 5'-most (unique) peptide to the ORF's stop, along the strand."""
    first = first_peptide(located, unique_only).select("orf_name", F.col("start").alias("_a"), F.col("stop").alias("_z"))
    minus = F.col("strand") == "-"
    return orfs.join(first, "orf_name").select("orf_name", F.when(minus, F.col("start")).otherwise(F.col("_a")).alias("start"), F.when(minus, F.col("_z")).otherwise(F.col("stop")).alias("stop"))


def filter_orfs(located: DataFrame, least: int = 2, far: int = 750) -> DataFrame:
    """(orf_name, killed_by, peptides) of the filter chain complexity, distance, unique, tryptic, peptides.

    The first filter that an ORF fails names killed_by; null is a pass.
    """
    names = located.select("orf_name").distinct()
    rich = located.where(~X.low_complexity(F.col("aminos")))
    near = drop_isolated(rich, far)
    after = lambda df, name: df.groupBy("orf_name").agg(F.count("*").alias(name))
    state = near.groupBy("orf_name").agg(F.count("*").alias("n_near"), F.max(F.col("is_unique").cast("int")).alias("unique"), F.max((F.col("tryptic_n") & F.col("tryptic_c")).cast("int")).alias("tryptic"), F.count_distinct("aminos").alias("peptides"))
    joined = names.join(after(rich, "n_rich"), "orf_name", "left").join(state, "orf_name", "left")
    killed = F.when(F.col("n_rich").isNull(), "complexity").when(F.col("n_near").isNull(), "distance").when(F.col("unique") == 0, "unique").when(F.col("tryptic") == 0, "tryptic").when(F.col("peptides") < least, "min_peptides")
    return joined.select("orf_name", killed.alias("killed_by"), F.coalesce("peptides", F.lit(0)).alias("peptides"))


def conflicts(orfs: DataFrame) -> DataFrame:
    """Overlapping pairs with a level: 1 below 10 bp, 2 below 40, 3 the unsupported side is hypothetical,
    4 it is named, 5 both have evidence but none in the overlap, 6 both have evidence there.

    orfs: chrom, orf_name, start, stop, spectra, named, seen_start, seen_stop (hull of the evidence).
    Level 0 (no overlap) is counted by `free_pairs`.
    """
    full = overlaps(orfs, carry=("start", "stop", "named", "seen_start", "seen_stop"))
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop")
    inside = lambda m: (F.col(f"{m}_seen_start") <= hi) & (F.col(f"{m}_seen_stop") >= lo)
    weak_named = F.when(F.col("a_n") > 0, F.col("b_named")).otherwise(F.col("a_named"))
    level = F.when(F.col("bp") < 10, 1).when(F.col("bp") < 40, 2).when((F.col("a_n") == 0) | (F.col("b_n") == 0), F.when(weak_named, 4).otherwise(3)).when(inside("a") & inside("b"), 6).otherwise(5)
    return full.select("chrom", "a", "b", "bp", level.alias("level"))


def free_pairs(orfs: DataFrame, found: DataFrame) -> DataFrame:
    """P2, level 0: (chrom, pairs) of ORFs, one with evidence, that do not overlap; by arithmetic, not by pairing."""
    n = orfs.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("spectra") == 0).alias("u"))
    hit = found.groupBy("chrom").agg(F.count("*").alias("hit"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return n.join(hit, "chrom", "left").select("chrom", (two("n") - two("u") - F.coalesce("hit", F.lit(0))).cast("long").alias("pairs"))


def call_structure(orfs: DataFrame, located: DataFrame) -> DataFrame:
    """(orf_name, protein_id, ahead, call): NOVEL without a protein; UNDERPREDICTED if the first unique peptide starts
    more than 3 nt upstream of the protein, or at its start without M; else OK, also without a unique peptide; NO EVIDENCE
    without any peptide."""
    first = first_peptide(located, True).select("orf_name", F.col("aminos").alias("p_aminos"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"))
    seen = located.select("orf_name").distinct().withColumn("seen", F.lit(True))
    rows = orfs.join(first, "orf_name", "left").join(seen, "orf_name", "left")
    ahead = F.when(F.col("strand") == "-", F.col("p_stop") - F.col("protein_stop")).otherwise(F.col("protein_start") - F.col("p_start"))
    call = F.when(F.col("seen").isNull(), "NO EVIDENCE").when(F.col("protein_id").isNull(), "NOVEL").when((ahead > 3) | ((ahead == 0) & ~F.col("p_aminos").startswith("M")), "UNDERPREDICTED").otherwise("OK")
    return rows.select("orf_name", "protein_id", ahead.alias("ahead"), call.alias("call"))


def short_proteins(orfs: DataFrame, longest: int = 100) -> DataFrame:
    """(orf_name, protein_id, residues) of ORFs with a protein of at most `longest` residues (its stop codon is none)."""
    residues = F.floor((F.col("protein_stop") - F.col("protein_start") + 1) / 3) - 1
    return orfs.where("protein_id is not null").select("orf_name", "protein_id", residues.alias("residues")).where(F.col("residues") <= longest)


def upstream_starts(orfs: DataFrame) -> DataFrame:
    """(orf_name, at, codon) of in-frame ATG, GTG, TTG from the ORF's first base up to its first peptide.

    orfs: orf_name, dna (along the strand), until (0-based offset of the first
    peptide). At the first position only ATG counts.
    """
    rows = orfs.where("until >= 0").select("orf_name", F.posexplode(X.codons(F.substr(F.col("dna"), F.lit(1), (F.floor(F.col("until") / 3) * 3 + 3).cast("int")))).alias("k", "codon"))
    rows = rows.select("orf_name", (F.col("k") * 3).alias("at"), "codon")
    return rows.where("codon = 'ATG' or (at > 0 and codon in ('GTG', 'TTG'))")


def corrected_starts(starts: DataFrame) -> DataFrame:
    """ORFs with exactly one candidate start."""
    n = starts.groupBy("orf_name").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("codon").alias("codon"))
    return n.where("n = 1").select("orf_name", "at", "codon")


def signal_peptides(rows: DataFrame) -> DataFrame:
    """Decision 0-5 of (orf_name, prefix: residues from the protein's annotated start up to the first unique peptide,
    tryptic_n).

    0 tryptic, 1 shorter than 15, 2 longer than 50, 3 no hydrophobic patch, 4 patch, 5 patch, motif and a basic residue
    before the patch (the first three residues of its first stretch of five included).
    """
    n, prefix = F.length("prefix"), F.col("prefix")
    at = X.hydrophobic_patch(X.hydropathy_plot(prefix))
    patch, basic = at >= 0, F.substr(prefix, F.lit(1), at + 3).rlike("[KR]")
    d = F.when(F.col("tryptic_n"), 0).when(n < 15, 1).when(n > 50, 2).when(~patch, 3).when(X.signal_motif(prefix) & basic, 5).otherwise(4)
    return rows.select("orf_name", d.alias("decision"))


def n_terminal(mapped: DataFrame, least: int = 2) -> DataFrame:
    """P5: first observed residue of each protein with `least` peptides; after_met if the one before it is an initial M."""
    first = mapped.groupBy("seq_id").agg(F.min("pos").alias("first_pos"), F.count_distinct("aminos").alias("peptides"), F.min_by("prefix", "pos").alias("before"))
    return first.where(F.col("peptides") >= least).select("seq_id", "first_pos", "peptides", ((F.col("first_pos") == 2) & (F.col("before") == "M")).alias("after_met"))


def n_terminal_evidence(mapped: DataFrame, sequences: DataFrame, least: int = 2, reach: int = 5) -> DataFrame:
    """P5: `n_terminal` with start_met (the protein begins with M and is seen from there), the motif area (up to
    `reach` residues on either side of the first observed place), and whether the residues ahead of it hold a
    hydrophobic patch and end in the cleavage motif."""
    rows = n_terminal(mapped, least).join(sequences.select("seq_id", "seq"), "seq_id")
    ahead = F.substr(F.col("seq"), F.lit(1), F.col("first_pos") - 1)
    begin = F.greatest(F.col("first_pos") - reach, F.lit(1))
    area = F.concat(F.substr(F.col("seq"), begin, F.col("first_pos") - begin), F.lit(":"), F.substr(F.col("seq"), F.col("first_pos"), F.lit(reach)))
    start_met = (F.col("first_pos") == 1) & F.col("seq").startswith("M")
    return rows.select("seq_id", "first_pos", "peptides", "after_met", start_met.alias("start_met"), area.alias("area"), X.signal_motif(ahead).alias("motif"), (X.hydrophobic_patch(X.hydropathy_plot(ahead)) >= 0).alias("patch"))


def cleavages(mapped: DataFrame) -> DataFrame:
    """(seq_id, pos, cuts, over, cover_n, cover_c, before, at): places where unique peptides begin or (one behind
    their last residue) end, with the spectra that end or begin there, those that run over the place, and those over
    the residues on either side (before, at: the letters; null outside). mapped may have spectra (else one a row)."""
    spectra = F.col("spectra") if "spectra" in mapped.columns else F.lit(1)
    good = mapped.where("is_unique").select("seq_id", "pos", F.length("aminos").alias("n"), "aminos", "prefix", "suffix", spectra.alias("spectra"))
    letter = lambda i: F.substr(F.col("aminos"), i, F.lit(1))
    begin = good.select("seq_id", "pos", "spectra", F.col("prefix").alias("before"), letter(F.lit(1)).alias("at"))
    end = good.select("seq_id", (F.col("pos") + F.col("n")).alias("pos"), "spectra", letter(F.col("n")).alias("before"), F.col("suffix").alias("at"))
    cuts = begin.unionByName(end).groupBy("seq_id", "pos").agg(F.sum("spectra").alias("cuts"), F.first("before", True).alias("before"), F.first("at", True).alias("at"))

    def depth(first: Column, last: Column) -> DataFrame:
        spans = good.select("seq_id", first.alias("start"), last.alias("stop"), "spectra").where("start <= stop")
        ends = spans.select("seq_id", F.col("start").alias("x"), F.col("spectra").alias("d")).unionByName(spans.select("seq_id", (F.col("stop") + 1).alias("x"), (-F.col("spectra")).alias("d")))
        return ends.groupBy("seq_id", "x").agg(F.sum("d").alias("d"))

    def at(points: DataFrame, steps: DataFrame, shift: int, name: str) -> DataFrame:
        """The running sum of steps at each point (moved by shift): points and steps of a sequence in one order."""
        rows = points.select("seq_id", (F.col("pos") + shift).alias("x"), F.lit(0).cast("long").alias("d"), "pos").unionByName(steps.select("seq_id", "x", F.col("d").cast("long").alias("d"), F.lit(None).cast("int").alias("pos")))
        dealt = ranges.carried(ranges.placed(rows, ["seq_id"], ["x"]), ["seq_id"], _before=(F.sum("d"), F.sum))
        total = F.sum("d").over(ranges.inside(["seq_id"], ["x"]).rangeBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
        return dealt.withColumn(name, total).where("pos is not null").select("seq_id", "pos", name)

    cuts = ranges.stored(cuts)
    whole, open_ = ranges.stored(depth(F.col("pos"), F.col("pos") + F.col("n") - 1)), depth(F.col("pos") + 1, F.col("pos") + F.col("n") - 1)
    out = cuts
    for steps, shift, name in ((open_, 0, "over"), (whole, -1, "cover_n"), (whole, 0, "cover_c")):
        out = out.join(at(cuts, steps, shift, name), ["seq_id", "pos"])
    return out


def categorized_endpoints(cuts: DataFrame, rate: float = 0.1, least: int = 2, signal: int = 50) -> DataFrame:
    """`cleavages` with rate cuts / (cuts + over) and count at the cuts' limits: Trypsin, C-term, N-term, Met, Signal
    (within `signal` residues, the side ahead seen in a tenth of the spectra behind), Other."""
    share = F.col("cuts") / (F.col("cuts") + F.col("over"))
    tryptic = F.col("before").isin("K", "R") & (F.coalesce("at", F.lit("*")) != "P")
    kind = F.when(tryptic, "Trypsin").when(F.col("at").isNull() | F.col("at").isin("X", "*", "O", "U"), "C-term").when(F.col("pos") == 1, "N-term").when(F.col("pos") == 2, "Met")
    kind = kind.when((F.col("pos") <= signal) & (F.col("cover_n") < F.col("cover_c") * 0.1), "Signal").otherwise("Other")
    return cuts.withColumn("rate", share).where((F.col("rate") >= rate) & (F.col("cuts") >= least)).withColumn("kind", kind)


def cleavage_classes(cuts: DataFrame, least: int = 5) -> DataFrame:
    """Places with `least` cuts or more: Tryptic, Stop, Decay (a neighbour is cut more often), Suffix (a tenth of the
    spectra go on behind), Prefix (a tenth came before), Internal."""
    rows = neighbour_counts(cuts.select("seq_id", "pos", "cuts")).select("seq_id", "pos", "decay")
    both = cuts.join(rows, ["seq_id", "pos"]).where(F.col("cuts") >= least)
    tryptic = F.col("before").isin("K", "R") & (F.coalesce("at", F.lit("*")) != "P")
    stop = F.col("at").isNull() | F.col("at").isin("X", "*") | (F.col("at").isin("U", "O") & (F.col("cover_c") < 5))
    kind = F.when(tryptic, "Tryptic").when(stop, "Stop").when(F.col("decay"), "Decay")
    return both.withColumn("kind", kind.when(F.col("cover_c") < F.col("cover_n") * 0.1, "Suffix").when(F.col("cover_n") < F.col("cover_c") * 0.1, "Prefix").otherwise("Internal")).drop("decay")


def endpoints(mapped: DataFrame, rate: float = 0.1, least: int = 2) -> DataFrame:
    """N-side cuts (seq_id, pos, cuts, over, kind) of unique peptides with cuts >= least and cuts / (cuts + uncut
    spectra over the place) >= rate."""
    good = mapped.where("is_unique")
    cuts = good.groupBy("seq_id", "pos").agg(F.count("*").alias("cuts"), F.first("prefix").alias("prefix"))
    spans = good.where(F.length("aminos") > 1).select("seq_id", (F.col("pos") + 1).alias("start"), (F.col("pos") + F.length("aminos") - 1).alias("stop"))
    depth = ranges.coverage_of(spans, ["seq_id"], "start", "stop").select("seq_id", F.col("start").alias("_a"), F.col("stop").alias("_z"), "n")
    points = cuts.select("seq_id", "cuts", "prefix", F.col("pos").alias("p"), F.col("pos").alias("q"))
    over = ranges.overlap_join(points, depth, ["seq_id"], ("p", "q"), ("_a", "_z"), 200).groupBy("seq_id", "p").agg(F.sum("n").alias("over"))
    kind = F.when(F.col("p") == 1, "N-term").when((F.col("p") == 2) & (F.col("prefix") == "M"), "Met").when(F.col("prefix").isin("K", "R"), "Trypsin").when(F.col("p").between(15, 50), "Signal").otherwise("Other")
    rows = points.join(over, ["seq_id", "p"], "left").select("seq_id", F.col("p").alias("pos"), "cuts", F.coalesce("over", F.lit(0)).alias("over"), kind.alias("kind"))
    return rows.where((F.col("cuts") >= least) & (F.col("cuts") / (F.col("cuts") + F.col("over")) >= rate))


def neighbour_counts(cuts: DataFrame) -> DataFrame:
    """Cuts of the neighbouring positions (0 if none); decay if they fall off on either side."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    near = lambda f, d: F.when(f("pos").over(w) == F.col("pos") + d, f("cuts").over(w)).otherwise(0)
    rows = cuts.withColumn("before", near(F.lag, -1)).withColumn("after", near(F.lead, 1))
    return rows.withColumn("decay", (F.col("before") > F.col("cuts")) | (F.col("after") > F.col("cuts")))


def novel_peptides(mapped_new: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """Rows of (aminos, ...) that stand in no known sequence (seq_id, seq)."""
    return mapped_new.join(ranges.map_peptides(mapped_new, known, k).select("aminos").distinct(), "aminos", "left_anti")


def augment(db: DataFrame, extra: DataFrame, k: int = 5) -> DataFrame:
    """Db and those extra sequences that are in no sequence of db."""
    held = ranges.map_peptides(extra.select(F.col("seq").alias("aminos")), db, k).select(F.col("aminos").alias("seq")).distinct()
    return db.select("seq_id", "seq").unionByName(extra.select("seq_id", "seq").join(held, "seq", "left_anti"))


def splice_novelty(old: DataFrame, new: DataFrame) -> DataFrame:
    """New peptides not among the old ones (I = L, Q = K), flagged when an old one shares their first or last half."""
    canon = lambda df: df.groupBy(X.canonical_il(F.col("aminos")).alias("c")).agg(F.min("aminos").alias("aminos"))
    fresh = canon(new).join(canon(old), "c", "left_anti")
    half = F.greatest(F.floor(F.length("c") / 2), F.lit(1)).cast("int")
    halves = fresh.select("aminos", F.explode(F.array(F.substr(F.col("c"), F.lit(1), half), F.substr(F.col("c"), F.length("c") - half + 1))).alias("aminos_half"))
    places = ranges.map_peptides(halves.select(F.col("aminos_half").alias("aminos")), canon(old).select(F.col("c").alias("seq_id"), F.col("c").alias("seq")), 3)
    near = halves.join(places.select(F.col("aminos").alias("aminos_half")).distinct(), "aminos_half", "left_semi").select("aminos", F.lit(True).alias("half_known")).distinct()
    return fresh.select("aminos").join(near, "aminos", "left").withColumn("half_known", F.coalesce("half_known", F.lit(False)))


def context_stats(starts: DataFrame) -> DataFrame:
    """(context, n, mean_gc, mean_length) of (context, dna)."""
    return starts.groupBy("context").agg(F.count("*").alias("n"), F.avg(X.gc_percent(F.col("dna"))).alias("mean_gc"), F.avg(F.length("dna")).alias("mean_length"))


def context_codons(starts: DataFrame) -> DataFrame:
    """(context, codon, n, share) over whole codons of (context, dna)."""
    n = starts.select("context", F.explode(X.codons(F.col("dna"))).alias("codon")).groupBy("context", "codon").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("context")))


def codon_usage(dna: DataFrame) -> DataFrame:
    """(chrom, codon, n) over whole codons."""
    return dna.select("chrom", F.explode(X.codons(F.col("seq"))).alias("codon")).groupBy("chrom", "codon").agg(F.count("*").alias("n"))
