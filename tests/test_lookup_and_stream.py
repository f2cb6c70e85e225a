"""Bases cut out of chunked contigs, what is read off them, best categories and the resumable consensus."""

import numpy as np
from pyspark.sql import functions as F

from orfspark.operators import genome, spectra, splice
from orfspark.streaming import incremental as I


def test_cut_out_across_borders(spark):
    rng = np.random.default_rng(5)
    contigs = {c: "".join(rng.choice(list("ACGT"), n)) for c, n in (("a", 100), ("b", 30), ("c", 7))}
    segs = [(k, str(rng.choice(list(contigs))), int(x), int(x + rng.integers(0, 60))) for k, x in enumerate(rng.integers(1, 90, 80))] + [(900, "a", -3, 4), (901, "none", 1, 5), (902, "a", 9, 3), (903, "c", 50, 60)]
    chunks = genome.chunked(spark.createDataFrame(list(contigs.items()), "chrom string, seq string"), 12)
    got = {r.k: r.dna for r in genome.cut_out(spark.createDataFrame(segs, "k int, chrom string, start long, stop long"), chunks, ["k"], 12).collect()}
    want = {k: contigs.get(c, "")[max(a, 1) - 1 : z] for k, c, a, z in segs if a <= z}
    assert got == {k: v for k, v in want.items() if v}


def test_genome_match(spark):
    seq = "CC" + "ATGAAACGT" + "TTTTT" + "GGGTGC" + "CC"  # M K R, an intron, G C
    contigs = spark.createDataFrame([("p", seq), ("m", seq[::-1].translate(str.maketrans("ACGT", "TGCA")))], "chrom string, seq string")
    n = len(seq)
    both = [(3, 11), (17, 22)]
    back = [(n - 21, n - 16), (n - 10, n - 2)]
    hits = [(1, "p", "+", both, "MKRGC"), (2, "p", "+", both, "MKKGA"), (3, "m", "-", back, "MKRGC"), (4, "p", "+", both, "KRG"), (5, "p", "+", both, "MKRGCC"), (6, "none", "+", both, "MK")]
    df = spark.createDataFrame(hits, "hit int, chrom string, strand string, segments array<struct<start:long,stop:long>>, aminos string")
    got = {r.hit: (r.genome_aminos, r.mismatches) for r in genome.genome_match(df, genome.chunked(contigs, 6), 6).collect()}
    assert got == {1: ("MKRGC", 0), 2: ("MKRGC", 2), 3: ("MKRGC", 0), 4: ("MKRGC", 0), 5: ("MKRGC", 6), 6: ("", 2)}
    exons = spark.createDataFrame([("g", "p", "+", 1, 12), ("h", "p", "+", 15, 30), ("x", "p", "-", 1, 30)], "gene_id string, chrom string, strand string, start long, stop long")
    proteins = spark.createDataFrame([("g", "AAMKRGC"), ("h", "MKKGAAA"), ("x", "KRG")], "gene_id string, seq string")
    ends = {r.hit: (r.in_protein, r.terminus) for r in genome.protein_match(df, exons, proteins).collect()}
    assert ends == {1: (True, "C"), 2: (True, "N"), 3: (False, ""), 4: (True, ""), 5: (False, ""), 6: (False, "")}


def test_junction_signals(spark):
    seq = "AAACAGGTAAGTCCCCTTTCAGGAAA"
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    shape = "chrom string, strand string, donor long, acceptor long, n long"
    rows = spark.createDataFrame([("c", "+", 6, 23, 1), ("c", "-", 6, 23, 1), ("c", "+", 2, 23, 1), ("d", "+", 6, 23, 1)], shape)
    got = {(r.chrom, r.strand, r.donor): r.signal for r in genome.junction_signals(rows, genome.chunked(contigs, 9), 9).collect()}
    # three bases of the block, six of the intron; three of the intron, one of the next block
    assert got["c", "+", 6] == "CAGGTAAGT" + "CAGG"
    assert got["c", "-", 6] == (seq[5:9] + seq[16:25])[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got["c", "+", 2] is None and got["d", "+", 6] is None


def test_best_category(spark):
    hits = [("a", 1), ("a", 2), ("a", 4), ("b", 0), ("b", 0), ("c", 9), ("c", 7), ("c", 8), ("d", 3), ("d", 6), ("d", 0)]
    got = splice.best_category(spark.createDataFrame(hits, "spectrum string, category int"))
    # 1 and 4 rank alike and above 2; 7 ranks above 8 and 9; a spectrum of nothing but 0 is not reported
    assert sorted((r.spectrum, r["rank"], r.category, r.ties) for r in got.collect()) == [("a", 5, 1, 2), ("c", 2, 7, 1), ("d", 3, 3, 2)]


def test_consensus_goes_on(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(k % 3), int(k), [(float(m), float(i)) for m, i in zip(rng.uniform(0, 20, 15), rng.uniform(0.1, 5, 15), strict=True)]) for k in range(40)]
    shape = "key int, spectrum int, peaks array<struct<mz:double,intensity:double>>"
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, shape).write.mode("append").parquet(source)
        I.run_updates(I.stream_consensus(I.stream_results(spark, source, spark.read.parquet(source).schema), 0.5), out, state)
    got = I.consensus_state(I.latest(spark, out, ["key", "bin"]))
    flat = spark.createDataFrame(rows, shape).select("key", "spectrum", F.explode("peaks").alias("p")).select("key", "spectrum", "p.*")
    digits = lambda df: sorted((r.key, r.bin, round(r.intensity, 9), r.spectra, r.near) for r in df.collect())
    assert digits(got) == digits(spectra.consensus_bins(flat, 0.5))
