"""Whole runs and the operators that compose them, on small inputs."""

import random

from pyspark.sql import functions as F

from orfspark.functions import expr as X
from orfspark.operators import genome, inference, psm as P, ptm, ranges, spectra, splice
from orfspark.plans import pipelines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def contig(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_run_all_finds_a_planted_gene(spark):
    r = random.Random(9)
    codon = {a: c for c, a in zip(X.CODONS, X.CODE, strict=True) if a != "*"}
    protein = "M" + "".join("".join(r.choice("ADEFGHILNQSTVY") for _ in range(9)) + "K" for _ in range(6))
    dna = contig(1, 301) + "TAA" + "".join(codon[a] for a in protein) + "TAA" + contig(2, 200)
    contigs = spark.createDataFrame([("c", dna)], "chrom string, seq string")
    pieces = [x for x in [protein[i : i + 10] for i in range(1, 61, 10)]]
    hits = [("f", i, 1, pieces[i % 6], 2, 5.0 + i % 3, 0.5, False, 10.0, "p") for i in range(60)] + [("f", 100 + i, 1, "WWWWCCCCK", 2, -1.0, 0.0, True, 9.0, "XXX") for i in range(20)]
    psm = spark.createDataFrame(hits, "spectrum_file string, scan int, rank int, aminos string, charge int, mq_score double, delta double, is_decoy boolean, length double, protein string").withColumn("p_value", F.lit(0.5))
    start = dna.index("TAA" + codon["M"]) + 4
    none = spark.createDataFrame([], "chrom string, start long, stop long, strand string, protein_id string")
    out = pipelines.run_all(contigs, psm, none, 0.5)
    call = [(x.call, x.protein_id) for x in out["calls"].collect()]
    assert call == [("NOVEL", None)]
    report = out["report"].first()
    assert (report.true_peptides, report.decoy_peptides, report.mapped_peptides, report.novel, report.wrong_start) == (6, 1, 6, 1, 0)
    gene = spark.createDataFrame([("c", start + 30, start + 3 * len(protein) + 2, "+", "g")], "chrom string, start long, stop long, strand string, protein_id string")
    assert [x.call for x in pipelines.run_all(contigs, psm, gene, 0.5)["calls"].collect()] == ["UNDERPREDICTED"]


def test_run_ptm_keeps_sites_and_names_known_ones(spark):
    r = random.Random(3)
    data = []
    for i in range(120):
        decoy = i % 4 == 0
        for k in range(3):
            data.append((f"f{i % 3}", 10 * i + k, 1, f"A{i}", f"K.A{i}+16.R", 2, r.gauss(0 if decoy else 4, 1), 0.1 if decoy else 0.4, decoy, 10.0, i % 2 == 0, i, 16, "M", 0.5))
    psm = spark.createDataFrame(data, "spectrum_file string, scan int, rank int, aminos string, annotation string, charge int, mq_score double, delta double, is_decoy boolean, length double, is_modified boolean, db_pos long, mass int, residue string, p_value double")
    known = spark.createDataFrame([("1:16", 57, 1e-12)], "site string, known_mass int, known_p double")
    out = pipelines.run_ptm(psm, 0.1, known=known)
    counts = {(x.mass, x.residue): x.sites for x in out["counts"].collect()}
    assert 60 <= counts[16, "M"] <= 95 and counts[57, "M"] == 1
    assert {x["class"] for x in out["classes"].collect()} == {"adduct"} and out["unknown"].count() == 0


def test_choose_known_leaves_sites_without_one(spark):
    sites = spark.createDataFrame([("a", 16, 0.01), ("b", 16, 0.01), ("c", 16, 0.01)], "site string, mass int, p double")
    known = spark.createDataFrame([("a", 42, 0.012), ("b", 42, 0.5)], "site string, known_mass int, known_p double")
    assert rows(ptm.choose_known(sites, known)) == [("a", 42, 0.012, True), ("b", 16, 0.01, False), ("c", 16, 0.01, False)]


def test_ranges_hand_their_state_on(spark):
    """Many ranges of one key against plain loops."""
    r = random.Random(7)
    iv = sorted((s, s + r.randint(0, 60), i) for i in range(400) for s in [r.randint(0, 9000)])
    df = spark.createDataFrame([("k", *x) for x in iv], "k string, s long, e long, i long").repartition(7)
    want, far, no = {}, None, 0
    for s, e, i in iv:
        no += far is None or s - far > 5
        far = e if far is None else max(far, e)
        want[i] = no
    assert {x.i: x.group_no for x in ranges.group_by_gap(df, ["k"], "s", "e", 5, ["i"]).collect()} == want
    depth = {p: n for _, a, z, n in rows(ranges.coverage_of(df, ["k"], "s", "e")) for p in range(a, z + 1)}
    assert depth == {p: n for p in range(0, 9100) if (n := sum(a <= p <= z for a, z, _ in iv))}
    pieces = rows(ranges.split_disjoint(df, ["k"], "s", "e").select("start", "stop", "n", "piece", "next_piece"))
    assert [p[3] for p in pieces] == list(range(1, len(pieces) + 1))
    assert all(nxt == (x[3] + 1 if i + 1 < len(pieces) and pieces[i + 1][0] == x[1] + 1 else None) for i, x in enumerate(pieces) for nxt in [x[4]])
    counts = spark.createDataFrame([("k", p, n) for p, n in depth.items()], "k string, pos long, n int").repartition(5)
    runs, last = [], None
    for p, n in sorted(depth.items()):
        if n > 1:
            if last == p - 1:
                runs[-1] = (runs[-1][0], p, max(runs[-1][2], n))
            else:
                runs.append((p, p, n))
            last = p
    assert rows(ranges.runs_above(counts, ["k"], "pos", "n", 1).select("start", "stop", "top")) == runs


def test_select_proteins_by_rounds_equals_one_at_a_time(spark):
    r = random.Random(6)
    pairs = spark.createDataFrame(sorted({(r.randint(0, 60), r.randint(0, 25), 1 + r.randint(0, 3)) for _ in range(260)}), "aminos long, protein long, spectra long")
    owners = lambda n: {x.aminos: x.protein for x in inference.select_proteins(pairs, task_pairs=n).collect()}
    assert owners(0) == owners(10**6) == owners(100)
    assert inference.select_proteins(pairs.limit(0)).count() == 0


def test_cleavages_equal_loops(spark):
    seq = "MAAKRCCCKPDDDDKEEEE"
    peptides = ["AAK", "AAKR", "CCCKPDDDDK", "EEEE", "RCCCKPDDDDK"]
    mapped = ranges.map_peptides(spark.createDataFrame([(p,) for p in peptides], "aminos string"), spark.createDataFrame([(1, seq)], "seq_id long, seq string"))
    got = {x.pos: (x.cuts, x.over, x.cover_n, x.cover_c, x.before, x["at"]) for x in genome.cleavages(mapped).collect()}
    at = [(seq.index(p) + 1, seq.index(p) + 1 + len(p)) for p in peptides]
    for p in {x for a in at for x in a}:
        cuts = sum(p in a for a in at)
        inside = lambda x: sum(a <= x < z for a, z in at)
        assert got[p] == (cuts, sum(a < p < z for a, z in at), inside(p - 1), inside(p), seq[p - 2] if p > 1 else None, seq[p - 1] if p <= len(seq) else None)
    kinds = {x.pos: x.kind for x in genome.categorized_endpoints(genome.cleavages(mapped), 0.1, 1).collect()}
    assert kinds[2] == "Met" and kinds[6] == "Trypsin" and kinds[20] == "C-term"


def test_three_segments_and_neighbours(spark):
    exons = spark.createDataFrame([("g", "c", "+", 1, 10), ("g", "c", "+", 20, 30), ("g", "c", "+", 40, 50)], "gene_id string, chrom string, strand string, start long, stop long")
    seg = "hit int, chrom string, strand string, segments array<struct<start:long,stop:long>>, p_value double, length int, mismatches int, in_protein boolean"
    hits = [(1, "c", "+", [(5, 10), (20, 30), (40, 44)], 0.01, 9, 0, False), (2, "c", "+", [(5, 10), (20, 30), (40, 44)], 0.01, 9, 0, True), (3, "c", "+", [(5, 10), (21, 29), (60, 70)], 0.01, 9, 0, False), (4, "c", "+", [(1, 2)] * 4, 0.01, 9, 0, True)]
    assert rows(splice.categorize_hits(spark.createDataFrame(hits, seg), exons)) == [(1, 5), (2, 4), (3, 6), (4, 9)]
    genes = spark.createDataFrame([("c", 1, 10, "a"), ("c", 50, 60, "b"), ("c", 15, 18, "d")], "chrom string, start long, stop long, gene_id string")
    near = splice.nearest_genes(spark.createDataFrame([(1, "c", 20, 30), (2, "c", 5, 9), (3, "x", 1, 2)], "hit int, chrom string, start long, stop long"), genes)
    assert rows(near.na.fill("-")) == [(1, "d", "b"), (2, "-", "d"), (3, "-", "-")]


def test_shifted_peaks_and_open_search(spark):
    target, mod = "PEPTIDEK", 42.0
    pt = F.array(F.struct(F.lit(3).alias("pos"), F.lit(mod).alias("mass")))
    heavy = [i.mz for i in spark.range(1).select(X.fragment_ions(F.lit(target), pt).alias("i")).first().i if i.series in ("b", "y")]
    bare = sorted(i.mz for i in spark.range(1).select(X.fragment_ions(F.lit(target)).alias("i")).first().i if i.series in ("b", "y"))
    peaks = spark.createDataFrame([(1, mz, 1.0) for mz in heavy], "spectrum long, mz double, intensity double")
    moved = spectra.shifted_peaks(peaks, spark.createDataFrame([(1, target, 3, mod)], "spectrum long, aminos string, mod_pos int, mod_mass double"), 0.01)
    assert all(abs(a - b) < 1e-6 for a, b in zip(sorted(r.mz for r in moved.collect()), bare, strict=True))
    mass = spark.range(1).select(X.parent_mass_of(F.lit(target))).first()[0] + mod
    peptides = spark.createDataFrame([(p,) for p in (target, "WWWWK", "EDITPEPK")], "aminos string")
    best = spectra.open_search(spark.createDataFrame([(1, mass)], "spectrum long, mass double"), peaks, peptides).where("place = 1").first()
    assert best.aminos == target and abs(best.delta_mass - mod) < 1e-6 and best.shared == len(heavy)


def test_presence_scales_large_keys(spark):
    peaks = [("k", s, 100.0, 5.0) for s in range(8)] + [("k", s, 300.0, 5.0) for s in range(2)]
    df = spark.createDataFrame(peaks, "key string, spectrum int, mz double, intensity double")
    bins, sizes = spectra.consensus_bins(df), spark.createDataFrame([("k", 8)], "key string, size int")
    plain = {round(r.mz): r.intensity for r in spectra.consensus(bins).collect()}
    scaled = {round(r.mz): r.intensity for r in spectra.consensus(bins, sizes=sizes).collect()}
    assert abs(scaled[100] - plain[100]) < 1e-9 and abs(scaled[300] - plain[300] * 0.25) < 1e-9


def test_explain_ptm_by_terminus_and_base(spark):
    sites = spark.createDataFrame([("a", "K", 42.0, "N", None), ("b", "K", 42.0, None, None), ("c", "C", -57.0, None, 57.0)], "site string, residue string, mass double, terminus string, base double")
    mods = spark.createDataFrame([(42.0, None, "acetyl (end)", "N"), (42.0, "K", "acetyl", None)], "mass double, residue string, name string, terminus string")
    subs = spark.createDataFrame([("K", "W", 42.4)], "from_aa string, to_aa string, delta double")
    assert rows(ptm.explain_ptm(sites, mods, subs)) == [("a", "K->W,acetyl,acetyl (end)"), ("b", "K->W,acetyl"), ("c", "unmodified")]


def test_engines(spark):
    df = spark.createDataFrame([("f", 1, "P", "x"), ("f", 1, "P", "y"), ("f", 2, "Q", "x"), ("f", 2, "Q", "z")], "spectrum_file string, scan int, aminos string, engine string")
    assert rows(P.engine_venn(df)) == [("x,y", 1), ("x,z", 1)]
    assert rows(P.missed_by(df, "z")) == [("f", 1, "P", 2)]
