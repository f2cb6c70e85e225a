import random

import pytest
from pyspark.sql import functions as F

from orfspark.functions import expr as X
from orfspark.operators import genome, inference, ml, psm, ptm, ranges, spectra, splice


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_map_peptides_equals_find(spark):
    r = random.Random(1)
    seqs = [(i, "".join(r.choice("ACDK") for _ in range(60))) for i in range(15)] + [(99, "")]
    peps = sorted({s[a : a + n] for _, s in seqs[:6] for a in (0, 7, 30) for n in (1, 3, 5, 9)} | {"WWWWWW", "AAAA"})
    got = sorted((x.aminos, x.seq_id, x.pos) for x in ranges.map_peptides(spark.createDataFrame([(p,) for p in peps], "aminos string"), spark.createDataFrame(seqs, "seq_id long, seq string")).collect())
    assert got == sorted((p, i, k + 1) for p in peps for i, s in seqs for k in range(len(s)) if s.startswith(p, k))


def test_map_peptides_flags(spark):
    seqs = spark.createDataFrame([(1, "MKAAAAARGGGGGGK")], "seq_id long, seq string")
    got = {x.aminos: x for x in ranges.map_peptides(spark.createDataFrame([("AAAAAR",), ("GGGGGGK",), ("MKAAAAA",)], "aminos string"), seqs).collect()}
    assert (got["AAAAAR"].prefix, got["AAAAAR"].tryptic_n, got["AAAAAR"].tryptic_c, got["AAAAAR"].n_places) == ("K", True, True, 1)
    assert got["GGGGGGK"].suffix is None and got["GGGGGGK"].tryptic_c
    assert got["MKAAAAA"].prefix is None and not got["MKAAAAA"].tryptic_n and not got["MKAAAAA"].tryptic_c


def test_range_joins_equal_loops(spark):
    r = random.Random(2)
    a = [(r.choice("xy"), i, s, s + r.randint(0, 40)) for i in range(60) for s in [r.randint(0, 300)]]
    b = [(r.choice("xy"), i, s, s + r.randint(0, 90)) for i in range(50) for s in [r.randint(0, 300)]]
    A, B = spark.createDataFrame(a, "k string, i long, s long, e long"), spark.createDataFrame(b, "k string, j long, t long, f long")
    got = rows(ranges.overlap_join(A, B, ["k"], ("s", "e"), ("t", "f"), 25).select("i", "j"))
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    got = rows(ranges.contained_in(A, B, ["k"], ("s", "e"), ("t", "f"), 3, 25).select("i", "j"))
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] >= y[2] - 3 and x[3] <= y[3] + 3)
    got = rows(ranges.tolerance_join(A.select("k", "i", "s"), B.select("k", "j", "t"), ["k"], "s", "t", 4).select("i", "j"))
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and abs(x[2] - y[2]) <= 4)


def test_coverage_and_pieces(spark):
    iv = [("c", 1, 5), ("c", 3, 8), ("c", 3, 8), ("c", 20, 20)]
    df = spark.createDataFrame(iv, "k string, s long, e long")
    depth = {p: n for _, a, z, n in rows(ranges.coverage_of(df, ["k"], "s", "e")) for p in range(a, z + 1)}
    assert depth == {p: n for p in range(1, 21) if (n := sum(a <= p <= z for _, a, z in iv))}
    assert rows(ranges.split_disjoint(df, ["k"], "s", "e").select("start", "stop", "n")) == [(1, 2, 1), (3, 5, 3), (6, 8, 2), (20, 20, 1)]
    groups = ranges.group_by_gap(df, ["k"], "s", "e", 5, ["k"]).groupBy("group_no").count()
    assert rows(groups) == [(1, 3), (2, 1)]


def test_six_frame_round_trip(spark):
    r = random.Random(3)
    dna = "".join(r.choice("ACGT") for _ in range(700)) + "N" * 3 + "".join(r.choice("ACGT") for _ in range(50))
    found = genome.six_frame(spark.createDataFrame([("c", dna)], "chrom string, seq string"), 5).collect()
    assert len(found) > 20
    for o in found:
        span = o.length * 3
        piece = dna[o.start_nuc - 1 : o.start_nuc - 1 + span] if o.strand == "+" else dna[o.start_nuc - span : o.start_nuc]
        back = spark.range(1).select(X.translate_dna(F.lit(piece) if o.strand == "+" else X.reverse_complement(F.lit(piece)))).first()[0] if o is found[0] or o is found[-1] else o.seq
        assert back == o.seq
    other = genome.six_frame(spark.createDataFrame([("c", dna)], "chrom string, seq string"), 5, 99)
    assert rows(other.select("strand", "frame", "start_nuc", "length")) == sorted((o.strand, o.frame, o.start_nuc, o.length) for o in found)


def test_decoys(spark):
    s = spark.createDataFrame([(1, "p1", "MKACDEFGHIKLMNPQRST"), (2, "p2", "AAAA")], "seq_id long, name string, seq string")
    got = {(r.seq_id, r.copy): r for r in genome.decoys(s, copies=2).collect()}
    assert got[1, 2].name == "XXX.2.p1" and sorted(got[1, 1].seq) == sorted("MKACDEFGHIKLMNPQRST") and got[1, 1].seq != got[1, 2].seq
    assert genome.decoys(s, "reverse").where("seq_id = 1").first().seq == "TSRQPNMLKIHGFEDCAKM"
    assert genome.decoys(s, avoid_k=4).count() == 2


def test_select_proteins_covers_once_and_equals_greedy(spark):
    r = random.Random(4)
    pairs = sorted({(r.randint(0, 60), r.randint(0, 25), 1 + r.randint(0, 3)) for _ in range(260)})
    best = {}
    for a, p, n in pairs:
        best[a, p] = max(n, best.get((a, p), 0))
    got = {r.aminos: r.protein for r in inference.select_proteins(spark.createDataFrame(pairs, "aminos long, protein long, spectra long")).collect()}
    left, want = dict(best), {}
    while left:
        size = {}
        for (a, p), n in left.items():
            k, m = size.get(p, (0, 0))
            size[p] = (k + 1, m + n)
        top = min(size, key=lambda p: (-size[p][0], -size[p][1], p))
        for a in [a for a, p in left if p == top]:
            want[a] = top
        left = {k: n for k, n in left.items() if k[0] not in want}
    assert got == want


def test_filter_chain(spark):
    base = dict(strand="+", is_unique=True, tryptic_n=True, tryptic_c=True)
    def loc(orf, aminos, start, **kw):
        x = base | kw
        return (orf, aminos, start, start + 3 * len(aminos) - 1, x["strand"], x["is_unique"], x["tryptic_n"], x["tryptic_c"])
    data = [loc("ok", "MSTAQWSTR", 1), loc("ok", "WEROTYSDSWH", 60), loc("poor", "GGGGGGGGG", 1), loc("lone", "MSTAQWSTR", 1), loc("shared", "MSTAQWSTR", 1, is_unique=False), loc("shared", "LLLLQWSTR", 60, is_unique=False), loc("ragged", "MSTAQWSTR", 1, tryptic_n=False), loc("ragged", "TTTAQWSTR", 50, tryptic_c=False), loc("one", "MSTAQWSTR", 1), loc("one", "MSTAQWSTR", 90)]
    df = spark.createDataFrame(data, "orf_name string, aminos string, start long, stop long, strand string, is_unique boolean, tryptic_n boolean, tryptic_c boolean")
    got = {r.orf_name: r.killed_by for r in genome.filter_orfs(df).collect()}
    assert got == {"ok": None, "poor": "complexity", "lone": "distance", "shared": "unique", "ragged": "tryptic", "one": "min_peptides"}
    first = {r.orf_name: r.aminos for r in genome.first_peptide(df.withColumn("strand", F.when(F.col("orf_name") == "ok", "-").otherwise("+"))).collect()}
    assert first["ok"] == "WEROTYSDSWH" and first["ragged"] == "MSTAQWSTR"


def test_calls_and_starts(spark):
    orfs = spark.createDataFrame([("a", "+", None, None, None), ("b", "+", "p", 100, 400), ("c", "+", "q", 100, 400), ("d", "-", "r", 100, 400)], "orf_name string, strand string, protein_id string, protein_start long, protein_stop long")
    loc = spark.createDataFrame([("a", "LLLLLK", 10, 27, "+", True), ("b", "LLLLLK", 80, 97, "+", True), ("c", "MLLLLK", 100, 117, "+", True), ("d", "LLLLLK", 390, 407, "-", True)], "orf_name string, aminos string, start long, stop long, strand string, is_unique boolean")
    assert {r.orf_name: r.call for r in genome.call_structure(orfs, loc).collect()} == {"a": "NOVEL", "b": "UNDERPREDICTED", "c": "OK", "d": "UNDERPREDICTED"}
    starts = genome.upstream_starts(spark.createDataFrame([("a", "GTGATGCCCTTGAAA", 12)], "orf_name string, dna string, until int"))
    assert rows(starts.select("at", "codon")) == [(3, "ATG"), (9, "TTG")]
    assert genome.corrected_starts(starts).count() == 0


def test_signal_peptides(spark):
    data = [("t", "K" * 20, True), ("s", "MKK", False), ("l", "M" * 60, False), ("n", "D" * 20, False), ("p", "MDD" + "L" * 14 + "DDD", False), ("y", "MKK" + "L" * 14 + "AVA", False)]
    got = {r.orf_name: r.decision for r in genome.signal_peptides(spark.createDataFrame(data, "orf_name string, prefix string, tryptic_n boolean")).collect()}
    assert got == {"t": 0, "s": 1, "l": 2, "n": 3, "p": 4, "y": 5}


def test_delta_dissimilar(spark):
    data = [("f", 1, 1, "PEPTIDE", 10, 9.0), ("f", 1, 2, "PEPTLDE", 50, 8.0), ("f", 1, 3, "WWWWWWW", 90, 5.0), ("f", 2, 1, "AAAA", 1, -2.0)]
    df = spark.createDataFrame(data, "spectrum_file string, scan int, rank int, aminos string, db_pos long, mq_score double")
    assert {(r.scan, r.rank): r.delta_other for r in psm.delta_dissimilar(df).collect()} == {(1, 1): 4.0, (1, 2): 3.0, (1, 3): -4.0, (2, 1): 0.0}


def test_strip_needless_mod(spark):
    data = [("ACD", 0, 113.1, "XXLACDK", 4), ("ACD", 2, 128.1, "XXLACDKW", 4), ("ACD", 1, 16.0, "XXLACDK", 4)]
    got = [(r.new_aminos, r.new_pos) for r in ptm.strip_needless_mod(spark.createDataFrame(data, "aminos string, mod_pos int, mod_mass double, seq string, pos int")).collect()]
    assert got == [("LACD", 3), ("ACDK", 4), (None, None)]


def test_search_finds_the_peptide(spark):
    target = "PEPTIDEK"
    peptides = spark.createDataFrame([(p,) for p in (target, "EDITPEPK", "WWWWK")], "aminos string")
    ions = [i.mz for i in spark.range(1).select(X.fragment_ions(F.lit(target)).alias("i")).first().i if i.series in ("b", "y")]
    peaks = spark.createDataFrame([(1, mz, 1.0) for mz in ions], "spectrum long, mz double, intensity double")
    mass = spark.range(1).select(X.parent_mass_of(F.lit(target))).first()[0]
    best = spectra.search_spectra(spark.createDataFrame([(1, mass)], "spectrum long, mass double"), peaks, peptides).where("place = 1").first()
    assert (best.aminos, best.shared) == (target, len(set(ions)))


def test_localize_counts_ions_of_equal_mass(spark):
    """O has no mass here, so cuts before and behind it give two ions of one mass: four ions, all met by two peaks."""
    phospho, serine, lysine = 79.96633, X.RESIDUE_MASS["S"], X.RESIDUE_MASS["K"]
    peaks = spark.createDataFrame([(1, serine + phospho + X.PROTON), (1, lysine + X.WATER + X.PROTON)], "spectrum long, mz double")
    got = spectra.localize(spark.createDataFrame([(1, "SOK", 1)], "spectrum long, aminos string, n_sites int"), peaks).first()
    assert (got.sites, got.found) == ([0], 4)


def test_localize(spark):
    ions = [i.mz for i in spark.range(1).select(X.fragment_ions(F.lit("ASTYK"), F.array(F.struct(F.lit(2).alias("pos"), F.lit(79.96633).alias("mass")))).alias("i")).first().i if i.series in ("b", "y")]
    peaks = spark.createDataFrame([(1, mz, 1.0) for mz in ions], "spectrum long, mz double, intensity double")
    got = spectra.localize(spark.createDataFrame([(1, "ASTYK", 1)], "spectrum long, aminos string, n_sites int"), peaks).first()
    assert got.sites == [2] and got.score > 0


def test_pair_scans_and_crosslinks(spark):
    scans = spark.createDataFrame([("f", 1, 1), ("f", 2, 2), ("f", 3, 2), ("f", 4, 2), ("f", 5, 1), ("f", 6, 2)], "spectrum_file string, scan int, ms_level int")
    assert rows(spectra.pair_scans(scans).select("scan", "partner")) == [(2, 3), (3, 2), (4, 4), (6, 6)]
    pep = [(i, 500.0 + 37.3 * i, float(i)) for i in range(8)]
    mz = (pep[1][1] + pep[4][1] + 100 + 1.0078) / 2
    got = rows(spectra.crosslink_candidates(spark.createDataFrame(pep, "id long, mass double, abundance double"), spark.createDataFrame([(1, mz)], "scan long, mz double"), 100.0, top=50).select("a", "b"))
    want = sorted((i, j) for i, m, _ in pep for j, n, _ in pep if i <= j and any(abs(m + n + 100 - (mz * z - (z - 1) * 1.0078)) <= 1 for z in (2, 3)))
    assert got == want and (1, 4) in got


def test_consensus(spark):
    peaks = spark.createDataFrame([("k", s, 100.0 + d, 10.0) for s, d in ((1, 0.0), (2, 0.1), (3, 0.2))] + [("k", 1, 300.0, 5.0)], "key string, spectrum int, mz double, intensity double")
    got = spectra.consensus(spectra.consensus_bins(peaks)).collect()
    assert sorted(round(r.mz) for r in got) == [100, 300]


def test_splice(spark):
    exons = spark.createDataFrame([("g", "t1", "c", "+", 1, 10), ("g", "t1", "c", "+", 20, 30), ("g", "t2", "c", "+", 1, 10), ("g", "t2", "c", "+", 25, 30), ("g", "t3", "c", "+", 1, 10), ("g", "t3", "c", "+", 20, 30)], "gene_id string, transcript_id string, chrom string, strand string, start long, stop long")
    assert rows(splice.alt_splicing(exons)) == [("g", 3, 0, 1, 0)]
    assert rows(splice.drop_redundant_transcripts(exons).select("transcript_id")) == [("t1",), ("t2",)]
    iv = spark.createDataFrame([("c", "+", 1, 10), ("c", "+", 22, 40)], "chrom string, strand string, start long, stop long")
    assert {(r.start, r.support) for r in splice.exon_support(exons, iv).collect()} == {(1, "covered"), (20, "touched"), (25, "touched")}
    hits = [(1, "c", "+", [(2, 8)], 0.01, 9, 0, True), (2, "c", "+", [(2, 8)], 0.01, 9, 0, False), (3, "c", "+", [(50, 60)], 0.01, 9, 0, False), (4, "c", "+", [(50, 60)], 0.01, 9, 2, False), (5, "c", "+", [(5, 10), (20, 25)], 0.01, 9, 0, False), (6, "c", "+", [(5, 10), (22, 25)], 0.01, 9, 0, False), (7, "c", "+", [(5, 9), (50, 55)], 0.01, 9, 0, False), (8, "c", "+", [(2, 8)], 0.2, 9, 0, True)]
    df = spark.createDataFrame(hits, "hit int, chrom string, strand string, segments array<struct<start:long,stop:long>>, p_value double, length int, mismatches int, in_protein boolean")
    assert rows(splice.categorize_hits(df, exons)) == [(1, 1), (2, 2), (3, 3), (4, 8), (5, 5), (6, 6), (7, 7), (8, 0)]


def test_models(spark):
    r = random.Random(5)
    data = [(i % 2, r.gauss(i % 2, 0.5), r.gauss(0, 1), r.gauss(-(i % 2), 1)) for i in range(400)]
    df = spark.createDataFrame(data, "label int, a double, b double, c double")
    w, k = ml.fit_lda(df, ["a", "b", "c"])
    assert ml.roc_auc(ml.apply_linear(df, ["a", "b", "c"], w, k)).first()[0] > 0.9
    assert ml.select_features(df, ["a", "b", "c"], 2)[0] == "a"
    assert ml.roc_auc(ml.predict_logit(ml.fit_logit(df, ["a", "c"]), df, ["a", "c"])).first()[0] > 0.9
    assert ml.roc_auc(ml.predict_svm(ml.fit_svm(df, ["a", "c"]), df, ["a", "c"])).first()[0] > 0.9
    assert ml.prior_false(df, 10.0) == 0.99


def test_p_of_chi2(spark):
    got = ptm.chi2_p(spark.createDataFrame([(3.841459,), (None,)], "chi2 double")).collect()
    assert abs(got[0].p - 0.05) < 1e-5 and got[1].p is None


def test_fabricate(spark):
    got = genome.fabricate(spark.createDataFrame([(1, "AAAC")], "seq_id long, seq string"), 30, 20, 50).collect()
    assert len(got) == 30 and all(20 <= len(r.seq) <= 50 and set(r.seq) <= set("AC") for r in got)


@pytest.mark.parametrize("gap", [1, 5])
def test_reconcile(spark, gap):
    pt = "array<struct<pos:int,prefix:double,suffix:double>>"
    df = spark.createDataFrame([(1, 5.0, [(10, 100.0, 50.0)]), (2, 9.0, [(10, 100.01, 50.0)]), (3, 9.5, [(10, 100.0 + gap, 50.0)])], f"id int, score double, points {pt}")
    assert rows(ptm.reconcile_species(df)) == [(1, 2)]
