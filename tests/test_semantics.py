"""Values worked out by hand from the definitions that the operators follow."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from orfspark.operators import genome, inference, ml, psm as P, ptm, spectra, splice
from orfspark.sources import tables as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_spectrum_quality(spark):
    data = [(1, float(i)) for i in (1, 2, 3, 4, 5, 6)] + [(2, 4.0), (2, 8.0), (2, 2.0), (2, 16.0)] + [(3, 5.0)] + [(4, 3.0), (4, 9.0)] + [(5, 0.0)]
    got = rows(spectra.spectrum_quality(spark.createDataFrame(data, "spectrum int, intensity double")), "spectrum", "signal_to_noise")
    # six peaks: third strongest 4 over the upper median 4; four: second 8 over 8; one: itself; two: the strongest 9 over 9
    assert got == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, None)]
    five = spark.createDataFrame([(1, x) for x in (10.0, 1.0, 2.0, 30.0, 20.0, 1.0, 1.0)], "spectrum int, intensity double")
    assert spectra.spectrum_quality(five).first().signal_to_noise == 10.0 / 2.0


def test_local_fdr_runs_from_the_largest_p(spark):
    hits = [(2, 0.005, False), (2, 0.005, False), (2, 0.015, False), (2, 0.015, True), (2, 0.025, True), (2, 0.025, False), (2, 0.025, True)]
    got = rows(P.assign_lfdr(spark.createDataFrame(hits, "charge int, p_value double, is_decoy boolean")).distinct(), "bin", "local_fdr", "fdr")
    assert got == [(0, 0.0, 3 / 7), (1, 0.5, 3 / 5), (2, 2 / 3, 2 / 3)]


def test_gel_spots(spark):
    hits = [("s", p) for p, n in (("KERATIN", 9), ("A", 5), ("B", 5), ("C", 4), ("D", 3), ("E", 1)) for _ in range(n)]
    got = rows(inference.gel_spots(spark.createDataFrame(hits, "spot string, protein string"), ["KERATIN"]), "place", "protein", "spectra", "total", "contaminating")
    assert got == [(1, "B", 5, 27, 9), (2, "C", 4, 27, 9), (3, "D", 3, 27, 9)]


def test_gel_pairs(spark):
    hits = [(g, f"{g}1", p) for g in ("x", "y", "z") for p, n in (("A", 5), ("B", 3), ("C", 2), ("D", 1), ("KERATIN", 8)) for _ in range(n)]
    hits += [("x", "x2", "A")] * 2 + [("x", "x2", "C")] * 2
    passing = inference.passing_proteins(spark.createDataFrame(hits, "gel string, spot string, protein string"), ["KERATIN"])
    assert rows(inference.gel_pairs(passing), "major", "minor", "gels", "spots") == [("A", "B", 3, 3), ("A", "C", 3, 4)]
    assert inference.gel_pairs(passing, 4).count() == 0


def test_sticky_proteins(spark):
    data = [("a01", "A", 5), ("a01", "B", 1), ("a03", "A", 2), ("a03", "B", 4), ("a03", "KERATIN", 9), ("a07", "KERATIN", 9), ("a07", "B", 2), ("a08", "A", 9), ("a09", "KERATIN", 3), ("a10", "A", 3)]
    got = inference.sticky_proteins(spark.createDataFrame(data, "spot string, protein string, spectra int"), ["KERATIN"])
    # a01 comes before a03 although numbers are missing; a09 holds only contaminants and still parts a08 and a10
    assert rows(got, "spot", "protein") == [("a03", "A"), ("a07", "B")]


def test_mod_kinds(spark):
    of = [(57, "A", "adduct"), (58, "M", "adduct"), (58, "K", "biological"), (58, "R", "unknown"), (160, "Y", "biological"), (38, "E", "adduct"), (72, "K", "biological"), (55, "R", "biological"),
          (43, "G", "adduct"), (14, "H", "biological"), (14, "R", "unknown"), (12, "W", "adduct"), (28, "S", "adduct"), (28, "H", "biological"), (40, "Q", "adduct"), (4, "W", "biological"), (-57, "C", "adduct"), (42, "C", "biological"), (16, "P", "unknown")]
    df = spark.createDataFrame(of, "mass int, residue string, kind string")
    assert df.where(ptm.mod_kind(F.col("mass"), F.col("residue")) != F.col("kind")).count() == 0
    top = ptm.classify_ptm_counts(spark.createDataFrame([(1, "A", 5, 1), (2, "A", 5, 1), (2, "C", 5, 1), (9, "A", 7, 1)], "mass int, residue string, sites int, spectra int"), 3)[1]
    assert [(r.mass, r.residue) for r in top.collect()] == [(9, "A"), (2, "C"), (2, "A")]


def test_compare_rates(spark):
    shape = "site int, modified long, total long"
    got = ptm.compare_ptm_rates(spark.createDataFrame([(1, 2, 4), (2, 1, 3), (4, 0, 0)], shape), spark.createDataFrame([(1, 1, 4), (3, 1, 2), (4, 0, 0)], shape))
    assert rows(got, "site", "a_rate", "b_rate", "note") == [(1, 50.0, 25.0, ""), (2, 100 / 3, 0.0, "A"), (3, 0.0, 50.0, "B"), (4, 0.0, 0.0, "B")]
    assert [r[1] is None for r in rows(got, "site", "chi2")] == [False, True, True, True]


def test_site_diff(spark):
    shape = "aminos string, mods array<struct<pos:int,mass:double>>, spectra long"
    a = spark.createDataFrame([("PEPT", [(1, 15.9)], 6), ("PEPT", [], 4), ("EPTI", [(3, 79.5)], 4)], shape)
    b = spark.createDataFrame([("PEPT", [(1, 16.2)], 3), ("PEPT", [], 7), ("EPTI", [(3, 0.3)], 9), ("EPTI", [(3, 80.0)], 5)], shape)
    places = spark.createDataFrame([("PEPT", "s", 3), ("PEPT", "s", 20), ("EPTI", "s", 4)], "aminos string, seq_id string, pos int")
    assert rows(ptm.residue_mods(a, places), "protein", "pos", "mass", "modified", "total") == [("s", 4, 16, 6, 14), ("s", 7, 80, 4, 4)]
    got = rows(ptm.compare_residues(a, b, places), "pos", "mass", "a_mod", "a_all", "b_mod", "b_all", "call", "min_count")
    # 6 of 14 against 3 of 24 is more than twice; 4 of 4 against 5 of 14 too, and B alone reaches five spectra
    assert got == [(4, 16, 6, 14, 3, 24, "A", 3), (7, 80, 4, 4, 5, 14, "A", 4)]
    twice = "protein string, pos int, mass int, modified long, total long"
    even = ptm.site_diff(spark.createDataFrame([("s", 1, 16, 8, 10), ("s", 2, 16, 4, 10)], twice), spark.createDataFrame([("s", 1, 16, 4, 10), ("s", 2, 16, 4, 10)], twice))
    assert rows(even, "pos", "call") == [(1, "Both")]  # exactly twice is not more; four and four add up to no site


def test_evaluate_signal(spark):
    pred = spark.createDataFrame([(1, 0.5, 20), (2, 0.5, 20), (3, 0.5, 20), (4, 0.5, 20), (5, 0.91, 20)], "protein int, score double, cut_pos int")
    cleaved = spark.createDataFrame([(1,), (9,)], "protein int")
    seen = spark.createDataFrame([(1, 2), (2, 17), (3, 16), (5, 25)], "protein int, first_pos int")
    assert rows(splice.evaluate_signal(pred, cleaved, seen), "score", "predicted", "accepted", "rejected") == [(0.5, 4, 1, 1), (0.91, 1, 0, 0)]


def test_ortholog_starts(spark):
    aligned = spark.createDataFrame([("c", "t", "--MKLV"), ("c", "late", "----LV"), ("c", "early", "MMM-LV"), ("c", "letter", "---KLV"), ("c", "brief", "MK"), ("d", "t", "----"), ("d", "u", "MKLV")], "cluster string, genome string, row string")
    observed = spark.createDataFrame([("c", "t", 1), ("d", "t", 0), ("c", "none", 1)], "cluster string, target string, offset int")
    got = rows(splice.ortholog_start_check(aligned, observed), "cluster", "genome", "column", "state")
    assert got == [("c", "brief", 3, "short"), ("c", "early", 3, "ok"), ("c", "late", 3, "suspect"), ("c", "letter", 3, "ok"), ("c", "t", 3, "ok"), ("d", "t", 3, "suspect"), ("d", "u", 3, "ok")]


def test_scaled_features(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(1, 101)], "x double, flat double")
    got = rows(ml.scale_features(df, ["x", "flat"]), "x", "flat")
    # of 100 rows places 3 and 98 (2.5 rounds up), values 4 and 99, become -1 and 1
    assert got[3][0] == -1.0 and got[98][0] == 1.0 and got[0][0] == pytest.approx(-3 / 47.5 - 1) and {f for _, f in got} == {0.0}


def test_prior_false(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(1,)] * 30, "label int")
    assert ml.prior_false(df, 1.0) == pytest.approx(0.5) and ml.prior_false(df, 1 / 9) == pytest.approx((10 + 10 / 9) / 40) and ml.prior_false(df, 3.0) == 0.99


def test_signal_peptides(spark):
    core = "LLLLLLLLLLLL"  # a patch from its first residue on
    of = [("tryptic", "M" * 5, True, 0), ("short", "M" * 14, False, 1), ("long", "M" * 51, False, 2), ("no patch", "D" * 20, False, 3),
          ("late basic", "D" * 4 + core + "K" + "AQA", False, 4), ("third of patch", "DDD" + "LKL" + core + "AQA", False, 5), ("no motif", "MK" + core + "DDDD", False, 4), ("all", "MKDD" + core + "AQA", False, 5)]
    got = {r.orf_name: r.decision for r in genome.signal_peptides(spark.createDataFrame([x[:3] for x in of], "orf_name string, prefix string, tryptic_n boolean")).collect()}
    assert got == {n: d for n, _, _, d in of}


def test_call_structure(spark):
    orfs = spark.createDataFrame([(n, p, 100, 400, s) for n, p, s in (("none", "p", "+"), ("novel", None, "+"), ("novel shared", None, "+"), ("up", "p", "+"), ("at M", "p", "+"), ("at", "p", "+"), ("shared", "p", "+"), ("minus", "p", "-"))], "orf_name string, protein_id string, protein_start int, protein_stop int, strand string")
    seen = [("novel", "PEP", 50, True), ("novel shared", "PEP", 50, False), ("up", "PEP", 96, True), ("at M", "MEP", 100, True), ("at", "PEP", 100, True), ("shared", "PEP", 10, False), ("minus", "PEP", 396, True)]
    located = spark.createDataFrame([(o, a, s, s + 8, "-" if o == "minus" else "+", u) for o, a, s, u in seen], "orf_name string, aminos string, start int, stop int, strand string, is_unique boolean")
    got = dict(rows(genome.call_structure(orfs, located), "orf_name", "call"))
    assert got == {"none": "NO EVIDENCE", "novel": "NOVEL", "novel shared": "NOVEL", "up": "UNDERPREDICTED", "at M": "OK", "at": "UNDERPREDICTED", "shared": "OK", "minus": "UNDERPREDICTED"}


def test_ptm_mass(spark):
    df = spark.createDataFrame([("s", x + 1.0078) for x in (16.0, 16.2, 15.8, 17.1, 16.6)], "site string, delta_mass double")
    r = ptm.ptm_mass(df).first()
    assert (r.n, r.isotope, r.trimmed_n) == (5, 16.0, 3) and r.trimmed_mean == pytest.approx(16.0) and r.trimmed_sd == pytest.approx((0.08 / 3) ** 0.5)


def test_pair_scans_of_equal_mass(spark):
    df = spark.createDataFrame([("f", 1, 2, 500.0), ("f", 2, 2, 500.2), ("f", 3, 2, 600.0), ("f", 4, 2, 700.0), ("f", 5, 1, 0.0), ("f", 6, 2, 1.0)], "spectrum_file string, scan int, ms_level int, parent_mass double")
    assert rows(spectra.pair_scans(df, 0.5), "scan", "partner") == [(1, 2), (2, 1), (3, 3), (4, 4), (6, 6)]
    assert rows(spectra.pair_scans(df), "scan", "partner") == [(1, 2), (2, 1), (3, 4), (4, 3), (6, 6)]


@pytest.mark.parametrize("order", ["network", "little", "little-endian", None])
def test_mzxml_byte_order(spark, tmp_path, order):
    data = base64.b64encode(struct.pack(("<" if order and order.startswith("little") else ">") + "4f", 100.5, 7.0, 250.25, 9.5)).decode()
    named = f' byteOrder="{order}"' if order else ""
    whole = f'<msRun>\n<scan num="1" msLevel="1"><peaks precision="32"{named}>{data}</peaks></scan>\n<scan num="2" msLevel="2"><precursorMz x="1">455.5</precursorMz><peaks{named}>{data[:14]}'
    (tmp_path / "a.mzXML").write_text(whole)
    got = {r.scan: r for r in S.read_mzxml(spark, str(tmp_path)).collect()}
    assert [tuple(p) for p in got[1].peaks] == [(100.5, 7.0), (250.25, 9.5)] and got[2].precursor_mz == 455.5
    assert [tuple(p) for p in got[2].peaks] == [(100.5, 7.0)]  # the file breaks off inside the second pair
