from pyspark.sql import functions as F

from orfspark.functions import expr as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_overlap(spark):
    at = lambda *v: one(spark, X.bp_overlap(*[F.lit(x) for x in v]))
    assert tuple(at(2, 11, 3, 9)) == (3, 9)
    assert tuple(at(2, 11, 5, 17)) == tuple(at(5, 17, 2, 11)) == (5, 11)
    assert at(21, 367, 5, 17) is None


def test_low_complexity(spark):
    got = [one(spark, X.low_complexity(F.lit(s))) for s in ("GGGGGGGGG", "GGAGAGAG", "AGGAGQWEIUPIUFGBVA", "AGGAGGQHGGGAG")]
    assert got == [True, True, False, False]


def test_annotation_round_trip(spark):
    for text in ("K.SEQ+16PEPT.R", "-.MAPK.L", "PEPTIDE", "R.S+80TY.K"):
        assert one(spark, X.format_annotation(X.parse_annotation(F.lit(text)))) == text
    p = one(spark, X.parse_annotation(F.lit("K.SEQ+16PEPT.R")))
    assert (p.prefix, p.aminos, p.suffix, [(m.pos, m.name) for m in p.mods]) == ("K", "SEQPEPT", "R", [(2, "+16")])


def test_tryptic(spark):
    n = lambda t: one(spark, X.ntt(X.parse_annotation(F.lit(t))))
    assert n("K.MSTAQWSTR.L") == 2 and n("M.WEROTYSDSWH.A") == 0 and n("K.PEPR.P") == 0 and n("-.MAPR.*") == 2


def test_masses(spark):
    assert abs(one(spark, X.peptide_mass(F.lit("GAS"))) - (57.02146 + 71.03711 + 87.03203)) < 1e-6
    ions = one(spark, X.fragment_ions(F.lit("GA")))
    assert {(i.series, i.n): round(i.mz, 4) for i in ions if i.series in "by"} == {("b", 1): round(57.02146 + 1.0078, 4), ("y", 1): round(71.03711 + 18.010565 + 1.0078, 4)}


def test_dna(spark):
    assert one(spark, X.reverse_complement(F.lit("ATGCC"))) == "GGCAT"
    assert one(spark, X.translate_dna(F.lit("ATGTAANNNGG"))) == "M**"
    assert one(spark, X.translate_dna(F.lit("A"))) == ""
    assert one(spark, X.gc_percent(F.lit("GCA"))) == 66


def test_hydrophobic_patch(spark):
    seq = "DDDDD" + "L" * 14 + "DDD"
    assert one(spark, X.hydrophobic_patch(X.hydropathy_plot(F.lit(seq)))) >= 0
    assert one(spark, X.hydrophobic_patch(X.hydropathy_plot(F.lit("DDDDDDDDDD")))) == -1
    assert one(spark, F.size(X.hydropathy_plot(F.lit("DD")))) == 0


def test_protein_numbers(spark):
    import math

    assert abs(one(spark, X.sequence_entropy(F.lit("GGGAS"))) - (0.6 * math.log(1 / 0.6) + 0.4 * math.log(5))) < 1e-9
    assert 9 < one(spark, X.isoelectric_point(F.lit("KKKK"))) <= 13
    assert 3 < one(spark, X.isoelectric_point(F.lit("DDDD"))) < 5
    assert one(spark, X.signal_motif(F.lit("MKKLAVA"))) and not one(spark, X.signal_motif(F.lit("MKKDDD")))


def test_localization(spark):
    import math

    tail = lambda n, k: sum(math.comb(n, i) * 0.12**i * 0.88 ** (n - i) for i in range(k, n + 1))
    got = one(spark, X.localization_score(F.lit(8), F.lit(5), F.lit(2)))
    assert abs(got - (-10 * math.log10(tail(8, 5)) + 10 * math.log10(tail(8, 2)))) < 1e-6
    assert one(spark, X.alternate_sites(F.lit("ASTK"), 2)) == [[1, 2]]
    assert one(spark, X.alternate_sites(F.lit("ASTK"), 1)) == [[1], [2]]


def test_headers_and_coordinates(spark):
    h = one(spark, X.orf_header(F.lit("Protein7.Chr:Chr1.Frame1.StartNuc831372.Strand-")))
    assert tuple(h) == ("Chr1", "Chr1.Protein7", 1, 831372, "-")
    to = lambda s, n, o, k: tuple(one(spark, X.to_genome(F.lit(s), F.lit(n), F.lit(o), F.lit(k))))
    assert to("+", 100, 2, 3) == (106, 114) and to("-", 100, 2, 3) == (86, 94)


def test_names(spark):
    assert one(spark, X.base_name(F.lit(r"C:\a\b.mgf"))) == "b.mgf" and one(spark, X.base_name(F.lit("/a/c.txt"))) == "c.txt"
    assert one(spark, X.spot_name(F.lit("/x/gelA12_f3.txt"))) == "gelA12" and one(spark, X.gel_name(F.lit("gelA12.txt"))) == "gelA"


def test_chi2(spark):
    assert abs(one(spark, X.chi2_2x2(*[F.lit(v) for v in (10, 20, 30, 40)])) - 0.7936507936507936) < 1e-9
    assert one(spark, X.chi2_2x2(*[F.lit(v) for v in (0, 0, 3, 4)])) is None
