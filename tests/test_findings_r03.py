"""Rows that left their tasks for nothing, and work that grew faster than the input, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orfspark.functions import grams
from orfspark.operators import genome, ranges, spectra
from orfspark.plans import pipelines


def plain_places(peptides, sequences):
    found = {(a, i, p + 1) for a in peptides if a for i, s in sequences if s for p in range(len(s)) if s.startswith(a, p)}
    return {(a, i, p, s[p - 2] if p > 1 else None, s[p - 1 + len(a)] if p - 1 + len(a) < len(s) else None) for a, i, p in found for j, s in sequences if j == i}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_peptides_of_any_length(spark, broadcast):
    rng = np.random.default_rng(3)
    sequences = [(f"s{i}", "".join(rng.choice(list("ABÉ\U0001f600"), int(rng.integers(0, 90))))) for i in range(60)] + [("none", None), ("empty", ""), ("same", "A" * 50)]
    peptides = {s[a : a + n] for _, s in sequences if s for a, n in zip(rng.integers(0, 60, 8).tolist(), [1, 3, 6, 7, 9, 12, 20, 33], strict=True)} | {"", "ZZZZZZZ", None}
    got = ranges.map_peptides(spark.createDataFrame([(p,) for p in peptides], "aminos string"), spark.createDataFrame(sequences, "seq_id string, seq string").repartition(3), max_broadcast=broadcast)
    rows = [(r.aminos, r.seq_id, r.pos, r.prefix, r.suffix) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_places(peptides, sequences) and len(rows) > 300


def test_parts_of_a_long_sequence(monkeypatch):
    texts = ["".join(np.random.default_rng(5).choice(list("ABC"), 500)), "", None, "ABCABCA"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["seq"])
    for width in (1, 4):
        # the least hash of every window of a text is found, however the text is cut, and no place twice
        codes = {i: grams.hashes(grams.code_points(s), 5).tolist() for i, s in enumerate(texts) if s}
        want = {(i, min(range(t, t + width), key=lambda p, c=c: (c[p], p))) for i, c in codes.items() for t in range(len(c) - width + 1)}
        for part in (1 << 20, 16):
            monkeypatch.setattr(grams, "PART", part)
            got = [(int(r), int(p), int(c)) for row, at, code in grams.of_batch(batch, "seq", 5, width, None) for r, p, c in zip(row, at, code, strict=True)]
            assert want <= {x[:2] for x in got} and len(got) == len(set(got)) < len(want) + 40 and all(codes[r][p] == c for r, p, c in got)
    monkeypatch.setattr(grams, "PART", 16)
    cut = [(int(r), int(p), g) for row, at, gram in grams.grams_of(batch, "seq", 5) for r, p, g in zip(row, at, gram.to_pylist(), strict=True)]
    assert sorted(cut) == sorted((r, p, s[p : p + 5]) for r, s in ((0, texts[0]), (3, texts[3])) for p in range(len(s) - 4))


def test_least_places_are_few(spark):
    # with many peptides every stretch of the sequences was shuffled
    text = "".join(np.random.default_rng(7).choice(list("ACDEFGHIKL"), 20_000))
    df = spark.createDataFrame([(1, text)], "seq_id int, seq string")
    assert ranges.seeds(df, [(7, 14, 30)], None).count() < 6_000


def test_counts_of_a_run(spark):
    psm = spark.createDataFrame([("A", False), ("A", False), ("A", True), ("B", True), (None, False), (None, True), ("C", None)], "aminos string, is_decoy boolean")
    none = spark.createDataFrame([], "aminos string, call string, decision int")
    out = pipelines.run_report(psm, none, none, none)
    assert tuple(out.first())[:3] == (3, 1, 2)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(pipelines.run_report(psm.where("false"), none, none, none).first()) == (0,) * 7


def test_calibration_with_the_first_rows_known(spark):
    rows = [(f, s, r, float((7 * f + 3 * s) % 11 - r), float(s % 3) / 10, 2 + s % 2, 9.0, (f + s) % 4 == 0) for f in range(3) for s in range(40) for r in range(1, 4)]
    psm = spark.createDataFrame(rows, "spectrum_file int, scan int, rank int, mq_score double, delta double, charge int, length double, is_decoy boolean").withColumn("p_value", F.lit(None).cast("double"))
    values = lambda df: sorted((r.spectrum_file, r.scan, r["rank"], round(r.p_value, 9)) for r in df.collect())
    out = pipelines.calibrated(psm, top=psm.where("rank = 1"))
    assert values(out) == values(pipelines.calibrated(psm))
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_shuffled_for_columns(spark):
    orfs = spark.createDataFrame([("c", 1, 0, 99, 1, True, 0, 40), ("c", 2, 50, 200, 0, False, 50, 60), ("c", 3, 60, 300, 2, True, 290, 300), ("d", 4, 0, 9, 1, True, 0, 9)], "chrom string, orf_name int, start long, stop long, spectra int, named boolean, seen_start long, seen_stop long")
    out = genome.conflicts(orfs)
    assert sorted((r.a, r.b, r.bp, r.level) for r in out.collect()) == [(1, 2, 49, 3), (1, 3, 39, 2), (2, 3, 140, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    carried = genome.overlaps(orfs, carry=("start", "named"))
    assert sorted((r.a, r.a_start, r.b, r.b_start, r.a_named, r.b_named) for r in carried.collect()) == [(1, 0, 2, 50, True, False), (1, 0, 3, 60, True, True), (2, 50, 3, 60, False, True)]


def test_scans_of_one_mass_share_their_pairs(spark):
    # 320 million pairs, if each scan met its own
    peptides = spark.range(400).select("id", F.lit(600.0).alias("mass"), F.lit(1.0).alias("abundance"))
    scans = spark.range(4000).select(F.col("id").alias("scan"), F.lit((1200 + 138 + 1.00728) / 2).alias("mz"))
    got = spectra.crosslink_candidates(peptides, scans, 138.0)
    assert got.count() == 20_000 and got.select("a", "b", "place").distinct().orderBy("place").collect() == [(0, i, i + 1) for i in range(5)]
    assert spectra.crosslink_candidates(peptides.union(peptides), scans, 138.0).count() == 20_000


def test_ions_are_made_once_for_a_peptide(spark):
    peaks = spark.createDataFrame([(s, m, 1.0) for s in range(4) for m in (50.0, 74.0, 200.0)], "spectrum long, mz double, intensity double")
    mods = spark.range(3).select(F.col("id").alias("spectrum"), F.lit("GASP").alias("aminos"), F.lit(0).alias("mod_pos"), F.lit(16.0).alias("mod_mass"))
    mods = mods.union(spark.createDataFrame([(9, "GAS", 0, 16.0), (1, None, 0, 16.0), (1, "G", 0, 16.0)], "spectrum long, aminos string, mod_pos int, mod_mass double"))
    out = spectra.shifted_peaks(peaks, mods)
    assert sorted((r.spectrum, r.mz) for r in out.collect()) == [(s, m) for s in range(3) for m in (50.0, 58.0, 200.0)] + [(3, m) for m in (50.0, 74.0, 200.0)]
    assert "_rbin" not in out._jdf.queryExecution().toString()  # no rows of single ions meet
