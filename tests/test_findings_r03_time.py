"""Work that outgrew its time, memory or bytes, against plain versions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orfspark.functions import digests, expr
from orfspark.operators import genome, inference, ranges, splice
from orfspark.sources import tables


def plain_rounds(pairs):
    """{(protein, aminos): round}: every round takes each protein that no better one shares a peptide with."""
    of = {}
    for a, p, n in pairs:
        of.setdefault(p, {})[a] = n
    out, number = {}, 0
    while of:
        key = {p: (-len(own), -sum(own.values()), p) for p, own in of.items()}
        best = {a: min(key[p] for p in of if a in of[p]) for a in {a for own in of.values() for a in own}}
        taken = [p for p, own in of.items() if all(best[a] == key[p] for a in own)]
        gone = {a for p in taken for a in of[p]}
        out |= {(p, a): number for p in taken for a in of[p]}
        of = {p: left for p, own in of.items() if (left := {a: n for a, n in own.items() if a not in gone})}
        number += 1
    return out


@pytest.mark.parametrize("unit", [1, 0.125])
def test_a_large_component_needs_no_jobs_for_its_rounds(spark, monkeypatch, unit):
    rng = np.random.default_rng(2)
    found = {(f"a{rng.integers(0, 60)}", f"p{rng.integers(0, 24)}"): float(rng.integers(1, 6)) * unit for _ in range(260)}
    pairs = [(a, p, n) for (a, p), n in found.items()]
    df = spark.createDataFrame(pairs, "aminos string, protein string, spectra double").repartition(3)
    taken = lambda **how: {(r.protein, r.aminos): r["round"] for r in inference.select_proteins(df, **how).collect()}
    want = plain_rounds(pairs)
    assert max(want.values()) > 4
    monkeypatch.setattr(inference, "best_around", None)  # each of its rounds was a job
    assert taken(task_pairs=10) == want


def test_rounds_on_spark_are_the_same(spark):
    pairs = [("a", "p", 1), ("b", "p", 1), ("c", "p", 1), ("c", "q", 1), ("d", "q", 1), ("d", "r", 1), ("e", "r", 1), ("e", "s", 1)]
    df = spark.createDataFrame(pairs, "aminos string, protein string, spectra long")
    got = {(r.protein, r.aminos): r["round"] for r in inference.select_proteins(df, task_pairs=2, whole_pairs=2, rounds=1).collect()}
    assert got == plain_rounds(pairs) and max(got.values()) == 1


def by_md5(text, begin):
    return "".join(text[i] for i in sorted(range(len(text)), key=lambda i: hashlib.md5(f"{begin}{i}".encode()).hexdigest()))


def test_letters_are_dealt_by_digests_in_arrays(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACDÉ\U0001f600"), n)) for n in (0, 1, 9, 10, 11, 101, 1234)]
    for begin in ("", "7,0,1,", "É,0,", "x" * 53, "y" * 60):
        assert digests.ordered([*texts, None], [begin] * (len(texts) + 1)) == [by_md5(t, begin) for t in texts] + [None]
    df = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)] + [(None, "n", "ACD")], "seq_id int, name string, seq string")
    out = genome.decoys(df.coalesce(1), copies=2)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString() and out.rdd.getNumPartitions() > 1
    want = {(f"XXX.{c}.{i}", by_md5(t, f"{i},0,{c},")) for i, t in enumerate(texts) for c in (1, 2)} | {(f"XXX.{c}.n", by_md5("ACD", f"0,{c},")) for c in (1, 2)}
    assert {(r.name, r.seq) for r in out.collect()} == want


def test_signals_are_counted_where_contigs_meet(spark):
    rng = np.random.default_rng(6)
    texts = [(i % 7, "".join(rng.choice(list("ACGT"), int(rng.integers(0, 300))))) for i in range(20)]
    texts += [(8, "AAGGTAAGTACGTNNAAGGTAAGTACGTNN\U0001f600ACGTACGTACGTA"), (8, "AAGGTAAGTACGTNN"), (9, "ACG" * 40), (None, "CAGGTAAGTACAG" * 3), (10, None), (11, "ACGT")]
    df = spark.createDataFrame(texts, "chrom int, seq string").coalesce(1)
    stretches = ranges.kmers(df, "seq", 13, ["chrom"]).withColumn("score", expr.splice_score(F.col("kmer")))
    want = {(r.chrom, r.kmer): (r.n, r.score) for r in stretches.groupBy("chrom", "kmer", "score").agg(F.count("*").alias("n")).where("n >= 2 or score > -30").collect()}
    for letters in (1 << 20, 200, 20):
        out = splice.accepted_signals(df, score=-30.0, letters=letters)
        assert {(r.chrom, r.signal): (r.n, r.score) for r in out.collect()} == want and len(want) > 20 and out.count() == len(want)
    assert "kmer" not in splice.accepted_signals(df)._jdf.queryExecution().toString()  # no stretch is shuffled
    rows = stretches.withColumn("score", F.round("score", 5)).groupBy("chrom").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min_by("pos", F.struct(-F.col("score"), "pos")).alias("at"))
    best = splice.best_signals(df)
    assert "kmer" not in best._jdf.queryExecution().toString() and sorted(map(str, best.collect())) == sorted(map(str, rows.collect()))


def test_peptides_are_compared_where_they_are_found(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sequences = [(i, "".join(rng.choice(list("ABÉ\U0001f600"), int(rng.integers(0, 80))))) for i in range(40)] + [(41, None), (42, "")]
    peptides = sorted({s[a : a + n] for _, s in sequences if s for a, n in zip(rng.integers(0, 50, 6).tolist(), [1, 4, 6, 8, 12, 20], strict=True)} - {""}) + ["BBBBBBBBBBBBB", None]
    df = spark.createDataFrame(sequences, "seq_id int, seq string").coalesce(1)
    found = lambda **how: sorted(map(str, ranges.map_peptides(spark.createDataFrame([(p,) for p in peptides], "aminos string"), df, **how).collect()))
    joined = found(max_letters=0)
    monkeypatch.setattr(ranges, "compared_places", None)  # took substrings of each sequence, walking to their places
    assert found() == joined and len(joined) == sum(s.startswith(p, a) for _, s in sequences if s for p in peptides if p for a in range(len(s)))


def test_sisters_are_counted_in_parts(spark):
    rng = np.random.default_rng(3)
    pairs = {(f"a{rng.integers(0, 60)}", f"p{rng.integers(0, 25):02}") for _ in range(260)} | {("own", "p03"), ("own2", "lone")}
    df = spark.createDataFrame([(a, p, 1) for a, p in [*pairs, (None, "p01"), ("a1", None)]], "aminos string, protein string, spectra long").repartition(3)
    of = {}
    for a, p in pairs:
        of.setdefault(p, set()).add(a)
    needy = [p for p in of if all(sum(a in o for o in of.values()) > 1 for a in of[p])]
    want = {p: min((-len(of[p] & of[q]), q) for q in of if q != p and of[p] & of[q]) for p in needy}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a protein's lists come in many batches
    try:
        for most in (1_000, 3):
            out = inference.sister_proteins(df, inference.protein_report(df.where("aminos is not null and protein is not null")), most)
            assert {r.protein: (-r.shared, r.sister) for r in out.collect()} == want and len(want) > 15
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in out._jdf.queryExecution().analyzed().toString()  # no shuffle of pairs


def test_peaks_stay_in_arrays():
    peaks = [[(1.5, 2.0), (3.25, 4.0)], [], [(9.0, 8.0)], [(float(i), 0.5) for i in range(500)]]
    little = [True, False, False, True]
    data = [np.ravel(p).astype("<f4" if x else ">f4").tobytes() for p, x in zip(peaks, little, strict=True)]
    data[2] += b"abc"  # breaks off within a pair
    rows = [("f", i, 1, None, d, x) for i, (d, x) in enumerate(zip([*data, None], [*little, False], strict=True))]
    names = ["spectrum_file", "scan", "ms_level", "precursor_mz", "data", "little"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for size in (1, 20, 1 << 20):
        out = list(tables.with_peaks(iter([batch]), size))
        got = [(r["scan"], [(p["mz"], p["intensity"]) for p in r["peaks"]]) for b in out for r in b.to_pylist()]
        assert got == list(enumerate([*peaks, []])) and (len(out) == 1) == (size > 20)
