"""Work that has to grow no faster than its input, and results at the edges, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfspark.functions import expr as X
from orfspark.operators import inference, spectra
from orfspark.plans import catalog
from orfspark.sources import tables


def plain_regions(rows, share):
    out, region = {}, {}
    for chrom, name, start, stop in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        met = [min(stop, e) - max(start, s) + 1 >= share * min(stop - start + 1, e - s + 1) for c, n, s, e in rows if c == chrom and (s, e, n) < (start, stop, name) and s <= stop and start <= e]
        region[chrom] = region.get(chrom, 0) + (not any(met))
        a, z, n = out.get((chrom, region[chrom]), (start, stop, 0))
        out[chrom, region[chrom]] = (min(a, start), max(z, stop), n + 1)
    return out


def test_half_overlaps(spark):
    rng = np.random.default_rng(8)
    for share in (0.3, 0.5, 1.0):
        rows = [("c", 900 + i, 5, 5) for i in range(3)]
        rows += [(str(rng.choice(["a", "b"])), i, int(s), int(s + rng.integers(0, 40))) for i, s in enumerate(rng.integers(0, 1500, 150))]
        df = spark.createDataFrame(rows, "chrom string, name int, start long, stop long").repartition(3)
        got = {(r.chrom, r.region): (r.start, r.stop, r.n) for r in inference.merge_half_overlaps(df, share).collect()}
        assert got == plain_regions(rows, share) and len(got) > 20


def test_half_overlaps_in_one_place(spark):
    # 20 thousand million pairs, if they were made
    df = spark.range(200_000).select(F.lit("c").alias("chrom"), F.col("id").alias("name"), F.lit(10).cast("long").alias("start"), F.lit(90).cast("long").alias("stop"))
    assert [tuple(r) for r in inference.merge_half_overlaps(df).collect()] == [("c", 1, 10, 90, 200_000)]


def test_kings_in_parts(spark):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ABC"), 200))
    rows = sorted({(int(rng.integers(0, 2)), text[i : i + int(rng.integers(1, 30))], float(rng.integers(0, 9))) for i in rng.integers(0, 190, 150)})
    rows = spark.createDataFrame(rows + [(None, "AB", 5.0), (0, "", 5.0), (0, None, 5.0)], "protein int, aminos string, score double").repartition(3)
    whole = sorted(tuple(r) for r in inference.kings(rows, 2.0).collect())
    assert sorted(tuple(r) for r in inference.kings(rows, 2.0, part_rows=10).collect()) == whole and len(whole) > 20


def test_kings_shuffle_candidates_once(spark):
    # a candidate has hundreds of stretches of letters: rows of them were shuffled
    df = spark.range(300).select(F.lit(0).alias("protein"), F.concat(F.repeat(F.md5(F.col("id").cast("string")), 8)).alias("aminos"), F.col("id").cast("double").alias("score"))
    plan = inference.kings(df)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and plan.count("SortMergeJoin") <= 1


def test_signal_scores_at_the_half(spark, tmp_path):
    # 0.285 * 100 is below 28.5 in doubles; the score is 0.29 on both sides
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, 2850.0), (2, -2850.0), (3, 2849.99), (4, 5750.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(9, 1, "1-URGENT", 3e5), (70, 2, "5-LOW", 1.0)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["j16_evaluate_signal"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        for name in ("customer", "orders"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(con.execute(catalog.ORACLE_SQL["j16_evaluate_signal"]).fetchall())
    assert got == want and [r[0] for r in got] == [0.28, 0.29, 0.58]


def test_pairs_of_spectra_are_scored_in_place(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("GASPVT"), int(rng.integers(1, 7)))) for _ in range(40)})
    mass = {r.a: r.m for r in spark.createDataFrame([(w,) for w in words], "a string").select("a", X.parent_mass_of(F.col("a")).alias("m")).collect()}
    spectra_rows = [(i, float(mass[words[i]] + rng.integers(-30, 30) / 10)) for i in range(30)]
    peak_rows = [(i, float(m), 1.0) for i in range(29) for m in rng.integers(50, 500, 200)]
    precursors, peaks = spark.createDataFrame(spectra_rows, "spectrum int, mass double"), spark.createDataFrame(peak_rows, "spectrum int, mz double, intensity double")
    peptides = spark.createDataFrame([(w,) for w in words * 2], "aminos string")
    ions = {r.aminos: [(i.series, i.n, i.mz) for i in r.i if i.series in "by"] for r in peptides.distinct().select("aminos", X.fragment_ions(F.col("aminos")).alias("i")).collect()}
    for widest, search in ((2.5, spectra.search_spectra), (20.0, spectra.open_search)):
        want = set()
        for s, m in spectra_rows:
            own, scored = [p[1] for p in peak_rows if p[0] == s], []
            for w in words:
                d = m - mass[w]
                n = sum(any(abs(i - p) <= 0.5 or (widest > 3 and abs((i - mass[w]) - (p - m)) <= 0.5) for p in own) for _, _, i in ions[w])
                if abs(d) <= widest and n:
                    scored.append((-n, abs(d) if widest > 3 else 0, w))
            want |= {(s, w, -n, place) for place, (n, _, w) in enumerate(sorted(scored)[:3], 1)}
        out = search(precursors, peaks, peptides, widest)
        assert {(r.spectrum, r.aminos, r.shared, r.place) for r in out.collect()} == want and len(want) > 5
        assert "_rbin" not in out._jdf.queryExecution().toString()  # no rows of single ions meet


def test_localize_without_ion_rows(spark):
    peaks = spark.createDataFrame([(1, 50.0, 1.0)], "spectrum long, mz double, intensity double")
    out = spectra.localize(spark.createDataFrame([(1, "ASTYK", 1), (2, "SGT", 1), (2, "S", 1), (3, "AG", 1)], "spectrum long, aminos string, n_sites int"), peaks)
    assert sorted((r.spectrum, r.aminos, r.sites, r.found, r.score) for r in out.collect()) == [(1, "ASTYK", [1], 0, 0.0), (2, "SGT", [0], 0, 0.0)]
    assert "_rbin" not in out._jdf.queryExecution().toString()


def test_written_files_are_few(spark, tmp_path):
    # every task wrote into every folder
    df = spark.range(4000).select((F.col("id") % 50).cast("string").alias("spectrum_file"), "id").repartition(8)
    tables.write_by_file(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*/*.parquet"))) <= 60
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 4000
