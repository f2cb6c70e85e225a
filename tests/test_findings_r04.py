import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orfspark.functions import expr as X, grams
from orfspark.operators import genome, inference, psm as P, ranges, spectra, splice
from orfspark.plans import adapters as V, pipelines

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines(spark, n, orders, parts=30):
    rng = np.random.default_rng(3)
    at = np.datetime64("2024-01-01").astype("datetime64[us]").item()
    some = lambda k: int(rng.integers(k)) if rng.random() > 0.03 else None
    return spark.createDataFrame([(some(orders), some(parts), some(5), int(rng.integers(1, 4)), float(rng.integers(50)), float(rng.integers(90_000)), 0.05, 0.02, "R" if rng.random() < 0.3 else "N", "O", at) for _ in range(n)], LINES)


def sent(df):
    """Columns of all shuffles of a plan."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.initialPlan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_ranked_lines_are_those_of_the_view(spark):
    li = lines(spark, 400, 60)
    named = lambda df: sorted(map(str, df.collect()))
    assert named(V.ranked(li).drop("several")) == named(V.psm_of(li)) and li.groupBy("l_orderkey", "l_suppkey").count().where("count > 1").count() > 20


def test_a_run_meets_residues_when_hits_are_counted(spark):
    """hits that name peptides by number give what hits of each of the peptides give."""
    rng = np.random.default_rng(8)
    codons = [c for c in (a + b + d for a in "ACGT" for b in "ACGT" for d in "ACGT") if c not in ("TAA", "TAG", "TGA")]
    made = lambda: "".join("TAA" if rng.random() < 0.01 else rng.choice(codons) for _ in range(1_500))
    contigs = spark.createDataFrame([(f"c{i}", made()) for i in range(2)], "chrom string, seq string")
    orfs = pipelines.named_orfs(contigs)
    digested = genome.digest(orfs.where("length >= 40").withColumn("seq_id", F.col("orf_name")), 0, 9, 30)
    texts = sorted({r.aminos for r in digested.collect()})
    peptides = spark.createDataFrame([(i % 25, t) for i, t in enumerate(texts)], "aminos long, peptide string")
    psm = V.psm_of(lines(spark, 300, 1_000, 25))
    each = psm.join(peptides, "aminos").withColumn("aminos", F.col("peptide")).drop("peptide")
    top = each.select("spectrum_file", "scan", "charge", "mq_score", "delta", "length", "is_decoy").withColumn("length", F.lit(9.0))
    cds = orfs.where("length > 30").select("chrom", "strand", "start", "stop", F.col("orf_name").alias("protein_id"))
    one = pipelines.run_all(contigs, each, cds, 0.9, top=top)
    two = pipelines.run_all(None, psm, cds, 0.9, top=top, peptides=peptides, orfs=orfs)
    assert one["located"].count() > 20 and one["report"].first().spectra > 100
    for part in one:
        assert sorted(map(str, one[part].collect())) == sorted(map(str, two[part].collect())), part
    assert not any("peptide" in x and "mq_score" in x for x in sent(two["report"]))


def test_short_texts_are_grouped_in_place():
    """a group's lists were copied for each text, which took the square of their number."""
    texts = ["ACDEFGHK"] * 60_000
    began = time.process_time()
    assert sum(len(n) for n, _, _ in grams.groups(texts, 5)) == len(texts) and time.process_time() - began < 5


def test_only_spectra_of_several_rows_are_put_in_order(spark, tmp_path):
    """Rows of spectra that have one each leave no task to be ranked, and queries are written packed."""
    li = lines(spark, 400, 60).where("l_orderkey is not null and l_suppkey is not null and l_partkey is not null")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    from orfspark.plans import catalog, catalog_sources

    got = catalog.QUERIES["a4_assign_pvalue"](spark, str(tmp_path))
    psm = P.with_f_score(V.psm(spark, str(tmp_path)))
    wanted = catalog.r6(P.assign_pvalue(psm, P.fdr_table(P.score_histogram(psm))), "p_value").select(got.columns)
    named = lambda df: sorted(map(str, df.collect()))
    assert named(got) == named(wanted)
    hits = V.ranked(V.table(spark, str(tmp_path), "lineitem"))
    path = catalog_sources.written_pepxml(spark, hits)
    assert all(x.endswith(".gz") for x in os.listdir(path.removeprefix("file://")) if x.startswith("part"))
    read = catalog_sources.pepxml(spark, str(tmp_path))
    first = V.psm(spark, str(tmp_path)).where("rank = 1").select(F.concat_ws("", F.lit("f"), "spectrum_file", F.lit("."), "scan").alias("title"), F.col("scan").cast("int"), F.col("charge").cast("int"), F.concat_ws("", F.lit("PEP"), "aminos").alias("aminos"))
    assert named(read.select("title", "scan", "charge", "aminos")) == named(first)


def test_ions_of_many_peptides_are_those_of_each(spark):
    texts = ["", "K", "PEPTIDE", "AXZBK", "éA😀K", "GGGGGGGGGGGGGGGGGGGGGGGW", "WK"]
    mz, owner = spectra.main_ions_of(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.main_ions(F.col("t"))["mz"].alias("mz")).collect()
    assert {r.i: sorted(r.mz) for r in rows} == {i: sorted(mz[owner == i]) for i in range(len(texts))}


@pytest.mark.parametrize("most", [4, 4_000])
def test_searches_of_spectra_that_are_alike(spark, monkeypatch, most):
    """spectra with the same masses and peaks are searched once; parts of a bin are dealt as pairs."""
    rng = np.random.default_rng(4)
    letters = list("GASPVTCLINDQKEMHFRYWX")
    texts = sorted({"".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(2_000)})
    lists = [sorted({float(x) for x in rng.integers(50, 700, 25)}) for _ in range(4)] + [[]]
    spectra_ = [(i, sorted({float(m) for m in rng.choice([400.0, 403.5, 409.25, 600.0], 1 + i % 2)}), lists[i % 5]) for i in range(40)]
    wanted = {True: set(), False: set()}
    peptides = spark.createDataFrame([(t,) for t in [*texts, *texts[:9]]] + [(None,)], "aminos string")
    mass = {r.aminos: (r.m, list(r.i)) for r in peptides.where("aminos is not null").select("aminos", X.parent_mass_of(F.col("aminos")).alias("m"), X.main_ions(F.col("aminos"))["mz"].alias("i")).collect()}
    for moved, tol in ((False, 2.5), (True, 20.0)):
        for i, masses, mzs in spectra_:
            found = []
            for t, (p, ions) in mass.items():
                near = [m for m in masses if abs(m - p) <= tol]
                if near:
                    m = near[0]
                    shared = sum(any(abs(x - z) <= 0.5 or (moved and abs((x - p) - (z - m)) <= 0.5) for z in mzs) for x in ions)
                    if shared:
                        found.append((-shared, abs(m - p) if moved else 0, t, m - p))
            wanted[moved] |= {(i, t, -n, place) + ((d,) if moved else ()) for place, (n, _, t, d) in enumerate(sorted(found)[:3], 1)}
    precursors = spark.createDataFrame([(i, m) for i, masses, _ in spectra_ for m in masses], "spectrum long, mass double")
    peaks = spark.createDataFrame([(i, m, 1.0) for i, _, mzs in spectra_ for m in mzs], "spectrum long, mz double, intensity double")
    parts = spectra.best_candidates
    sizes = []

    def counted(*args):
        met, own = parts(*args, *([False] if len(args) == 6 else []), most)
        sizes.append(own.select("lead").distinct().count())
        return met, own

    monkeypatch.setattr(spectra, "best_candidates", counted)
    got = {tuple(r) for r in spectra.search_spectra(precursors, peaks, peptides).select("spectrum", "aminos", "shared", "place").collect()}
    assert got == wanted[False] and len(got) > 20
    got = {tuple(r) for r in spectra.open_search(precursors, peaks, peptides, 20.0).select("spectrum", "aminos", "shared", "place", "delta_mass").collect()}
    assert got == wanted[True] and sizes[0] < 32


def widths(monkeypatch):
    seen, bins = [], ranges.exploded_bins
    monkeypatch.setattr(ranges, "exploded_bins", lambda df, start, stop, width, *name: seen.append(width) or bins(df, start, stop, width, *name))
    return seen


def test_overlaps_meet_in_bins_that_fit_them(spark, monkeypatch):
    """in bins of 10,000, all pairs of a bin were compared, however short the ORFs were."""
    rng, seen = np.random.default_rng(5), widths(monkeypatch)
    rows = [("c" if i % 3 else None if i % 7 == 0 else "d", i, int(a), int(a) + int(rng.integers(-2, 30)), int(rng.integers(3))) for i, a in enumerate(rng.integers(-500, 3_000, 300))] + [("c", 400, None, 5, 1), ("d", 401, 0, 2_900, 1)]
    df = spark.createDataFrame(rows, "chrom string, orf_name long, start long, stop long, spectra long")
    whole = [r for r in rows if None not in r]
    wanted = {(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in whole for y in whole if x[0] == y[0] and x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3] and (x[4] or y[4])}
    got = [tuple(r) for r in genome.overlaps(df).select("chrom", "a", "b", "bp").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(got) > 200 and max(seen) < 100
    assert genome.overlaps(df.where("false")).count() == 0


def test_categories_of_hits_that_are_alike(spark, monkeypatch):
    """hits of the same segments, and genes of the same exons, meet once for all of them."""
    seen, met, join = widths(monkeypatch), [], ranges.contained_in
    monkeypatch.setattr(ranges, "contained_in", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    rng = np.random.default_rng(6)
    genes = {g: sorted({(int(a), int(a) + 60) for a in rng.choice([0, 100, 200, 300], 3)}) for g in range(12)}
    genes[12], genes[None] = genes[0], [(100, 160)]
    exons = spark.createDataFrame([("c", "+", a, z, g) for g, of in genes.items() for a, z in of], "chrom string, strand string, start long, stop long, gene_id long")
    hits = []
    for i in range(120):
        segments = [(int(a) + int(rng.integers(0, 2)) * 5, int(a) + 60 - int(rng.integers(0, 2)) * 5) for a in sorted(rng.choice([0, 100, 200, 300], int(rng.integers(1, 5)), replace=False))]
        hits.append((None if i == 5 else i // 2 if i < 20 else i, "c" if i % 11 else "d", "+", segments, 0.01 if i % 9 else 0.2, 9, i % 3, i % 5 == 0))
    hits += [(1_000 + i, *h[1:]) for i, h in enumerate(hits)]
    wanted = []
    for hit, _, _, segments, p, _, mm, inp in hits:
        own = [h for h in hits if h[0] == hit and hit is not None]
        fits, both, edge = 0, False, False
        for of in genes.values():
            for n in {len(h[3]) for h in own}:
                placed = [(no, s, e) for h in own if h[1] == "c" and len(h[3]) == n for no, s in enumerate(h[3]) for e in of if e[0] <= s[0] and s[1] <= e[1]]
                f, edges = len({no for no, _, _ in placed}), len({no for no, s, e in placed if no < n - 1 and s[1] == e[1]}) + len({no for no, s, e in placed if no > 0 and s[0] == e[0]})
                if placed:
                    fits, both, edge = max(fits, f), both or (f == n and edges == 2 * n - 2), edge or edges > 0
        n = len(segments)
        if p > 0.05:
            c = 0
        elif n == 1:
            c = (1 if inp else 2) if fits else 8 if mm > 1 else 1 if inp else 3
        elif n <= 3:
            c = (4 if inp else 5) if both else (4 if inp else 6) if edge else 8 if mm > 1 else 7
        else:
            c = 9
        wanted.append((hit, c))
    df = spark.createDataFrame(hits, "hit long, chrom string, strand string, segments array<struct<start: long, stop: long>>, p_value double, length int, mismatches int, in_protein boolean")
    got = [tuple(r) for r in splice.categorize_hits(df, exons).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    once = met[0]
    assert max(seen) < 100 and once.select("lead").distinct().count() < 110 and once.where("gene_id = 12").count() == 0


def test_a_large_component_takes_few_bytes_a_pair():
    """a component was held as a table and in eight-byte numbers, so 12 million pairs took what 36 million take now."""
    rng = np.random.default_rng(9)
    pairs = np.unique(rng.integers(0, 2_000, (1_500_000, 2)) * [1, 3], axis=0)
    pairs = pairs[rng.permutation(len(pairs))]
    spectra_ = rng.integers(1, 5, len(pairs))
    cut = lambda i: pa.RecordBatch.from_arrays([pa.array(np.char.add("P", pairs[i : i + 10_000, 0].astype(str))), pa.array(pairs[i : i + 10_000, 1]), pa.array(spectra_[i : i + 10_000])], ["protein", "aminos", "spectra"])
    inference.cover_rounds([cut(0)], 1, 0)
    tracemalloc.start()
    got = inference.cover_rounds((cut(i) for i in range(0, len(pairs), 10_000)), 1, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(pairs) and len(pairs) > 1_200_000
    assert sorted(got["aminos"].to_pylist()) == sorted(set(pairs[:, 1].tolist()))
    # one best protein at a time, until no peptide is left
    left, order = {}, {}
    for (p, a), n in zip(pairs.tolist(), spectra_.tolist(), strict=True):
        left.setdefault(f"P{p}", {})[a] = n
    gone: set[int] = set()
    while left:
        best = min(left, key=lambda p: (-len(left[p]), -sum(left[p].values()), p))
        order[best] = set(left.pop(best))
        gone = order[best]
        for p in list(left):
            left[p] = {a: n for a, n in left[p].items() if a not in gone}
            if not left[p]:
                del left[p]
    owned: dict[str, set[int]] = {}
    for p, a in zip(got["protein"].to_pylist(), got["aminos"].to_pylist(), strict=True):
        owned.setdefault(p, set()).add(a)
    assert owned == order and min(got["round"].to_pylist()) == 4


def test_numbers_of_values_keep_their_order():
    texts = ["b", "a", "é", "a", "z", "", "b"] * 3
    numbered = inference.Numbered()
    for i in range(0, len(texts), 2):
        numbered.add(pa.array(texts[i : i + 2]))
        if i % 6 == 0:
            numbered.fold()
    number, values = numbered.in_order()
    assert values.to_pylist() == sorted(set(texts)) and [values[int(i)].as_py() for i in number] == texts
    assert inference.counts_of(pa.array([1, 2**40])).dtype == float and inference.counts_of(pa.array([1, 2])).dtype == np.int32
