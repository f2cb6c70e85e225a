"""The mixture by EM, paired models, bounded top-k pairs and links of pieces, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfspark.functions import expr as X
from orfspark.operators import ml, psm as P, ranges, spectra


def plain_em(hist, cycles):
    """One class, as defined: hist is {bin: hits}."""
    lo, hi = min(hist), max(hist) + 1
    low, high = lo / 10, hi / 10
    mf, mt, vf, vt, prior = low + (high - low) / 4, high - (high - low) / 4, (high - low) / 10, (high - low) / 10, 0.1
    offset = 0.0 if 0 <= low <= 0.1 else -low
    for _ in range(cycles):
        theta = vf / (mf + offset)
        k = (mf + offset) / theta
        odds, best = {}, 0.0
        for b in range(lo, hi):
            x = b / 10
            normal = math.exp(-((x - mt) ** 2) / (2 * vt)) / math.sqrt(2 * math.pi * vt)
            g = max(0.01, x + offset)
            gamma = math.exp((k - 1) * math.log(g) - g / theta - k * math.log(theta) - math.lgamma(k))
            if x < mt - vt:
                gamma = max(gamma, 0.001)
            if x > mt + vt:
                normal = max(normal, 0.001)
            o = normal * prior / (normal * prior + gamma * (1 - prior))
            if b < 0:
                o = min(o, 1 / -b)
            best = max(best, o)
            odds[b] = best if x >= mt else o
        n = {b: hist.get(b, 0) for b in range(lo, hi)}
        t = sum(odds[b] * n[b] for b in n)
        f = sum(n.values()) - t
        mt = sum(b / 10 * odds[b] * n[b] for b in n) / t
        mf = sum(b / 10 * (1 - odds[b]) * n[b] for b in n) / f
        prior = t / (t + f)
        if mf + offset < 0.1:
            offset += 0.5
        vt = sum((b / 10 - mt) ** 2 * odds[b] * n[b] for b in n) / t
        vf = sum((b / 10 - mf) ** 2 * (1 - odds[b]) * n[b] for b in n) / f
    return {"mean_true": mt, "var_true": vt, "mean_false": mf, "var_false": vf, "prior": prior, "offset": offset}


def test_mixture(spark):
    rng = np.random.default_rng(1)
    scores = np.round(10 * np.concatenate([rng.gamma(4, 0.5, 3000) - 2, rng.normal(4, 0.7, 1500)])).astype(int)
    bins, counts = np.unique(scores, return_counts=True)
    hist = {int(b): int(c) for b, c in zip(bins, counts, strict=True)}
    other = {b + 30: c for b, c in hist.items() if b > 0}
    df = spark.createDataFrame([(2, b, c) for b, c in hist.items()] + [(3, b, c) for b, c in other.items()], "charge_class int, bin long, hits long")
    got = P.fit_mixture(df, 12, 0.0)
    assert got[2] == pytest.approx(plain_em(hist, 12), rel=1e-6) and got[3] == pytest.approx(plain_em(other, 12), rel=1e-6)
    assert got[2]["mean_true"] > got[2]["mean_false"]
    one = P.fit_mixture(spark.createDataFrame([(2, 5, 9)], "charge_class int, bin long, hits long"), 5)
    assert set(one) == {2}  # a single bin has no spread: the start stays
    scored = spark.createDataFrame([(float(x) / 10,) for x in scores], "score double")
    p = ml.mixture_p(scored, cycles=12).groupBy("score").agg(F.first("p_value").alias("p")).orderBy("score").collect()
    assert p[0].p > 0.9 and p[-1].p < 0.1


def test_paired_models(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.5), bool(i % 2)) for i in range(400)]
    rows = [(i, y, f, float(y + rng.normal(0, 0.6)), float(y - rng.normal(0, 0.8))) for i, y, f in rows]
    df = spark.createDataFrame(rows, "id int, label int, is_facultative boolean, x double, z double").repartition(3)
    scored = ml.predict_logit(ml.fit_logit(df, ["x", "z"]), df, ["x", "z"]).where("is_facultative")
    ordered = sorted((r.score, r.id) for r in scored.collect())
    got = ml.extremes(scored, ["id"], 30).collect()
    assert {r.id for r in got if r.label == 0} == {i for _, i in ordered[:30]} and {r.id for r in got if r.label == 1} == {i for _, i in ordered[-30:]}
    assert ml.extremes(scored, ["id"]).count() == 2 * (len(ordered) // 4)
    models, out = ml.fit_paired(df, ["x", "z"], ["x"], ["z"], ["id"], rounds=4)
    right = out.where((F.col("score") > 0.5).cast("int") == F.col("label")).count() / 400
    assert set(models) == {"facultative", "constitutive"} and out.count() == 400 and right > 0.7


def test_crosslinks_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    peptides = [(i, 700 + float(rng.integers(0, 40)) / 4, float(rng.integers(0, 60))) for i in range(300)]  # a crowd on a few daltons
    spectra_ = [(k, 769.0 + k / 3) for k in range(30)] + [(99, 100.0)]
    want = {}
    for scan, mz in spectra_:
        found = set()
        for z in (2, 3):
            target = mz * z - (z - 1) * X.PROTON - 138
            found |= {(-min(x[2], y[2]), x[0], y[0]) for x in peptides for y in peptides if x[0] <= y[0] and abs(x[1] + y[1] - target) <= 1}
        want |= {(scan, k + 1): (a, b, -n) for k, (n, a, b) in enumerate(sorted(found)[:5])}
    got = spectra.crosslink_candidates(spark.createDataFrame(peptides, "id int, mass double, abundance double"), spark.createDataFrame(spectra_, "scan int, mz double"), 138.0)
    assert {(r.scan, r.place): (r.a, r.b, r.least) for r in got.collect()} == want and len(want) > 50


def test_links_of_pieces(spark):
    # two overlapping intervals, a third behind: 1 = 1-10, 2 = 6-20, 3 = 31-40; links 1 -> 3 and 2 -> 3
    f = spark.createDataFrame([("c", 1, 1, 10), ("c", 2, 6, 20), ("c", 3, 31, 40), ("c", 4, 6, 20)], "chrom string, id int, start long, stop long")
    pieces = ranges.split_disjoint(f, ["chrom"], "start", "stop")
    links = spark.createDataFrame([(1, 3), (2, 3), (4, 3)], "from_id int, to_id int")
    got = ranges.relink(ranges.stored(pieces), f, links, ["chrom"], "start", "stop")
    # pieces 1: 1-5, 2: 6-10, 3: 11-20, 4: 31-40; 1 ends with piece 2, 2 and 4 with piece 3
    assert sorted((r.from_piece, r.to_piece, r.kind, r.links) for r in got.collect()) == [(1, 2, "adjacent", 0), (2, 3, "adjacent", 0), (2, 4, "link", 1), (3, 4, "link", 2)]
