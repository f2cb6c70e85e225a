"""Peptide-spectrum matches: filters, top hits, decoy-based p-values and local FDR."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges

#: Weights of the F-score.
MQ_WEIGHT, DELTA_WEIGHT = 0.3, 1.5


def by_scan() -> Window:
    return Window.partitionBy("spectrum_file", "scan").orderBy("rank")


def charge_class() -> Column:
    """3 for charge 3 and above, else 2."""
    return F.when(F.col("charge") < 3, 2).otherwise(3)


def confident(psm: DataFrame, limit: float) -> DataFrame:
    """F1."""
    return psm.where(F.coalesce("lfdr", "p_value") <= limit)


def top_hit(psm: DataFrame) -> DataFrame:
    """The first row of each spectrum."""
    return psm.withColumn("_n", F.row_number().over(by_scan())).where("_n = 1").drop("_n")


def quality_filter(psm: DataFrame, p: float, delta: float = -3.5, length: int = 7, mq: float = -10) -> DataFrame:
    """rows that pass all cuts and stand before the spectrum's first decoy."""
    seen = F.max(F.col("is_decoy").cast("int")).over(by_scan().rowsBetween(Window.unboundedPreceding, 0))
    return psm.withColumn("_d", seen).where((F.col("_d") == 0) & (F.col("delta") >= delta) & (F.col("length") >= length) & (F.col("mq_score") >= mq) & (F.col("p_value") <= p)).drop("_d")


def best_per_scan(psm: DataFrame, p: float, every: bool = False) -> DataFrame:
    """the row with the least spectral p-value at or below p (or every such row)."""
    good = psm.where(F.col("lfdr") <= p)
    if every:
        return good
    w = Window.partitionBy("spectrum_file", "scan").orderBy("lfdr", "rank")
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_weak_runners_up(psm: DataFrame, p: float) -> DataFrame:
    """F4."""
    return psm.where((F.col("rank") == 1) | (F.col("p_value") <= p))


def modified_only(psm: DataFrame, mark: str = "phos") -> DataFrame:
    """F8: rows whose annotation carries the mark."""
    return psm.where(F.col("annotation").contains(mark))


def guideline_subset(psm: DataFrame) -> DataFrame:
    """F8: modified peptides, and those of proteins with a single peptide."""
    n = psm.groupBy("protein").agg(F.count_distinct("aminos").alias("_n"))
    return psm.join(n, "protein").where((F.col("_n") == 1) | F.col("is_modified")).drop("_n")


def min_peptides_per_file(psm: DataFrame, least: int = 2) -> DataFrame:
    """F9."""
    n = psm.groupBy("spectrum_file", "protein").agg(F.count_distinct("aminos").alias("n")).where(F.col("n") >= least)
    return psm.join(n, ["spectrum_file", "protein"], "left_semi")


def mean_delta(psm: DataFrame, length: int = 7, first: bool = False) -> DataFrame:
    """A2: (charge_class, mean_delta) over top hits (first: psm has no others); zero becomes 0.001."""
    good = (psm if first else top_hit(psm)).where((F.col("length") >= length) & (F.col("delta") >= 0))
    mean = good.groupBy(charge_class().alias("charge_class")).agg(F.avg("delta").alias("mean_delta"))
    return mean.withColumn("mean_delta", F.when(F.col("mean_delta") == 0, 0.001).otherwise(F.col("mean_delta")))


def with_f_score(psm: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """psm with charge_class, f_score and bin = round(10 f); the two-row mean_delta table is broadcast."""
    deltas = mean_delta(psm) if deltas is None else deltas
    scored = psm.withColumn("charge_class", charge_class()).join(F.broadcast(deltas), "charge_class")  # at most two rows
    scored = scored.withColumn("f_score", MQ_WEIGHT * F.col("mq_score") + DELTA_WEIGHT * F.col("delta") / F.col("mean_delta"))
    return scored.withColumn("bin", F.round(F.col("f_score") * 10).cast("long")).drop("mean_delta")


def score_histogram(psm: DataFrame, weight: str | None = None, length: int = 7, first: bool = False) -> DataFrame:
    """A3: (charge_class, bin, hits, decoy_hits) of top hits (first: psm has no others); psm with f_score columns."""
    w = F.coalesce(F.col(weight), F.lit(1)) if weight else F.lit(1)
    top = (psm if first else top_hit(psm)).where(F.col("length") >= length)
    return top.groupBy("charge_class", "bin").agg(F.sum(F.when(~F.col("is_decoy"), w).otherwise(0)).alias("hits"), F.sum(F.when(F.col("is_decoy"), w).otherwise(0)).alias("decoy_hits"))


def running_fdr(hist: DataFrame) -> DataFrame:
    """Cumulative hits and decoys from the best bin down."""
    w = Window.partitionBy("charge_class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cum_hits", F.sum("hits").over(w)).withColumn("cum_decoys", F.sum("decoy_hits").over(w))


def fdr_table(hist: DataFrame, decoy_fraction: float = 0.5, retain: bool = False, monotone: bool = False) -> DataFrame:
    """A1: (charge_class, bin, odds, p_value) for every bin between the ends.

    odds: share of true hits at or above the bin, the decoys scaled by
    (1 - S) / S; p = 1 - odds. monotone gives q-values.
    """
    s = (1 - decoy_fraction) / decoy_fraction
    full = ranges.bin_spine(hist, ["charge_class"], "bin").join(hist, ["charge_class", "bin"], "left").na.fill(0, ["hits", "decoy_hits"])
    cum = running_fdr(full)
    v, i = F.col("cum_hits"), F.col("cum_decoys")
    below = F.greatest(v + i, F.lit(1)) if retain else F.greatest(v, F.lit(1))
    odds = F.greatest(F.lit(0), v - F.least(v, i * s)) / below
    out = cum.select("charge_class", "bin", odds.cast("double").alias("odds"))
    if monotone:
        out = out.withColumn("odds", F.max("odds").over(Window.partitionBy("charge_class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("p_value", 1 - F.col("odds"))


def assign_pvalue(scored: DataFrame, table: DataFrame) -> DataFrame:
    """A4: p-values by bin; clamped to [1e-5, 0.99999], and by the bin's sign where the table has no bin."""
    hit = scored.drop("p_value").join(ranges.small(table.select("charge_class", "bin", "odds")), ["charge_class", "bin"], "left")
    odds = F.greatest(F.lit(1e-5), F.least(F.lit(0.99999), F.coalesce("odds", F.when(F.col("bin") < 0, 1e-5).otherwise(0.99999))))
    return hit.withColumn("p_value", 1 - odds).drop("odds")


def assign_lfdr(psm: DataFrame, width: float = 0.01) -> DataFrame:
    """A5: forward hits with local_fdr of their p-value bin and class, and fdr, the rate of decoys in that bin and all
    bins of larger p-values."""
    binned = psm.withColumn("charge_class", charge_class()).withColumn("bin", F.floor(F.col("p_value") / width))
    hist = binned.groupBy("charge_class", "bin").agg(F.count_if(~F.col("is_decoy")).alias("tp"), F.count_if("is_decoy").alias("fp"))
    w = Window.partitionBy("charge_class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    rate = hist.select("charge_class", "bin", (F.col("fp") / (F.col("tp") + F.col("fp"))).alias("local_fdr"), (F.sum("fp").over(w) / (F.sum("tp").over(w) + F.sum("fp").over(w))).alias("fdr"))
    return binned.where(~F.col("is_decoy")).join(ranges.small(rate), ["charge_class", "bin"])


#: A mixture of false scores (gamma, moved by an offset) and true ones (normal), per class.
Mixture = dict[str, float]


def mixture_start(first_bin: int, last_bin: int, width: float = 0.1) -> Mixture:
    """Means a quarter inside the range, variances a tenth of it, a true share of a tenth; the gamma begins where the
    scores do, unless they begin between 0 and 0.1."""
    low, high = first_bin * width, (last_bin + 1) * width
    reach = high - low
    return {"mean_true": high - reach / 4, "var_true": reach / 10, "mean_false": low + reach / 4, "var_false": reach / 10, "prior": 0.1, "offset": 0.0 if 0 <= low <= 0.1 else -low}


def odds_true(score: Column, model: Column) -> Column:
    """Probability that a hit of this score is true, by a struct of a mixture's parameters. Far below the true mean
    the gamma, and far above it the normal, is held at 0.001 at least."""
    m = lambda name: model[name]
    theta = m("var_false") / (m("mean_false") + m("offset"))
    normal = F.exp(-(score - m("mean_true")) * (score - m("mean_true")) / (2 * m("var_true"))) / F.sqrt(2 * math.pi * m("var_true"))
    g = F.greatest(score + m("offset"), F.lit(0.01))
    gamma = F.exp((m("shape") - 1) * F.log(g) - g / theta - m("shape") * F.log(theta) - m("log_gamma"))
    gamma = F.when(score < m("mean_true") - m("var_true"), F.greatest(gamma, F.lit(0.001))).otherwise(gamma)
    normal = F.when(score > m("mean_true") + m("var_true"), F.greatest(normal, F.lit(0.001))).otherwise(normal)
    return F.coalesce(F.try_divide(normal * m("prior"), normal * m("prior") + gamma * (1 - m("prior"))), F.lit(0.0))


def models_table(spark: SparkSession, models: dict[int, Mixture]) -> DataFrame:
    """(charge_class, model), a row per class. Parameters as rows, not as code, so that all cycles share compiled code."""
    rows = []
    for c, m in models.items():
        shape = (m["mean_false"] + m["offset"]) ** 2 / m["var_false"]
        given = {**m, "shape": shape, "log_gamma": math.lgamma(shape)}
        rows.append(f"({c}, named_struct({', '.join(f"'{n}', {float(v)!r}D" for n, v in given.items())}))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS m(charge_class, model)")


def mixture_step(bins: DataFrame, models: dict[int, Mixture], width: float = 0.1) -> DataFrame:
    """A6, one step as one aggregate: (charge_class, n, sx, sxx, t, tx, txx), sums over all hits of 1, x and x squared, and
    the same weighted by the odds of being true, x being a bin's score.

    bins: (charge_class, bin, hits), every bin between the ends. A bin below 0 has odds of 1 / -bin at most, one at the
    true mean or above those of the best bin so far at least.
    """
    x = F.col("bin") * width
    raw = odds_true(x, F.col("model"))
    rows = bins.join(F.broadcast(models_table(bins.sparkSession, models)), "charge_class")  # a row per class
    rows = rows.select("charge_class", "bin", F.col("model.mean_true").alias("mean"), x.alias("x"), F.col("hits").cast("double").alias("n"), F.when(F.col("bin") < 0, F.least(raw, F.try_divide(F.lit(-1.0), F.col("bin")))).otherwise(raw).alias("w"))
    best = F.max("w").over(Window.partitionBy("charge_class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # a row per bin
    rows = rows.withColumn("w", F.when(F.col("x") >= F.col("mean"), best).otherwise(F.col("w")))
    powers = {"n": F.lit(1.0), "sx": F.col("x"), "sxx": F.col("x") * F.col("x")}
    sums = [F.sum(F.col("n") * v).alias(k) for k, v in powers.items()] + [F.sum(F.col("n") * F.col("w") * v).alias(k.replace("s", "t") if k != "n" else "t") for k, v in powers.items()]
    return rows.groupBy("charge_class").agg(*sums)


def next_mixture(row, model: Mixture) -> Mixture | None:
    """The parameters after a step; None where one kind has no hits or no spread left."""
    t, f = row.t, row.n - row.t
    if t <= 0 or f <= 0:
        return None
    mt, mf = row.tx / t, (row.sx - row.tx) / f
    vt, vf = row.txx / t - mt * mt, (row.sxx - row.txx) / f - mf * mf
    if vt <= 0 or vf <= 0:
        return None
    offset = model["offset"] + (0.5 if mf + model["offset"] < 0.1 else 0.0)
    return {"mean_true": mt, "var_true": vt, "mean_false": mf, "var_false": vf, "prior": t / row.n, "offset": offset} if mf + offset > 0 else None


def fit_mixture(hist: DataFrame, cycles: int = 300, tolerance: float = 1e-6, width: float = 0.1) -> dict[int, Mixture]:
    """Per class a gamma (false) and a normal (true) component fitted to the histogram (charge_class, bin, hits) by
    EM. Every cycle is one aggregate over the bins of all classes, however many; a row per class goes to the driver. A
    class stops when no parameter moves by more than `tolerance`, or where a component vanishes."""
    full = ranges.bin_spine(hist, ["charge_class"], "bin").join(hist.select("charge_class", "bin", "hits"), ["charge_class", "bin"], "left").na.fill(0, ["hits"])
    full = ranges.stored(full)
    ends = full.groupBy("charge_class").agg(F.min("bin").alias("a"), F.max("bin").alias("z")).collect()  # a row per class
    models = {r.charge_class: mixture_start(r.a, r.z, width) for r in ends}
    going = set(models)
    for _ in range(cycles):
        if not going:
            break
        for row in mixture_step(full, {c: models[c] for c in going}, width).collect():
            new = next_mixture(row, models[row.charge_class])
            if new is None or max(abs(new[k] - models[row.charge_class][k]) for k in new) < tolerance:
                going.discard(row.charge_class)
            models[row.charge_class] = new or models[row.charge_class]
    return models


def rollup_peptides(psm: DataFrame) -> DataFrame:
    """(aminos, is_decoy, best_p, spectra, sources)."""
    source = F.struct("spectrum_file", "scan")
    return psm.groupBy("aminos", "is_decoy").agg(F.min(F.coalesce("lfdr", "p_value")).alias("best_p"), F.count("*").alias("spectra"), F.array_sort(F.collect_set(source)).alias("sources"))


def delta_scores(psm: DataFrame) -> DataFrame:
    """Delta of the best row to the second, of the others to the best; a single row has max(0, score)."""
    w = Window.partitionBy("spectrum_file", "scan")
    o = w.orderBy(F.desc("mq_score"), "rank")
    first, second = F.first("mq_score").over(o), F.lead("mq_score").over(o)
    no = F.row_number().over(o)
    alone = F.count("*").over(w) == 1
    return psm.withColumn("delta_any", F.when(alone, F.greatest(F.lit(0.0), F.col("mq_score"))).when(no == 1, F.col("mq_score") - second).otherwise(F.col("mq_score") - first))


def delta_dissimilar(psm: DataFrame) -> DataFrame:
    """Delta of each row to the best row of its spectrum outside its family (places within 3, or fewer than
    2 differing residues); without one as for a single row."""
    o = psm.select("spectrum_file", "scan", F.col("rank").alias("_r"), F.col("mq_score").alias("_s"), F.col("aminos").alias("_a"), F.col("db_pos").alias("_p"))
    same = F.length("aminos") == F.length("_a")
    differ = F.size(F.filter(F.zip_with(F.split("aminos", ""), F.split("_a", ""), lambda x, y: x != y), lambda d: d))
    family = (F.abs(F.col("db_pos") - F.col("_p")) <= 3) | (same & (differ < 2))
    pairs = psm.select("spectrum_file", "scan", "rank", "aminos", "db_pos").join(o, ["spectrum_file", "scan"]).where((F.col("rank") != F.col("_r")) & ~family)
    other = pairs.groupBy("spectrum_file", "scan", "rank").agg(F.max("_s").alias("_o"))
    return psm.join(other, ["spectrum_file", "scan", "rank"], "left").withColumn("delta_other", F.coalesce(F.col("mq_score") - F.col("_o"), F.greatest(F.lit(0.0), F.col("mq_score")))).drop("_o")


def searched_scans(psm: DataFrame) -> DataFrame:
    """(spectrum_file, scans, max_scan, has_repeats)."""
    return psm.groupBy("spectrum_file").agg(F.count_distinct("scan").alias("scans"), F.max("scan").alias("max_scan"), (F.count("*") > F.count_distinct("scan")).alias("has_repeats"))


def discovery_curve(psm: DataFrame, order: list[str]) -> DataFrame:
    """Per spectrum file the peptides first seen in it and the running sum, files in the given order.

    The running sum is over one row per file, dealt by ranges of the order.
    """
    first = psm.groupBy("aminos").agg(F.min(F.struct(*order)).alias("o"))
    new = first.groupBy("o").agg(F.count("*").alias("new_peptides")).select("o.*", "new_peptides")
    rows = ranges.carried(ranges.placed(new, [], order), [], _before=(F.sum("new_peptides"), F.sum))
    here = F.sum("new_peptides").over(ranges.inside([], order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("seen", here + F.coalesce("_before", F.lit(0))).select(*order, "new_peptides", "seen")


def engine_consensus(psm: DataFrame, k: int = 2) -> DataFrame:
    """Per spectrum the engines, the conflict flag and whether k engines agree on some peptide."""
    votes = psm.groupBy("spectrum_file", "scan", "aminos").agg(F.count_distinct("engine").alias("n"))
    top = votes.groupBy("spectrum_file", "scan").agg(F.max("n").alias("witnesses"), F.count("*").alias("peptides"))
    engines = psm.groupBy("spectrum_file", "scan").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    both = engines.join(top, ["spectrum_file", "scan"])
    return both.select("spectrum_file", "scan", "engines", (F.col("peptides") > 1).alias("conflict"), (F.col("witnesses") >= k).alias("agreed"))


def engine_venn(psm: DataFrame) -> DataFrame:
    """(engines, spectra): spectra by the set of engines that identified them."""
    by = psm.groupBy("spectrum_file", "scan").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    return by.groupBy("engines").agg(F.count("*").alias("spectra"))


def missed_by(psm: DataFrame, engine: str, k: int = 2) -> DataFrame:
    """(spectrum_file, scan, aminos, witnesses): peptides that k other engines agree on and this engine lacks."""
    votes = psm.groupBy("spectrum_file", "scan", "aminos").agg(F.count_distinct(F.when(F.col("engine") != engine, F.col("engine"))).alias("witnesses"), F.max(F.col("engine") == engine).alias("has"))
    return votes.where((F.col("witnesses") >= k) & ~F.col("has")).select("spectrum_file", "scan", "aminos", "witnesses")


def competing_search(x: DataFrame, y: DataFrame, ratio: float = 0.75, margin: float = 0.5, p: float = 0.12) -> DataFrame:
    """Drop spectra that the other search explains better than their first row; of the rest keep p below the cut."""
    best = top_hit(y).select("spectrum_file", "scan", F.col("p_value").alias("_p"), F.col("mq_score").alias("_s"))
    w = by_scan()
    joined = x.join(best, ["spectrum_file", "scan"], "left").withColumn("_fp", F.first("p_value").over(w)).withColumn("_fs", F.first("mq_score").over(w))
    better = F.coalesce((F.col("_p") < ratio * F.col("_fp")) & (F.col("_s") > F.col("_fs") + margin), F.lit(False))
    return joined.where(~better & (F.col("p_value") < p)).drop("_p", "_s", "_fp", "_fs")


def diff_results(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per spectrum in_a, in_b, same_peptides (I = L, Q = K) and the number of differing columns of the top rows."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        peptides = df.groupBy("spectrum_file", "scan").agg(F.array_sort(F.collect_set(F.translate("aminos", "IQ", "LK"))).alias(f"{mark}_p"))
        return peptides.join(top_hit(df).select("spectrum_file", "scan", *[F.col(c).alias(f"{mark}_{c}") for c in columns]), ["spectrum_file", "scan"])

    both = side(a, "a").join(side(b, "b"), ["spectrum_file", "scan"], "full_outer")
    differ = sum((F.coalesce((F.col(f"a_{c}") != F.col(f"b_{c}")).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return both.select("spectrum_file", "scan", F.col("a_p").isNotNull().alias("in_a"), F.col("b_p").isNotNull().alias("in_b"), F.coalesce(F.col("a_p") == F.col("b_p"), F.lit(False)).alias("same_peptides"), differ.alias("differing"))
