"""Models on feature tables, ranking measures and feature statistics."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .psm import fit_mixture, models_table, odds_true
from .ranges import bin_spine, following, placed, running_above, stored


def order_statistics(df: DataFrame, column: str, places: list[int]) -> list[float | None]:
    """Values at places (from 0) of a column in rising order, nulls left out: rows are counted by value, and the counts
    run up over ranges of values, so no task sees all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    up = running_above(counts.withColumn("_o", -F.col("x")), "_o", ["n"])
    wanted = F.explode(F.array(*[F.lit(p) for p in places])).alias("place")
    at = up.select("x", F.col("n_above").alias("lo"), (F.col("n_above") + F.col("n")).alias("hi"), wanted).where("place >= lo and place < hi")
    found = {r.place: r.x for r in at.collect()}  # a row per place
    return [found.get(p) for p in places]


def scale_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1: each column mapped so that its values at 2.5 and 97.5 percent of the rows, in rising order, become -1 and 1;
    0 where they are equal."""
    n = df.count()
    place = lambda share: min(int(n * share + 0.5), max(n - 1, 0))
    out = df
    for c in cols:
        lo, hi = order_statistics(df, c, [place(0.025), place(0.975)])
        out = out.withColumn(c, (F.col(c) - lo) / ((hi - lo) / 2) - 1 if lo is not None and hi is not None and hi > lo else F.lit(0.0))
    return out


def prior_false(df: DataFrame, database_ratio: float) -> float:
    """M1: share of false rows, those among label 1 being as many as label 0 has times database_ratio (sizes of the true
    to the false database); 0.99 where that leaves no true ones."""
    r = df.agg(F.count_if(F.col("label") == 0).alias("f"), F.count_if(F.col("label") == 1).alias("t")).first()
    hidden = r.f * database_ratio
    return 0.99 if hidden >= r.t else (r.f + hidden) / (r.t + r.f)


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def fit_lda(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, float]:
    """M2: (weights, constant) of the discriminant of label 1 against 0; means and scatter are sums on Spark, the
    solve is of the number of features."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]]
    rows = {r.label: r for r in df.groupBy("label").agg(*sums).collect()}
    d, total = len(cols), sum(r.n for r in rows.values())
    pooled, means = np.zeros((d, d)), {}
    for label, r in rows.items():
        mean = np.array([r[f"s{i}"] / r.n for i in range(d)])
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r.n - mean[i] * mean[j]
        pooled += cov * r.n / total
        means[label] = mean
    inverse = np.linalg.pinv(pooled)
    w = inverse @ (means[1] - means[0])
    return w, float(-(means[1] @ inverse @ means[1] - means[0] @ inverse @ means[0]) / 2)


def apply_linear(df: DataFrame, cols: list[str], w: np.ndarray, constant: float, name: str = "score") -> DataFrame:
    return df.withColumn(name, sum((F.col(c) * float(x) for c, x in zip(cols, w, strict=True)), F.lit(constant)))


def balanced(df: DataFrame) -> DataFrame:
    """Weights that make both classes weigh the same."""
    n = df.groupBy("label").agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n), "label").withColumn("weight", 1.0 / F.col("_n")).drop("_n")  # a row per label


def fit_logit(df: DataFrame, cols: list[str], cycles: int = 100):
    """M3."""
    return LogisticRegression(maxIter=cycles, weightCol="weight", labelCol="label").fit(assembled(balanced(df), cols))


def predict_logit(model, df: DataFrame, cols: list[str]) -> DataFrame:
    return model.transform(assembled(df, cols)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_svm(df: DataFrame, cols: list[str]):
    """M4: linear kernel."""
    return LinearSVC(maxIter=50, weightCol="weight", labelCol="label").fit(assembled(balanced(df), cols))


def predict_svm(model, df: DataFrame, cols: list[str]) -> DataFrame:
    return model.transform(assembled(df, cols)).withColumn("score", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "prediction")


def score_to_p(df: DataFrame, width: float = 0.1) -> DataFrame:
    """M5: (bin, p): share of false rows at or above each bin, empty bins taking the value of the next one above. The sums
    run up over ranges of bins."""
    hist = df.groupBy(F.floor(F.col("score") / width).alias("bin")).agg(F.count_if(F.col("label") == 0).alias("f"), F.count("*").alias("n"))
    up = running_above(bin_spine(hist, [], "bin").join(hist, "bin", "left").na.fill(0), "bin", ["f", "n"])
    return up.select("bin", ((F.col("f_above") + F.col("f")) / F.greatest(F.col("n_above") + F.col("n"), F.lit(1))).alias("p"))


def interpolated_p(df: DataFrame, prior: float, width: float = 0.1, least: float = 1e-4) -> DataFrame:
    """M5: (bin, p) for every bin between the ends: P(false | score at or above), by Bayes' theorem from the prior, at
    least `least`; bins without rows lie on the line between their neighbours.

    Sums and neighbours are of bins dealt by ranges.
    """
    hist = df.groupBy(F.round(F.col("score") / width).cast("long").alias("bin")).agg(F.count_if(F.col("label") == 0).alias("f"), F.count("*").alias("n"))
    above = running_above(hist, "bin", ["f", "n"])
    total = hist.agg(F.sum("f").alias("all_f"), F.sum("n").alias("all_n"))
    ratio = (F.col("f_above") + F.col("f")) * F.col("all_n") / (F.greatest("all_f", F.lit(1)) * (F.col("n_above") + F.col("n")))
    known = above.join(F.broadcast(total)).select("bin", F.greatest(ratio * prior, F.lit(least)).alias("p"))  # one row
    # the next bin with rows: bins are dealt by ranges; stretches of empty bins are cut in two steps, not one array
    nxt = following(placed(known, [], ["bin"]), [], "bin", "to")
    after = known.select(F.col("bin").alias("to"), F.col("p").alias("to_p"))
    nxt = nxt.select("bin", "p", "to").join(after, "to", "left")
    last = F.coalesce(F.col("to") - 1, F.col("bin"))
    rows = nxt.select("bin", "p", "to", "to_p", last.alias("last"), F.explode(F.sequence(F.col("bin"), last, F.lit(100_000).cast("long"))).alias("s"))
    rows = rows.select("bin", "p", "to", "to_p", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + 99_999, F.col("last")))).alias("b"))
    return rows.select(F.col("b").alias("bin"), F.when(F.col("b") == F.col("bin"), F.col("p")).otherwise(F.col("p") + (F.col("to_p") - F.col("p")) * (F.col("b") - F.col("bin")) / (F.col("to") - F.col("bin"))).alias("p"))


def mixture_p(df: DataFrame, width: float = 0.1, score: str = "score", cycles: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """M5, the other way: df with p_value, one less the odds of being true by a mixture fitted to the scores (see
    `psm.fit_mixture`), which does not look at labels."""
    bins = df.where(F.col(score).isNotNull()).groupBy(F.lit(0).alias("charge_class"), F.round(F.col(score) / width).cast("long").alias("bin")).agg(F.count("*").alias("hits"))
    models = fit_mixture(bins, cycles, tolerance, width)
    if not models:
        return df.withColumn("p_value", F.lit(None).cast("double"))
    model = models_table(df.sparkSession, models).select(F.col("model").alias("_model"))
    return df.join(F.broadcast(model)).withColumn("p_value", 1 - odds_true(F.col(score), F.col("_model"))).drop("_model")  # one row


def extremes(df: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """M6: df's lowest and highest scored rows as label 0 and 1: a quarter of the rows each, `most` at most; ties by keys."""
    chunk = min(df.count() // 4, most)
    low = df.orderBy("score", *keys).limit(chunk).withColumn("label", F.lit(0))
    return low.unionByName(df.orderBy(F.desc("score"), *[F.desc(k) for k in keys]).limit(chunk).withColumn("label", F.lit(1)))


def fit_paired(df: DataFrame, cols: list[str], facultative: list[str], constitutive: list[str], keys: list[str], rounds: int = 1):
    """M6: models of constitutive ("always") and facultative ("sometimes") modifications: (models, df with score).

    df: label and is_facultative. A model of all rows scores all; the ends of the facultative ones by that score (see
    `extremes`) are the labels of a model of their own, whose scores may choose the ends again for `rounds` rounds, until
    the same rows come out; the constitutive rows have theirs from their labels. The rows chosen are stored each round.
    """
    everything = stored(predict_logit(fit_logit(df, cols), df, cols))
    fac = everything.where("is_facultative")
    con = df.where(~F.col("is_facultative"))
    seen = None
    for _ in range(rounds):
        chosen = stored(extremes(fac, keys).select(*keys, *facultative, "label"))
        mark = chosen.agg(F.expr(f"bit_xor(xxhash64({', '.join(keys)}, label))")).first()[0]
        if mark == seen:
            break
        seen, model = mark, fit_logit(chosen, facultative)
        fac = stored(predict_logit(model, df.where("is_facultative"), facultative))
    models = {"facultative": model, "constitutive": fit_logit(con, constitutive)}
    return models, fac.unionByName(predict_logit(models["constitutive"], con, constitutive), allowMissingColumns=True)


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """Per distinct score the positives and negatives, and those above it."""
    g = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running_above(g, "score", ["pos", "neg"])


def roc_auc(df: DataFrame, score: str = "score") -> DataFrame:
    """One row, auc; ties count half."""
    r = ranked(df, score)
    return r.agg((F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def sensitivity_at_fdr(df: DataFrame, score: str = "score", levels: tuple = (0.01, 0.03, 0.05, 0.07, 0.10)) -> DataFrame:
    """(fdr, sensitivity): largest share of positives whose cut has at most that share of negatives."""
    total = df.where(F.col("label") == 1).count()
    r = ranked(df, score).select((F.col("pos_above") + F.col("pos")).alias("tp"), (F.col("neg_above") + F.col("neg")).alias("fp"), F.lit(total).alias("all"))
    r = r.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return r.groupBy(F.col("level").alias("fdr")).agg(F.coalesce(F.max(F.when(F.col("fp") / (F.col("tp") + F.col("fp")) <= F.col("level"), F.col("tp") / F.col("all"))), F.lit(0.0)).alias("sensitivity"))


def mutual_information(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, h_a, h_b, mi, su) for every pair of discrete features, natural logarithm."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("p")
    joint = df.select(values).select("p.*").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("a", "b"))
    px, py = F.sum("n").over(Window.partitionBy("a", "b", "x")), F.sum("n").over(Window.partitionBy("a", "b", "y"))
    rows = joint.select("a", "b", (F.col("n") / total).alias("p"), (px / total).alias("px"), (py / total).alias("py"))
    out = rows.groupBy("a", "b").agg((-F.sum(F.col("p") * F.log("px"))).alias("h_a"), (-F.sum(F.col("p") * F.log("py"))).alias("h_b"), F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    return out.withColumn("su", 2 * F.col("mi") / (F.col("h_a") + F.col("h_b")))


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """M7: (feature, label, n, mean, sd, low, high)."""
    long = df.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("f")).select("label", "f.*")
    return long.groupBy("feature", "label").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))


def select_features(df: DataFrame, cols: list[str], most: int = 3) -> list[str]:
    """M7: greedy forward selection of discriminants by ROC area."""
    chosen: list[str] = []
    best = 0.0
    while len(chosen) < most:
        found = []
        for c in (c for c in cols if c not in chosen):
            w, k = fit_lda(df, [*chosen, c])
            found.append((roc_auc(apply_linear(df, [*chosen, c], w, k)).first()[0], c))
        top, name = max(found)
        if top <= best:
            break
        best = top
        chosen.append(name)
    return chosen


def fit_peptide_model(df: DataFrame, cols: list[str]):
    """M8: scaled features and a logistic model; returns the scored frame."""
    scaled = scale_features(df, cols)
    return predict_logit(fit_logit(scaled, cols), scaled, cols)
