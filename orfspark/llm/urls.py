"""Operator 2, URL filters: logistic regression on hashed character n-grams of host and path.

Curated rules decide the urls they fit. What they say about those urls is the
small labelled table (a bounded, hash-ordered sample of distinct host and path
pairs); a logistic regression on hashed n-grams of host and path generalises it
to all other urls. Training, features and scoring are `pyspark.ml`.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, others, quoted, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDERS = (2, 3, 4)
#: Hashed features, and labelled urls used to fit (a documented bound).
FEATURES, SAMPLE = 1 << 14, 4000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(longest):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host (marked h) and of the path (marked p), each with its ends marked."""

    def of(mark: str, text: Column, n: int) -> Column:
        # a look-ahead finds all n-grams in one pass, however long the url is
        cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(F.when(F.length(text) < n, F.array(text)).otherwise(cut), lambda g: F.concat(F.lit(mark), g))

    marked = [(mark, F.concat(F.lit("^"), text, F.lit("$"))) for mark, text in (("h", host), ("p", path))]
    return F.concat(*[of(mark, text, n) for mark, text in marked for n in ORDERS])


def features(urls: DataFrame, name: str = "features") -> DataFrame:
    cut = urls.withColumn(name + "_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol=name + "_grams", outputCol=name, numFeatures=FEATURES, binary=True).transform(cut).drop(name + "_grams")


def least_distinct(rows: DataFrame, n: int) -> DataFrame:
    """The n distinct rows of (host, path, label) of the least hashes.

    Rows above a hash that some 4n distinct ones lie below are left out before
    anything is shuffled; should too few be below it, all rows are sorted.
    """
    keyed = rows.withColumn("_h", F.xxhash64("host", "path"))
    seen = keyed.agg(F.approx_count_distinct("_h")).first()[0]
    order = ["_h", "host", "path", "label"]
    if seen > 8 * n:
        few = keyed.where(F.col("_h") <= -(1 << 63) + (1 << 64) * 4 * n // seen).distinct().orderBy(*order).limit(n)
        if few.count() == n:
            return few.drop("_h")
    return keyed.distinct().orderBy(*order).limit(n).drop("_h")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """Model of P(block) from (host, path, label 0 or 1); None if a class is missing.

    At most `sample` distinct urls are used, in order of their hash.
    """
    rows = least_distinct(labelled.where("label is not null").select("host", "path", "label"), sample)
    rows = features(rows).select("features", F.col("label").cast("double")).repartition(8).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(regParam=0.01, maxIter=40).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """All columns of pages (url), and host, path, rule, verdict, p_block.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end; a url that is
    null or has no ``://`` has neither. Of the rules that fit, the longest
    decides; else the model's p_block (block at 0.5 or more). If the rules label
    one class only, or nothing, other urls are allowed (p_block 0). Columns of
    pages with the result's names, in capitals or not, are replaced; all other
    names are free.
    """
    rules = RULES if rules is None else rules
    columns, free = quoted(others(pages, "host", "path", "rule", "verdict", "p_block")), free_prefix(pages)
    ruled, inputs, p = free + "rule", free + "features", free + "p"
    parts = pages.select(*columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn(ruled, best_rule(F.col("host"), F.col("path"), rules))
    model = fit(parts.where(F.col(ruled).isNotNull()).select("host", "path", (F.col(ruled)["verdict"] == "block").cast("int").alias("label")), sample)
    if model is None:
        scored = parts.withColumn("p_block", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        model.setFeaturesCol(inputs).setProbabilityCol(p).setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(features(parts, inputs)).withColumn("p_block", vector_to_array(p)[1])
    learnt = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select(*columns, "host", "path", F.col(ruled)["rule"].alias("rule"), F.coalesce(F.col(ruled)["verdict"], learnt).alias("verdict"), "p_block")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")
