"""Registered queries of the library and their SQL.

A query is an operator applied to a view of the driver's tables; `add` keeps the
two sides of it together. Sums and ratios are rounded to six places on both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import genome, inference, ml, psm as P, ptm, ranges, spectra, splice
from . import adapters as V

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Callable, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


# --- p-values ----------------------------------------------------------------------------------------------------

CLASS = "CASE WHEN charge < 3 THEN 2 ELSE 3 END"
TOP = "top AS (SELECT * FROM psm WHERE rank = 1)"
DELTA = f"md AS (SELECT {CLASS} AS charge_class, CASE WHEN avg(delta) = 0 THEN 0.001 ELSE avg(delta) END AS mean_delta FROM top WHERE length >= 7 AND delta >= 0 GROUP BY 1)"
SCORED = f"scored AS (SELECT p.*, m.charge_class, CAST(round((0.3 * mq_score + 1.5 * delta / mean_delta) * 10) AS BIGINT) AS bin FROM psm p JOIN md m ON {CLASS} = m.charge_class)"
HIST = "hist AS (SELECT charge_class, bin, count(*) FILTER (NOT is_decoy) AS hits, count(*) FILTER (is_decoy) AS decoy_hits FROM scored WHERE rank = 1 AND length >= 7 GROUP BY ALL)"
SPINE = "spine AS (SELECT charge_class, unnest(range(min(bin), max(bin) + 1)) AS bin FROM hist GROUP BY charge_class)"
ODDS = """odds AS (SELECT charge_class, bin, greatest(0, v - least(v, i)) / greatest(v, 1) AS odds FROM (
 SELECT s.charge_class, s.bin, CAST(sum(coalesce(hits, 0)) OVER w AS DOUBLE) AS v, CAST(sum(coalesce(decoy_hits, 0)) OVER w AS DOUBLE) AS i
 FROM spine s LEFT JOIN hist h ON h.charge_class = s.charge_class AND h.bin = s.bin WINDOW w AS (PARTITION BY s.charge_class ORDER BY s.bin DESC)))"""
BASE = f"WITH {V.PSM}, {TOP}, {DELTA}, {SCORED}, {HIST}, {SPINE}, {ODDS}"


def hist(spark, d):
    """The histogram of the spectra's first rows (`first_hits`)."""
    top = V.first_hits(spark, d)
    return P.score_histogram(P.with_f_score(top, ranges.stored(P.mean_delta(top, first=True))), first=True)


add("a2_mean_delta", lambda s, d: r6(P.mean_delta(V.first_hits(s, d), first=True), "mean_delta"), f"WITH {V.PSM}, {TOP}, {DELTA} SELECT charge_class, round(mean_delta, 6) AS mean_delta FROM md")
add("a3_score_histogram", lambda s, d: hist(s, d), f"{BASE} SELECT * FROM hist")
add("a1_fdr_table", lambda s, d: r6(P.fdr_table(hist(s, d)), "odds", "p_value"), f"{BASE} SELECT charge_class, bin, round(odds, 6) AS odds, round(1 - odds, 6) AS p_value FROM odds")
add("a1_q_values", lambda s, d: r6(P.fdr_table(hist(s, d), monotone=True), "odds", "p_value"),
    f"{BASE} SELECT charge_class, bin, round(q, 6) AS odds, round(1 - q, 6) AS p_value FROM (SELECT charge_class, bin, max(odds) OVER (PARTITION BY charge_class ORDER BY bin) AS q FROM odds)")


def a4(spark, d):
    rows = V.ranked(V.table(spark, d, "lineitem"))
    top = rows.where("rank = 1")
    deltas = ranges.stored(P.mean_delta(top, first=True))
    table = P.fdr_table(ranges.stored(P.score_histogram(P.with_f_score(top, deltas), first=True)))
    return r6(P.assign_pvalue(P.with_f_score(rows, deltas), table), "p_value").select("spectrum_file", "scan", "rank", "charge_class", "bin", "p_value")


add("a4_assign_pvalue", a4, f"""{BASE} SELECT spectrum_file, scan, rank, s.charge_class, s.bin, round(1 - greatest(1e-5, least(0.99999, coalesce(odds, CASE WHEN s.bin < 0 THEN 1e-5 ELSE 0.99999 END))), 6) AS p_value
 FROM scored s LEFT JOIN odds o ON o.charge_class = s.charge_class AND o.bin = s.bin""")
add("a5_local_fdr", lambda s, d: r6(P.assign_lfdr(V.psm(s, d)), "local_fdr", "fdr").select("spectrum_file", "scan", "rank", "charge_class", "bin", "local_fdr", "fdr"),
    f"""WITH {V.PSM}, b AS (SELECT *, {CLASS} AS charge_class, CAST(floor(p_value / 0.01) AS BIGINT) AS bin FROM psm),
 h AS (SELECT charge_class, bin, count(*) FILTER (NOT is_decoy) AS tp, count(*) FILTER (is_decoy) AS fp FROM b GROUP BY ALL),
 r AS (SELECT charge_class, bin, fp / (tp + fp) AS local_fdr, sum(fp) OVER w / (sum(tp) OVER w + sum(fp) OVER w) AS fdr FROM h WINDOW w AS (PARTITION BY charge_class ORDER BY bin DESC))
 SELECT spectrum_file, scan, rank, b.charge_class, b.bin, round(local_fdr, 6) AS local_fdr, round(fdr, 6) AS fdr FROM b JOIN r ON r.charge_class = b.charge_class AND r.bin = b.bin WHERE NOT is_decoy""")


def a6(spark, d):
    fitted = P.fit_mixture(hist(spark, d), 60)
    names = ["mean_true", "var_true", "mean_false", "var_false", "prior", "offset"]
    return spark.createDataFrame([(c, *(round(m[n], 4) for n in names)) for c, m in sorted(fitted.items())], "charge_class int, " + ", ".join(f"{n} double" for n in names))


def a6_step(spark, d):
    """The sums of the first cycle."""
    h = hist(spark, d)
    bins = ranges.stored(ranges.bin_spine(h, ["charge_class"], "bin").join(h, ["charge_class", "bin"], "left").na.fill(0))
    ends = bins.groupBy("charge_class").agg(F.min("bin").alias("a"), F.max("bin").alias("z")).collect()
    return r6(P.mixture_step(bins, {r.charge_class: P.mixture_start(r.a, r.z) for r in ends}), "n", "sx", "sxx", "t", "tx", "txx")


STEP = """e AS (SELECT charge_class, min(bin) / 10.0::DOUBLE AS low, (max(bin) + 1) / 10.0::DOUBLE AS high FROM spine GROUP BY 1),
 m AS (SELECT charge_class, high - (high - low) / 4 AS mt, (high - low) / 10 AS v, low + (high - low) / 4 AS mf, CASE WHEN low BETWEEN 0 AND 0.1 THEN 0 ELSE -low END AS o FROM e),
 k AS (SELECT *, (mf + o) * (mf + o) / v AS k, v / (mf + o) AS th FROM m),
 x AS (SELECT s.charge_class, s.bin, s.bin * 0.1::DOUBLE AS x, coalesce(hits, 0) AS n, k.* EXCLUDE (charge_class) FROM spine s JOIN k USING (charge_class) LEFT JOIN hist h ON h.charge_class = s.charge_class AND h.bin = s.bin),
 y AS (SELECT *, CASE WHEN x > mt + v THEN greatest(nt, 0.001) ELSE nt END * 0.1 AS a, CASE WHEN x < mt - v THEN greatest(gt, 0.001) ELSE gt END * 0.9 AS b FROM (SELECT *, exp(-(x - mt) * (x - mt) / (2 * v)) / sqrt(2 * pi() * v) AS nt, exp((k - 1) * ln(greatest(x + o, 0.01)) - greatest(x + o, 0.01) / th - k * ln(th) - lgamma(k)) AS gt FROM x)),
 z AS (SELECT *, CASE WHEN bin < 0 THEN least(a / (a + b), -1.0 / bin) ELSE a / (a + b) END AS w0 FROM y),
 w AS (SELECT *, CASE WHEN x >= mt THEN max(w0) OVER (PARTITION BY charge_class ORDER BY bin) ELSE w0 END AS w FROM z)"""
add("a6_mixture", a6)
add("a6_mixture_step", a6_step, f"{BASE}, {STEP} SELECT charge_class, round(CAST(sum(n) AS DOUBLE), 6) AS n, round(sum(n * x), 6) AS sx, round(sum(n * x * x), 6) AS sxx, round(sum(n * w), 6) AS t, round(sum(n * w * x), 6) AS tx, round(sum(n * w * x * x), 6) AS txx FROM w GROUP BY 1")
add("a7_rollup_peptides", lambda s, d: P.rollup_peptides(V.psm(s, d)).select("aminos", "is_decoy", F.round("best_p", 6).alias("best_p"), "spectra", F.size("sources").cast("long").alias("n_sources")),
    f"WITH {V.PSM} SELECT aminos, is_decoy, round(min(coalesce(lfdr, p_value)), 6) AS best_p, count(*) AS spectra, count(DISTINCT (spectrum_file, scan)) AS n_sources FROM psm GROUP BY ALL")
add("w13_running_fdr", lambda s, d: P.running_fdr(hist(s, d)), f"{BASE} SELECT charge_class, bin, hits, decoy_hits, CAST(sum(hits) OVER w AS BIGINT) AS cum_hits, CAST(sum(decoy_hits) OVER w AS BIGINT) AS cum_decoys FROM hist WINDOW w AS (PARTITION BY charge_class ORDER BY bin DESC)")

# --- filters and top hits ----------------------------------------------------------------------------------------

KEY = "spectrum_file, scan, rank"
key = ("spectrum_file", "scan", "rank")
add("f1_confident", lambda s, d: P.confident(V.psm(s, d), 0.03).select(*key), f"WITH {V.PSM} SELECT {KEY} FROM psm WHERE coalesce(lfdr, p_value) <= 0.03")
add("f2_quality_filter", lambda s, d: P.quality_filter(V.psm(s, d), 0.05).select(*key), f"WITH {V.PSM} SELECT {KEY} FROM (SELECT *, bool_or(is_decoy) OVER (PARTITION BY spectrum_file, scan ORDER BY rank) AS d FROM psm) WHERE NOT d AND delta >= -3.5 AND length >= 7 AND mq_score >= -10 AND p_value <= 0.05")
add("f3_best_per_scan", lambda s, d: P.best_per_scan(V.psm(s, d), 0.03).select(*key), f"WITH {V.PSM} SELECT {KEY} FROM psm WHERE lfdr <= 0.03 QUALIFY row_number() OVER (PARTITION BY spectrum_file, scan ORDER BY lfdr, rank) = 1")
add("f4_weak_runners_up", lambda s, d: P.drop_weak_runners_up(V.psm(s, d), 0.02).select(*key), f"WITH {V.PSM} SELECT {KEY} FROM psm WHERE rank = 1 OR p_value <= 0.02")
add("f8_guideline_subset", lambda s, d: P.guideline_subset(V.psm(s, d)).select(*key), f"WITH {V.PSM} SELECT {KEY} FROM psm JOIN (SELECT protein, count(DISTINCT aminos) AS n FROM psm GROUP BY 1) USING (protein) WHERE n = 1 OR is_modified")
add("f9_min_peptides_per_file", lambda s, d: P.min_peptides_per_file(V.psm(s, d).withColumn("protein", F.col("aminos") % 50)).select(*key),
    f"WITH {V.PSM} SELECT {KEY} FROM (SELECT *, aminos % 50 AS prot FROM psm) p JOIN (SELECT spectrum_file, aminos % 50 AS prot FROM psm GROUP BY 1, 2 HAVING count(DISTINCT aminos) >= 2) g USING (spectrum_file, prot)")
add("w1_top_hit", lambda s, d: P.top_hit(V.psm(s, d)).select("spectrum_file", "scan", "aminos", "charge"), f"WITH {V.PSM} SELECT spectrum_file, scan, aminos, charge FROM psm WHERE rank = 1")
add("w2_delta_scores", lambda s, d: r6(P.delta_scores(V.psm(s, d)), "delta_any").select(*key, "delta_any"),
    f"""WITH {V.PSM}, o AS (SELECT *, row_number() OVER w AS no, first(mq_score) OVER w AS f, lead(mq_score) OVER w AS n, count(*) OVER (PARTITION BY spectrum_file, scan) AS c FROM psm WINDOW w AS (PARTITION BY spectrum_file, scan ORDER BY mq_score DESC, rank))
 SELECT {KEY}, round(CASE WHEN c = 1 THEN greatest(0.0, mq_score) WHEN no = 1 THEN mq_score - n ELSE mq_score - f END, 6) AS delta_any FROM o""")
add("o3_best_n", lambda s, d: inference.best_n(V.psm(s, d), ["aminos"], [F.desc("mq_score"), *key]).select("aminos", *key, "n"),
    f"WITH {V.PSM} SELECT aminos, {KEY}, row_number() OVER (PARTITION BY aminos ORDER BY mq_score DESC, {KEY}) AS n FROM psm QUALIFY n <= 3")
add("a34_searched_scans", lambda s, d: P.searched_scans(V.psm(s, d)), f"WITH {V.PSM} SELECT spectrum_file, count(DISTINCT scan) AS scans, max(scan) AS max_scan, count(*) > count(DISTINCT scan) AS has_repeats FROM psm GROUP BY 1")
add("w12_discovery_curve", lambda s, d: P.discovery_curve(V.psm(s, d), ["spectrum_file"]), f"WITH {V.PSM}, f AS (SELECT aminos, min(spectrum_file) AS spectrum_file FROM psm GROUP BY 1) SELECT spectrum_file, count(*) AS new_peptides, CAST(sum(count(*)) OVER (ORDER BY spectrum_file) AS BIGINT) AS seen FROM f GROUP BY 1")
add("j11_diff_results", lambda s, d: P.diff_results(*[V.psm(s, d).where(F.col("sample") == x).withColumn("aminos", F.col("aminos").cast("string")).withColumn("rank", F.row_number().over(Window.partitionBy("spectrum_file", "scan").orderBy("rank"))) for x in "OF"], ["charge", "mq_score"]).withColumn("differing", F.col("differing").cast("int")),
    f"""WITH {V.PSM}, s AS (SELECT spectrum_file, scan, sample, array_to_string(list_sort(list(DISTINCT CAST(aminos AS VARCHAR))), ',') AS p, arg_min(charge, rank) AS c, arg_min(mq_score, rank) AS m FROM psm GROUP BY ALL),
 a AS (SELECT * FROM s WHERE sample = 'O'), b AS (SELECT * FROM s WHERE sample = 'F')
 SELECT spectrum_file, scan, a.p IS NOT NULL AS in_a, b.p IS NOT NULL AS in_b, coalesce(a.p = b.p, false) AS same_peptides, coalesce(CAST(a.c <> b.c AS INT), 0) + coalesce(CAST(a.m <> b.m AS INT), 0) AS differing FROM a FULL JOIN b USING (spectrum_file, scan)""")
add("j12_competing_search", lambda s, d: P.competing_search(*[V.psm(s, d).where(F.col("sample") == x) for x in "OF"], p=0.05).select(*key),
    f"""WITH {V.PSM}, x AS (SELECT *, first(p_value) OVER w AS fp, first(mq_score) OVER w AS fs FROM psm WHERE sample = 'O' WINDOW w AS (PARTITION BY spectrum_file, scan ORDER BY rank)),
 y AS (SELECT spectrum_file, scan, arg_min(p_value, rank) AS yp, arg_min(mq_score, rank) AS ys FROM psm WHERE sample = 'F' GROUP BY 1, 2)
 SELECT {KEY} FROM x LEFT JOIN y USING (spectrum_file, scan) WHERE NOT coalesce(yp < 0.75 * fp AND ys > fs + 0.5, false) AND p_value < 0.05""")
ENGINES = "e AS (SELECT event_type AS engine, user_id AS spectrum_file, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS scan, event_id % 3 AS aminos FROM events)"


def engines(s, d):
    return V.table(s, d, "events").select(F.col("event_type").alias("engine"), F.col("user_id").alias("spectrum_file"), F.floor(F.unix_timestamp("ts") / 86400).alias("scan"), (F.col("event_id") % 3).alias("aminos"))


add("j14_engine_consensus", lambda s, d: P.engine_consensus(engines(s, d)), f"""WITH {ENGINES}, v AS (SELECT spectrum_file, scan, aminos, count(DISTINCT engine) AS n FROM e GROUP BY ALL), t AS (SELECT spectrum_file, scan, max(n) AS m, count(*) AS p FROM v GROUP BY 1, 2),
 g AS (SELECT spectrum_file, scan, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines FROM e GROUP BY 1, 2) SELECT spectrum_file, scan, engines, p > 1 AS conflict, m >= 2 AS agreed FROM g JOIN t USING (spectrum_file, scan)""")

# --- proteins ----------------------------------------------------------------------------------------------------

PP = f"pp AS (SELECT aminos, protein, count(*) AS spectra FROM psm GROUP BY ALL)"


def pep_protein(s, d):
    return V.psm(s, d).groupBy("aminos", "protein").agg(F.count("*").alias("spectra"))


COVER = """rec AS (SELECT CAST(0 AS BIGINT) AS round, aminos, protein, spectra, false AS taken FROM pp UNION ALL
 SELECT CASE WHEN w THEN round ELSE round + 1 END, aminos, protein, spectra, w FROM (SELECT *, bool_or(w) OVER (PARTITION BY aminos) AS gone FROM (SELECT *, bool_and(k = b) OVER (PARTITION BY protein) AS w FROM (SELECT *, min(k) OVER (PARTITION BY aminos) AS b FROM
 (SELECT round, aminos, protein, spectra, (-count(*) OVER (PARTITION BY protein), -sum(spectra) OVER (PARTITION BY protein), protein) AS k FROM rec WHERE NOT taken)))) WHERE w OR NOT gone)"""
add("a8_select_proteins", lambda s, d: inference.select_proteins(pep_protein(s, d)).groupBy("protein", "round").agg(F.count("*").alias("peptides")),
    f"WITH RECURSIVE {V.PSM}, {PP}, {COVER} SELECT protein, round, count(*) AS peptides FROM rec WHERE taken GROUP BY 1, 2")
add("a9_indistinguishable", lambda s, d: inference.indistinguishable(V.psm(s, d).select((F.col("aminos") % 7).alias("aminos"), F.col("scan").alias("protein"))),
    f"WITH {V.PSM}, q AS (SELECT scan AS protein, list_sort(list(DISTINCT aminos % 7)) AS s FROM psm GROUP BY 1), g AS (SELECT *, min(protein) OVER (PARTITION BY s) AS set_of, count(*) OVER (PARTITION BY s) AS n_proteins FROM q WHERE len(s) >= 2) SELECT protein, set_of, n_proteins, CAST(len(s) AS BIGINT) AS n_peptides FROM g WHERE n_proteins > 1")
add("a10_protein_report", lambda s, d: inference.protein_report(pep_protein(s, d)), f"WITH {V.PSM}, {PP}, n AS (SELECT aminos, count(DISTINCT protein) AS n FROM pp GROUP BY 1) SELECT protein, count(*) FILTER (n = 1) AS unique_peptides, count(*) FILTER (n > 1) AS shared_peptides, CAST(sum(spectra) AS BIGINT) AS spectra FROM pp JOIN n USING (aminos) GROUP BY 1")
add("a12_unique_shared_hist", lambda s, d: inference.unique_shared_hist(inference.protein_report(pep_protein(s, d))),
    f"""WITH {V.PSM}, {PP}, n AS (SELECT aminos, count(DISTINCT protein) AS n FROM pp GROUP BY 1), r AS (SELECT protein, count(*) FILTER (n = 1) AS u, count(*) FILTER (n > 1) AS h FROM pp JOIN n USING (aminos) GROUP BY 1)
 SELECT CASE WHEN u = 0 THEN '0' WHEN u = 1 THEN '1' WHEN u < 5 THEN '2-4' ELSE '5+' END AS unique_class, count(*) FILTER (h = 0) AS "0", count(*) FILTER (h = 1) AS "1", count(*) FILTER (h BETWEEN 2 AND 4) AS "2-4", count(*) FILTER (h >= 5) AS "5+" FROM r GROUP BY 1""")
add("a13_nsaf", lambda s, d: r6(inference.nsaf(V.psm(s, d), V.table(s, d, "supplier").select(F.col("s_suppkey").alias("protein"), (100 + F.col("s_suppkey") % 50).alias("length"))), "nsaf"),
    f"WITH {V.PSM}, n AS (SELECT protein, count(*) AS spectra, count(*) / (100 + protein % 50) AS r FROM psm JOIN supplier ON s_suppkey = protein GROUP BY protein) SELECT protein, spectra, round(r / sum(r) OVER (), 6) AS nsaf FROM n")
add("a14_expression_class", lambda s, d: inference.expression_class(V.quant(s, d)),
    f"""WITH {V.QUANT}, m AS (SELECT sample, avg(value) AS m, stddev_pop(value) AS s FROM quant GROUP BY 1), c AS (SELECT gene, CASE WHEN value > m + s / 3 THEN 1 WHEN value < m - s / 3 THEN -1 ELSE 0 END AS c FROM quant JOIN m USING (sample))
 SELECT gene, min(c) AS low, max(c) AS high, count(*) AS samples FROM c GROUP BY 1 HAVING max(c) - min(c) >= 2""")
add("a15_quant_summary", lambda s, d: r6(inference.quant_summary(V.psm(s, d).select("protein", "aminos", F.col("mq_score").alias("ratio")), ["protein"]), "low", "high", "mean", "median"),
    f"WITH {V.PSM} SELECT protein, count(*) AS n, round(min(mq_score), 6) AS low, round(max(mq_score), 6) AS high, round(avg(mq_score), 6) AS mean, round(median(mq_score), 6) AS median FROM psm GROUP BY 1")
add("a23_compare_groups", lambda s, d: inference.compare_groups(V.psm(s, d).withColumn("group", F.col("sample")), ["F", "O"]),
    f"""WITH {V.PSM}, n AS (SELECT protein, sample, count(DISTINCT aminos) AS p, count(*) AS s FROM psm GROUP BY 1, 2) SELECT protein, coalesce(max(p) FILTER (sample = 'F'), 0) AS F_peptides, coalesce(max(s) FILTER (sample = 'F'), 0) AS F_spectra, coalesce(max(p) FILTER (sample = 'O'), 0) AS O_peptides, coalesce(max(s) FILTER (sample = 'O'), 0) AS O_spectra FROM n GROUP BY 1 HAVING max(p) >= 2""")
add("a24_list_peptides", lambda s, d: inference.list_peptides(V.psm(s, d).withColumn("spectrum_file", F.col("spectrum_file").cast("string")), ["1", "7"]),
    f"WITH {V.PSM} SELECT g AS \"group\", aminos, count(*) AS spectra FROM psm JOIN (VALUES ('1'), ('7')) t(g) ON contains(CAST(spectrum_file AS VARCHAR), g) GROUP BY 1, 2")
add("a28_modified_overlap", lambda s, d: inference.modified_overlap(V.psm(s, d)), f"WITH {V.PSM}, b AS (SELECT aminos, bool_or(is_modified) AS m, bool_and(is_modified) AS u FROM psm GROUP BY 1) SELECT count(*) FILTER (m) AS modified, count(*) FILTER (NOT u) AS unmodified, count(*) FILTER (m AND NOT u) AS both FROM b")
add("a29_nonredundant", lambda s, d: r6(inference.nonredundant(V.psm(s, d)), "mq_score"),
    f"WITH {V.PSM}, n AS (SELECT aminos, count(DISTINCT protein) > 1 AS several FROM psm GROUP BY 1), b AS (SELECT * FROM psm QUALIFY row_number() OVER (PARTITION BY aminos ORDER BY mq_score DESC, {KEY}) = 1) SELECT aminos, spectrum_file, scan, round(mq_score, 6) AS mq_score, several FROM b JOIN n USING (aminos)")
SPOTS = "g AS (SELECT aminos % 40 AS spot, protein, count(*) AS spectra FROM psm GROUP BY 1, 2)"
GEL = "gs AS (SELECT aminos % 400 AS spot, aminos % 20 AS gel, protein, count(*) AS spectra FROM psm WHERE protein NOT IN (1, 2) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


def gel_psm(s, d):
    return V.psm(s, d).withColumn("spot", F.col("aminos") % 400).withColumn("gel", F.col("aminos") % 20)


add("a35_gel_spots", lambda s, d: inference.gel_spots(V.psm(s, d).withColumn("spot", F.col("aminos") % 40), [1, 2]),
    f"""WITH {V.PSM}, {SPOTS}, t AS (SELECT spot, CAST(sum(spectra) AS BIGINT) AS total, CAST(coalesce(sum(spectra) FILTER (protein IN (1, 2)), 0) AS BIGINT) AS contaminating FROM g GROUP BY 1),
 n AS (SELECT spot, spectra, max(protein) AS protein FROM g WHERE protein NOT IN (1, 2) AND spectra >= 2 GROUP BY 1, 2)
 SELECT spot, row_number() OVER (PARTITION BY spot ORDER BY spectra DESC) AS place, protein, spectra, total, contaminating FROM n JOIN t USING (spot) QUALIFY place <= 3""")
PAIRED_GEL = "m AS (SELECT spot, gel, first(protein ORDER BY spectra DESC, protein) AS major FROM gs GROUP BY 1, 2), gp AS (SELECT major, protein AS minor, count(DISTINCT gel) AS gels, count(*) AS spots FROM gs JOIN m USING (spot, gel) WHERE protein <> major GROUP BY 1, 2)"
add("a36_gel_pairs", lambda s, d: inference.gel_pairs(inference.passing_proteins(gel_psm(s, d), [1, 2]), 1), f"WITH {V.PSM}, {GEL}, {PAIRED_GEL} SELECT major, minor, gels, spots FROM gp")
add("w10_sticky_proteins", lambda s, d: inference.sticky_proteins(V.psm(s, d).groupBy((F.col("aminos") % 40 * 3).alias("spot"), "protein").agg(F.count("*").alias("spectra")), [1, 2]),
    f"WITH {V.PSM}, {SPOTS}, o AS (SELECT spot, lag(spot) OVER (ORDER BY spot) AS before FROM (SELECT DISTINCT spot FROM g)), k AS (SELECT * FROM g WHERE spectra >= 2 AND protein NOT IN (1, 2)) SELECT a.spot * 3 AS spot, a.protein FROM k a JOIN o USING (spot) JOIN k b ON a.protein = b.protein AND b.spot = before")
RANKED = "q AS (SELECT spectrum_file, scan, aminos, min(rank) AS r FROM psm WHERE mq_score >= 0 GROUP BY 1, 2, 3), rk AS (SELECT q.spectrum_file, q.scan, q.aminos, q.r, protein, p_value, row_number() OVER (PARTITION BY q.spectrum_file, q.scan ORDER BY r, q.aminos) AS place FROM q JOIN psm ON psm.spectrum_file = q.spectrum_file AND psm.scan = q.scan AND psm.rank = r)"
add("a38_candidate_summary", lambda s, d: r6(inference.candidate_summary(V.psm(s, d)), "best_p", "score"),
    f"""WITH {V.PSM}, {RANKED}, b AS (SELECT aminos, first(protein ORDER BY spectrum_file, scan, r) AS protein, count(*) FILTER (place = 1) AS top_hits, count(*) FILTER (place > 1) AS runners_up, least(coalesce(min(p_value) FILTER (place = 1), 1.0), 1.0) AS p FROM rk GROUP BY 1)
 SELECT aminos, protein, top_hits, runners_up, round(p, 6) AS best_p, round(-ln(greatest(p, 1e-5)) * coalesce(list_sum([1 / i FOR i IN range(1, top_hits + 1)]), 0), 6) AS score FROM b""")
add("s15_peptidome_report", lambda s, d: __import__("orfspark.sources.tables", fromlist=["x"]).peptidome_report(V.psm(s, d)),
    f"WITH {V.PSM} SELECT protein, aminos, count(*) AS spectra, array_to_string(list_sort(list(DISTINCT spectrum_file || ':' || scan)), ',') AS places FROM psm GROUP BY 1, 2")
add("u5_peptide_sets", lambda s, d: V.psm(s, d).where("sample = 'O'").select("aminos").intersect(V.psm(s, d).where("sample = 'F'").select("aminos")), f"WITH {V.PSM} SELECT aminos FROM psm WHERE sample = 'O' INTERSECT SELECT aminos FROM psm WHERE sample = 'F'")

# --- modifications -----------------------------------------------------------------------------------------------

SPECIES = "sp AS (SELECT aminos, charge, is_modified, count(*) AS spectra FROM psm GROUP BY ALL)"


def species(s, d):
    rows = V.psm(s, d).groupBy("aminos", "charge", "is_modified").agg(F.count("*").alias("spectra"))
    return rows.withColumn("prefix", F.lit("K")).withColumn("suffix", F.lit("R"))


add("j6_pair_modless", lambda s, d: ptm.pair_modless(species(s, d)).select("aminos", "charge", "spectra", "modless_spectra"), f"WITH {V.PSM}, {SPECIES} SELECT a.aminos, a.charge, a.spectra, b.spectra AS modless_spectra FROM sp a LEFT JOIN sp b ON a.aminos = b.aminos AND a.charge = b.charge AND NOT b.is_modified WHERE a.is_modified")
add("a16_mod_type_counts", lambda s, d: ptm.mod_type_counts(V.psm(s, d).select((F.col("aminos") % 20).alias("residue"), F.floor(F.col("length")).alias("mass"), F.col("aminos").alias("db_pos"), F.lit(1).alias("spectra"))),
    f"WITH {V.PSM} SELECT aminos % 20 AS residue, CAST(floor(length) AS BIGINT) AS mass, count(*) AS spectra, count(DISTINCT aminos) AS sites FROM psm GROUP BY 1, 2")
add("a17_ptm_sites", lambda s, d: r6(ptm.ptm_sites(V.psm(s, d).select(F.col("aminos").alias("db_pos"), (F.col("charge") % 2).alias("mass"), (F.col("p_value") + 0.5).alias("p"), F.lit(1).alias("spectra"))), "p"),
    f"WITH {V.PSM} SELECT aminos AS db_pos, charge % 2 AS mass, count(*) AS species, count(*) AS spectra, round(exp(sum(ln(p_value + 0.5))), 6) AS p FROM psm GROUP BY 1, 2")
add("a18_ptm_features", lambda s, d: r6(ptm.ptm_features(V.psm(s, d).withColumn("annotation", F.concat_ws("+", "aminos", "sample"))), "best_score", "best_delta", "modded_fraction", "log_spectra"),
    f"""WITH {V.PSM}, o AS (SELECT aminos || '+' || sample AS annotation, charge, aminos, max(mq_score) AS b, max((mq_score, delta)) AS top, count(*) AS spectra, bool_or(is_modified) AS is_modified FROM psm GROUP BY ALL)
 SELECT annotation, charge, aminos, round(b, 6) AS best_score, round(top[2], 6) AS best_delta, spectra, is_modified, round(sum(CASE WHEN is_modified THEN spectra ELSE 0 END) OVER (PARTITION BY aminos) / sum(spectra) OVER (PARTITION BY aminos), 6) AS modded_fraction, round(ln(spectra), 6) AS log_spectra FROM o""")
SITE = "(SELECT aminos % 100 AS site, sum(CAST(is_decoy AS INT)) AS m, count(*) AS n FROM psm WHERE sample = '{}' GROUP BY 1)"


def sites_of(s, d, x):
    return V.psm(s, d).where(F.col("sample") == x).groupBy((F.col("aminos") % 100).alias("site")).agg(F.count_if("is_decoy").alias("modified"), F.count("*").alias("total"))


CHI = "CASE WHEN (am + ad) * (bm + bd) * (am + bm) * (ad + bd) > 0 THEN (am + ad + bm + bd) * (am * bd - ad * bm) * (am * bd - ad * bm) / ((am + ad) * (bm + bd) * (am + bm) * (ad + bd)) END"
TWO = f"two AS (SELECT site, coalesce(a.m, 0)::DOUBLE AS am, (coalesce(a.n, 0) - coalesce(a.m, 0))::DOUBLE AS ad, coalesce(b.m, 0)::DOUBLE AS bm, (coalesce(b.n, 0) - coalesce(b.m, 0))::DOUBLE AS bd FROM {SITE.format('O')} a FULL JOIN {SITE.format('F')} b USING (site))"
add("a21_compare_ptm_rates", lambda s, d: r6(ptm.compare_ptm_rates(sites_of(s, d, "O"), sites_of(s, d, "F")).select("site", "a_mod", "b_mod", "a_rate", "b_rate", F.round("chi2", 4).alias("chi2"), "note"), "a_rate", "b_rate"),
    f"""WITH {V.PSM}, {TWO} SELECT site, am::BIGINT AS a_mod, bm::BIGINT AS b_mod, round(100 * am / greatest(am + ad, 1), 6) AS a_rate, round(100 * bm / greatest(bm + bd, 1), 6) AS b_rate,
 CASE WHEN am + ad > 0 AND bm + bd > 0 THEN round({CHI}, 4) END AS chi2, CASE WHEN am + ad = 0 THEN 'B' WHEN bm + bd = 0 THEN 'A' ELSE '' END AS note FROM two""")
add("a30_ptm_mass", lambda s, d: r6(ptm.ptm_mass(V.psm(s, d).select(F.col("aminos").alias("site"), F.col("mq_score").alias("delta_mass"))), "mean", "sd", "trimmed_mean", "trimmed_sd"),
    f"""WITH {V.PSM}, x AS (SELECT aminos AS site, mq_score - 1.0078 AS m FROM psm), c AS (SELECT site, round(m) AS i, count(*) AS n FROM x GROUP BY 1, 2), o AS (SELECT site, i AS isotope FROM c QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, i) = 1),
 t AS (SELECT site, count(*) AS tn, avg(m) AS tm, stddev_pop(m) AS ts FROM x JOIN o USING (site) WHERE abs(m - isotope) <= 0.5 GROUP BY 1)
 SELECT site, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, any_value(isotope) AS isotope, any_value(tn) AS trimmed_n, round(any_value(tm), 6) AS trimmed_mean, round(any_value(ts), 6) AS trimmed_sd FROM x JOIN o USING (site) LEFT JOIN t USING (site) GROUP BY 1""")
add("j19_merge_species", lambda s, d: ptm.merge_species(*[V.psm(s, d).where(F.col("sample") == x).groupBy(F.col("aminos").alias("annotation"), "charge").agg(F.count("*").alias("spectra"), F.max("mq_score").alias("best_score"), F.max_by("delta", "mq_score").alias("best_delta")) for x in "OF"]).select("annotation", "charge", "spectra", F.round("best_score", 6).alias("best_score")),
    f"WITH {V.PSM} SELECT aminos AS annotation, charge, count(*) AS spectra, round(max(mq_score), 6) AS best_score FROM psm GROUP BY 1, 2")

# --- ranges, features and the genome -----------------------------------------------------------------------------

add("w8_group_by_gap", lambda s, d: ranges.group_by_gap(V.features(s, d), ["strand"], "start", "stop", 200, ["event_id"]).groupBy("strand", "group_no").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop")),
    f"""WITH {V.FEATURES}, m AS (SELECT *, max(stop) OVER (PARTITION BY strand ORDER BY start, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM features),
 g AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY strand ORDER BY start, stop, event_id) AS no FROM m) SELECT strand, CAST(no AS BIGINT) AS group_no, count(*) AS n, min(start) AS start, max(stop) AS stop FROM g GROUP BY 1, 2""")
add("w3_peptide_gaps", lambda s, d: inference.peptide_gaps(V.features(s, d).withColumn("aminos", F.col("event_id"))).select("event_id", "gap"), f"WITH {V.FEATURES} SELECT event_id, CASE WHEN lag(stop) OVER w IS NULL THEN 0 ELSE greatest(start - lag(stop) OVER w, 0) END AS gap FROM features WINDOW w AS (PARTITION BY orf_name ORDER BY start, stop, event_id)")


def located(s, d):
    f = V.features(s, d)
    return f.select("orf_name", F.col("event_id").alias("aminos"), "start", "stop", F.when(F.col("orf_name") % 2 == 0, "-").otherwise("+").alias("strand"))


LOCATED = "loc AS (SELECT orf_name, event_id AS aminos, start, stop, CASE WHEN orf_name % 2 = 0 THEN '-' ELSE '+' END AS strand FROM features)"
ALONG = "CASE WHEN strand = '-' THEN -stop ELSE start END, CASE WHEN strand = '-' THEN -start ELSE stop END, aminos"
add("w4_drop_isolated", lambda s, d: genome.drop_isolated(located(s, d), 5000).select("orf_name", "aminos"),
    f"WITH {V.FEATURES}, {LOCATED}, n AS (SELECT *, abs(start - lag(stop) OVER w) AS b, abs(lead(start) OVER w - stop) AS a FROM loc WINDOW w AS (PARTITION BY orf_name ORDER BY {ALONG})) SELECT orf_name, aminos FROM n WHERE NOT (coalesce(b > 5000, true) AND coalesce(a > 5000, true))")
add("w5_first_peptide", lambda s, d: genome.first_peptide(located(s, d)), f"WITH {V.FEATURES}, {LOCATED} SELECT orf_name, aminos, start, stop, strand FROM loc QUALIFY row_number() OVER (PARTITION BY orf_name ORDER BY {ALONG}) = 1")
ORFS = "orfs AS (SELECT strand AS chrom, event_id AS orf_name, start, stop, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS spectra, event_id % 2 = 0 AS named, start AS seen_start, start + (stop - start) // 2 AS seen_stop FROM features)"


def orfs(s, d):
    f = V.features(s, d)
    return f.select(F.col("strand").alias("chrom"), F.col("event_id").alias("orf_name"), "start", "stop", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 5).alias("spectra"), (F.col("event_id") % 2 == 0).alias("named"), F.col("start").alias("seen_start"), (F.col("start") + F.floor((F.col("stop") - F.col("start")) / 2)).alias("seen_stop"))


PAIRS = "pr AS (SELECT a.chrom, a.orf_name AS a, b.orf_name AS b, least(a.stop, b.stop) - greatest(a.start, b.start) AS bp, a.spectra AS a_n, b.spectra AS b_n, a.named AS an, b.named AS bn, greatest(a.start, b.start) AS lo, least(a.stop, b.stop) AS hi, a.seen_start AS s1, a.seen_stop AS e1, b.seen_start AS s2, b.seen_stop AS e2 FROM orfs a JOIN orfs b ON a.chrom = b.chrom AND a.start <= b.stop AND b.start <= a.stop AND a.orf_name < b.orf_name WHERE a.spectra > 0 OR b.spectra > 0)"
add("j3_overlaps", lambda s, d: genome.overlaps(orfs(s, d)).select("chrom", "a", "b", "bp"), f"WITH {V.FEATURES}, {ORFS}, {PAIRS} SELECT chrom, a, b, bp FROM pr")
add("p2_conflicts", lambda s, d: genome.conflicts(orfs(s, d)),
    f"WITH {V.FEATURES}, {ORFS}, {PAIRS} SELECT chrom, a, b, bp, CASE WHEN bp < 10 THEN 1 WHEN bp < 40 THEN 2 WHEN a_n = 0 OR b_n = 0 THEN CASE WHEN (CASE WHEN a_n > 0 THEN bn ELSE an END) THEN 4 ELSE 3 END WHEN s1 <= hi AND e1 >= lo AND s2 <= hi AND e2 >= lo THEN 6 ELSE 5 END AS level FROM pr")
add("p2_free_pairs", lambda s, d: genome.free_pairs(orfs(s, d), genome.overlaps(orfs(s, d))), f"WITH {V.FEATURES}, {ORFS}, {PAIRS}, n AS (SELECT chrom, count(*) AS n, count(*) FILTER (spectra = 0) AS u FROM orfs GROUP BY 1), h AS (SELECT chrom, count(*) AS h FROM pr GROUP BY 1) SELECT chrom, CAST(n * (n - 1) // 2 - u * (u - 1) // 2 - coalesce(h, 0) AS BIGINT) AS pairs FROM n LEFT JOIN h USING (chrom)")
GENES = "genes AS (SELECT strand, orf_name AS gene, start - 50 AS g_start, stop + 50 AS g_stop FROM features)"


def genes(s, d):
    return V.features(s, d).select("strand", F.col("orf_name").alias("gene"), (F.col("start") - 50).alias("g_start"), (F.col("stop") + 50).alias("g_stop"))


add("j10_contained_in", lambda s, d: ranges.contained_in(V.features(s, d).select("strand", "event_id", "start", "stop"), genes(s, d), ["strand"], ("start", "stop"), ("g_start", "g_stop"), 10).select("event_id", "gene", "g_start"),
    f"WITH {V.FEATURES}, {GENES} SELECT event_id, gene, g_start FROM features f JOIN genes g ON f.strand = g.strand AND f.start >= g_start - 10 AND f.stop <= g_stop + 10 AND f.start <= f.stop")
add("a11_coverage_runs", lambda s, d: ranges.coverage_of(V.features(s, d), ["strand"], "start", "stop"),
    f"WITH {V.FEATURES}, e AS (SELECT strand, start AS a, 1 AS x FROM features UNION ALL SELECT strand, stop + 1, -1 FROM features), t AS (SELECT strand, a, sum(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT strand, a AS start, lead(a) OVER w - 1 AS stop, CAST(sum(x) OVER w AS BIGINT) AS n FROM t WINDOW w AS (PARTITION BY strand ORDER BY a)) SELECT * FROM c WHERE n > 0")
add("u4_split_disjoint", lambda s, d: ranges.split_disjoint(V.features(s, d), ["strand"], "start", "stop").select("strand", "start", "stop", "n"),
    f"WITH {V.FEATURES}, p AS (SELECT DISTINCT strand, start AS a FROM features UNION SELECT strand, stop + 1 FROM features), c AS (SELECT strand, a AS start, lead(a) OVER (PARTITION BY strand ORDER BY a) - 1 AS stop FROM p) SELECT c.strand, c.start, c.stop, count(*) AS n FROM c JOIN features f ON f.strand = c.strand AND f.start <= c.start AND f.stop >= c.stop WHERE c.stop IS NOT NULL GROUP BY 1, 2, 3")
add("w9_runs_above", lambda s, d: ranges.runs_above(V.features(s, d).groupBy("strand", F.floor(F.col("start") / 3600).alias("pos")).agg(F.count("*").alias("n")), ["strand"], "pos", "n", 1),
    f"WITH {V.FEATURES}, c AS (SELECT strand, start // 3600 AS pos, count(*) AS n FROM features GROUP BY 1, 2), i AS (SELECT *, pos - row_number() OVER (PARTITION BY strand ORDER BY pos) AS i FROM c WHERE n > 1) SELECT strand, min(pos) AS start, max(pos) AS stop, max(n) AS top FROM i GROUP BY strand, i")
add("a25_histogram", lambda s, d: r6(ranges.histogram(V.psm(s, d), "mq_score", 0.5, ["charge"]), "share"),
    f"""WITH {V.PSM}, c AS (SELECT charge, CAST(floor(mq_score / 0.5) AS BIGINT) AS bin, count(*) AS n FROM psm GROUP BY 1, 2), s AS (SELECT charge, unnest(range(min(bin), max(bin) + 1)) AS bin FROM c GROUP BY 1), f AS (SELECT s.charge, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.charge = s.charge AND c.bin = s.bin)
 SELECT charge, bin, n, CAST(sum(n) OVER (PARTITION BY charge ORDER BY bin) AS BIGINT) AS cum, round(sum(n) OVER (PARTITION BY charge ORDER BY bin) / sum(n) OVER (PARTITION BY charge), 6) AS share FROM f""")
EXONS = "ex AS (SELECT user_id AS gene_id, event_type AS transcript_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 60 AS stop FROM events)"


def exons(s, d):
    return V.table(s, d, "events").select(F.col("user_id").alias("gene_id"), F.col("event_type").alias("transcript_id"), F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 60).alias("stop"))


INTRONS = "intr AS (SELECT gene_id, transcript_id, stop + 1 AS start, s - 1 AS stop, s - stop - 1 AS length FROM (SELECT *, lead(start) OVER (PARTITION BY gene_id, transcript_id ORDER BY start, stop) AS s FROM ex) WHERE s > stop + 1)"
add("a42_introns", lambda s, d: splice.introns(exons(s, d)), f"WITH {EXONS}, {INTRONS} SELECT * FROM intr")
add("a42_intron_lengths", lambda s, d: splice.intron_lengths(exons(s, d), 100_000).groupBy(F.floor(F.col("bin") / 10).alias("decade")).agg(F.sum("n").alias("n")), f"WITH {EXONS}, {INTRONS}, c AS (SELECT length // 100000 AS bin FROM intr), f AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM c) SELECT bin // 10 AS decade, CAST(sum(n) AS BIGINT) AS n FROM (SELECT f.bin, count(c.bin) AS n FROM f LEFT JOIN c USING (bin) GROUP BY 1) GROUP BY 1")
add("u3_drop_redundant_transcripts", lambda s, d: splice.drop_redundant_transcripts(exons(s, d)).select("gene_id", "transcript_id"), f"WITH {EXONS}, c AS (SELECT gene_id, transcript_id, list_sort(list((start, stop))) AS ch FROM ex GROUP BY 1, 2) SELECT gene_id, min(transcript_id) AS transcript_id FROM c GROUP BY gene_id, ch")
add("g6_junctions", lambda s, d: splice.junctions_of(exons(s, d).select(F.col("gene_id").alias("alignment"), F.col("transcript_id").alias("chrom"), F.lit("+").alias("strand"), F.expr("start div 86400").alias("start"), F.expr("start div 86400").alias("stop"))),
    f"WITH {EXONS}, a AS (SELECT gene_id AS al, transcript_id AS chrom, start // 86400 AS start, start // 86400 AS stop FROM ex), j AS (SELECT chrom, stop AS donor, lead(start) OVER (PARTITION BY al, chrom ORDER BY start, stop) AS acceptor FROM a) SELECT chrom, '+' AS strand, donor, acceptor, count(*) AS n FROM j WHERE acceptor > donor GROUP BY ALL")

# --- sequences ---------------------------------------------------------------------------------------------------

SEQ = f"WITH {V.SEQUENCES}"
add("x4_peptide_mass", lambda s, d: V.sequences(s, d).select("seq_id", F.round(X.peptide_mass(F.col("seq")), 3).alias("mass")),
    f"{SEQ} SELECT seq_id, round({' + '.join(f'{m} * (length(seq) - length(replace(seq, {chr(39)}{c}{chr(39)}, {chr(39)}{chr(39)})))' for c, m in X.RESIDUE_MASS.items())}, 3) AS mass FROM sequences")
add("x5_canonical_il", lambda s, d: V.sequences(s, d).select("seq_id", F.md5(X.canonical_il(F.col("seq"))).alias("digest")), f"{SEQ} SELECT seq_id, md5(translate(seq, 'IQ', 'LK')) AS digest FROM sequences")
add("x9_reverse_complement", lambda s, d: V.contigs(s, d).select("chrom", F.md5(X.reverse_complement(F.col("seq"))).alias("digest")), f"WITH {V.CONTIGS} SELECT chrom, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM contigs")
CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(X.CODONS, X.CODE, strict=True)) + "}"
add("x9_translate_dna", lambda s, d: V.contigs(s, d).select("chrom", F.md5(X.translate_dna(F.col("seq"))).alias("digest")), f"WITH {V.CONTIGS} SELECT chrom, md5(list_aggregate(list_concat([''], [{CODON_MAP}[seq[3 * i + 1:3 * i + 3]] FOR i IN range(length(seq) // 3)]), 'string_agg', '')) AS digest FROM contigs")
add("x10_gc_percent", lambda s, d: V.contigs(s, d).select("chrom", X.gc_percent(F.col("seq")).alias("gc")), f"WITH {V.CONTIGS} SELECT chrom, CASE WHEN length(seq) > 0 THEN CAST(floor(100 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq)) AS BIGINT) END AS gc FROM contigs")
add("x10_codon_usage", lambda s, d: genome.codon_usage(V.contigs(s, d)), f"WITH {V.CONTIGS}, c AS (SELECT chrom, seq, unnest(range(length(seq) // 3)) AS i FROM contigs) SELECT chrom, seq[3 * i + 1:3 * i + 3] AS codon, count(*) AS n FROM c GROUP BY 1, 2")
add("x13_sequence_entropy", lambda s, d: V.sequences(s, d).where("seq <> ''").select("seq_id", F.round(X.sequence_entropy(F.col("seq")), 6).alias("entropy")), f"{SEQ}, c AS (SELECT seq_id, unnest(string_split(seq, '')) AS a FROM sequences WHERE seq <> ''), n AS (SELECT seq_id, a, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT seq_id, n / sum(n) OVER (PARTITION BY seq_id) AS p FROM n) SELECT seq_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
add("x14_mean_hydropathy", lambda s, d: V.sequences(s, d).where("seq <> ''").select("seq_id", F.round(X.mean_hydropathy(F.col("seq")), 6).alias("hydropathy")),
    f"{SEQ} SELECT seq_id, round(({' + '.join(f'({m}) * (length(seq) - length(replace(seq, {chr(39)}{c}{chr(39)}, {chr(39)}{chr(39)})))' for c, m in X.HYDROPATHY.items())}) / length(seq), 6) AS hydropathy FROM sequences WHERE seq <> ''")
add("x12_signal_motif", lambda s, d: V.sequences(s, d).select("seq_id", X.signal_motif(F.col("seq")).alias("motif"), X.has_basic(F.col("seq"), 0, 10).alias("basic")), f"{SEQ} SELECT seq_id, regexp_matches(seq, '[ILVAGS].[AGS]$') AS motif, regexp_matches(substring(seq, 1, 10), '[KR]') AS basic FROM sequences")
add("g3_reverse_decoys", lambda s, d: genome.decoys(V.sequences(s, d).withColumn("name", F.col("seq_id").cast("string")), "reverse").select("seq_id", "name", F.md5("seq").alias("digest")), f"{SEQ} SELECT seq_id, 'XXX.' || seq_id AS name, md5(reverse(seq)) AS digest FROM sequences")
SIX_FRAMES = f"""WITH {V.CONTIGS}, b AS (SELECT chrom, length(seq) AS n, '+' AS strand, seq AS dna FROM contigs UNION ALL SELECT chrom, length(seq), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs),
 f AS (SELECT chrom, n, strand, frame, dna[frame:] AS x FROM b, (VALUES (1), (2), (3)) t(frame)),
 p AS (SELECT chrom, n, strand, frame, string_split(list_aggregate(list_concat([''], [{CODON_MAP}[x[3 * i + 1:3 * i + 3]] FOR i IN range(length(x) // 3)]), 'string_agg', ''), '*') AS parts FROM f),
 r AS (SELECT chrom, n, strand, frame, unnest(parts) AS seq, unnest(range(len(parts))) AS i FROM p),
 o AS (SELECT *, coalesce(sum(length(seq) + 1) OVER (PARTITION BY chrom, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k0 FROM r)
 SELECT chrom, strand, frame, CAST(CASE WHEN strand = '+' THEN frame + 3 * k0 ELSE n - (frame + 3 * k0) + 1 END AS BIGINT) AS start_nuc, length(seq) AS length, md5(seq) AS digest FROM o WHERE length(seq) >= 20"""
add("g1_six_frame", lambda s, d: genome.six_frame(V.contigs(s, d), 20).select("chrom", "strand", "frame", "start_nuc", "length", F.md5("seq").alias("digest")), SIX_FRAMES)


def letters_of(s, d, name, key_):
    return V.table(s, d, name).select(F.col(key_).alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


def probes(s, d):
    """Peptides: the tryptic pieces of the benchmark's whole texts."""
    return genome.digest(letters_of(s, d, "benchmark", "item_id"), 0, 6, 40).select("aminos").distinct()


PROBES = "pb AS (SELECT DISTINCT a AS aminos FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(t, '([KR])([^P])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g'), '|')) AS a FROM (SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM benchmark)) WHERE length(a) BETWEEN 6 AND 40)"
add("j1_map_peptides", lambda s, d: ranges.map_peptides(probes(s, d), V.sequences(s, d)).select("aminos", "seq_id", "pos", "n_places", "is_unique"),
    f"{SEQ}, {PROBES}, k AS (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS pos FROM sequences), m AS (SELECT aminos, seq_id, CAST(pos AS INT) AS pos FROM k JOIN pb ON seq[pos:pos + 5] = aminos[1:6] WHERE seq[pos:pos + length(aminos) - 1] = aminos) SELECT aminos, seq_id, pos, count(*) OVER (PARTITION BY aminos) AS n_places, count(*) OVER (PARTITION BY aminos) = 1 AS is_unique FROM m")
add("j4_novel_peptides", lambda s, d: genome.novel_peptides(probes(s, d), V.sequences(s, d)), f"{SEQ}, {PROBES} SELECT aminos FROM pb WHERE NOT EXISTS (SELECT 1 FROM sequences WHERE contains(seq, aminos))")
add("g4_digest", lambda s, d: genome.digest(V.sequences(s, d), 0, 6, 40).groupBy("seq_id").agg(F.count("*").alias("peptides"), F.sum(F.length("aminos")).alias("residues")),
    f"{SEQ}, p AS (SELECT seq_id, unnest(string_split(regexp_replace(seq, '([KR])([^P])', '\\1|\\2', 'g'), '|')) AS a FROM (SELECT seq_id, regexp_replace(seq, '([KR])([^P])', '\\1|\\2', 'g') AS seq FROM sequences)) SELECT seq_id, count(*) AS peptides, CAST(sum(length(a)) AS BIGINT) AS residues FROM p WHERE length(a) BETWEEN 6 AND 40 GROUP BY 1")

# --- spectra -----------------------------------------------------------------------------------------------------

PK = f"WITH {V.PEAKS}"
add("w7_rank_peaks", lambda s, d: spectra.rank_peaks(V.peaks(s, d)).select("spectrum", "mz", "intensity_rank"), f"{PK} SELECT spectrum, mz, row_number() OVER (PARTITION BY spectrum ORDER BY intensity DESC, mz) AS intensity_rank FROM peaks")
add("w6_window_filter", lambda s, d: spectra.window_filter(V.peaks(s, d), 10, 3).select("spectrum", "mz"), f"{PK} SELECT a.spectrum, a.mz FROM peaks a JOIN peaks b ON a.spectrum = b.spectrum AND abs(a.mz - b.mz) <= 5 GROUP BY a.spectrum, a.mz, a.intensity HAVING count(*) FILTER (b.intensity > a.intensity OR (b.intensity = a.intensity AND b.mz < a.mz)) < 3")
add("f12_spectrum_quality", lambda s, d: r6(spectra.spectrum_quality(V.peaks(s, d)), "signal_to_noise"), f"{PK} SELECT spectrum, count(*) AS peaks, round(list_sort(list(intensity), 'DESC')[CAST(ceil(least(count(*), 5) / 2) AS INT)] / list_sort(list(intensity))[count(*) // 2 + 1], 6) AS signal_to_noise, count(*) > 10 AS good FROM peaks GROUP BY 1")
add("o5_most_intense", lambda s, d: r6(spectra.most_intense(V.peaks(s, d)), "total"), f"{PK}, t AS (SELECT spectrum, charge, sum(intensity) AS total FROM peaks GROUP BY 1, 2) SELECT spectrum, charge, round(total, 6) AS total FROM t QUALIFY percent_rank() OVER (PARTITION BY charge ORDER BY total DESC, spectrum) < 0.5")
SIM = "s AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings))"


def neighbours(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return e.join(e.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")


add("p11_similarity", lambda s, d: r6(spectra.similarity(V.peaks(s, d), neighbours(s, d), width=4.0), "score"),
    f"{PK}, {SIM}, v AS (SELECT spectrum, CAST(floor(mz / 4) AS BIGINT) AS bin, sum(intensity) AS v FROM peaks GROUP BY 1, 2), n AS (SELECT spectrum, sqrt(sum(v * v)) AS n FROM v GROUP BY 1) SELECT a, b, round(sum(x.v * y.v) / any_value(p.n * q.n), 6) AS score FROM s JOIN v x ON x.spectrum = a JOIN v y ON y.spectrum = b AND y.bin = x.bin JOIN n p ON p.spectrum = a JOIN n q ON q.spectrum = b GROUP BY a, b")
add("j8_nearest_peak", lambda s, d: r6(ranges.nearest_peak(V.table(s, d, "embeddings").select(F.col("vec_id").alias("spectrum"), F.explode(F.array(F.lit(10.4), F.lit(20.6), F.lit(99.0))).alias("target")), V.peaks(s, d), ["spectrum"], "target", "mz", "intensity", 0.5), "intensity"),
    f"{PK}, t AS (SELECT vec_id AS spectrum, unnest([10.4::DOUBLE, 20.6::DOUBLE, 99.0::DOUBLE]) AS target FROM embeddings) SELECT t.spectrum, target, round(coalesce(arg_min(intensity, abs(mz - target)), 0.0), 6) AS intensity FROM t LEFT JOIN peaks p ON p.spectrum = t.spectrum AND abs(mz - target) <= 0.5 GROUP BY 1, 2")
add("a27_consensus_bins", lambda s, d: r6(spectra.consensus_bins(V.peaks(s, d).withColumn("key", F.col("charge")), 2.0), "intensity").select("key", "bin", "intensity", "spectra", "near"),
    f"{PK}, x AS (SELECT charge AS key, spectrum, mz, intensity / sum(intensity) OVER (PARTITION BY charge, spectrum) AS v FROM peaks) SELECT o.key, o.bin, round(v, 6) AS intensity, spectra, CAST(sum(q.n) AS BIGINT) AS near FROM (SELECT key, CAST(round(mz / 2.0) AS BIGINT) AS bin, sum(v) AS v, count(DISTINCT spectrum) AS spectra FROM x GROUP BY 1, 2) o JOIN (SELECT key, CAST(round(mz / 2.0) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1, 2) q ON q.key = o.key AND q.bin BETWEEN o.bin - 2 AND o.bin + 2 GROUP BY 1, 2, 3, 4")
# bins in order of intensity; one not yet absorbed absorbs those within two bins that are left
ABSORBED = f"""WITH RECURSIVE {V.PEAKS}, x AS (SELECT charge AS key, spectrum, CAST(round(mz) AS BIGINT) AS bin, intensity / sum(intensity) OVER (PARTITION BY charge, spectrum) AS v FROM peaks),
 o AS (SELECT key, bin, sum(v) AS v, count(DISTINCT spectrum) AS spectra, count(*) AS peaks FROM x GROUP BY 1, 2), q AS (SELECT o.key, o.bin, o.v, o.spectra, CAST(sum(m.peaks) AS BIGINT) AS near FROM o JOIN o m ON m.key = o.key AND abs(m.bin - o.bin) <= 2 GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v DESC, bin) AS r FROM q), l AS (SELECT key, list(bin) AS bins FROM b GROUP BY 1),
 st(key, r, used, bin, own) AS (SELECT key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] FROM l
  UNION ALL SELECT st.key, b.r, list_concat(used, a.own), b.bin, a.own FROM st JOIN l ON l.key = st.key JOIN b ON b.key = st.key AND b.r = st.r + 1,
   LATERAL (SELECT CASE WHEN list_contains(st.used, b.bin) THEN [] ELSE [y FOR y IN range(b.bin - 2, b.bin + 3) IF list_contains(l.bins, y) AND NOT list_contains(st.used, y)] END AS own) a),
 c AS (SELECT st.key, st.bin, sum(b.v) AS v, max(b.spectra) AS spectra, any_value(m.near) AS near FROM st JOIN b ON b.key = st.key AND list_contains(st.own, b.bin) JOIN b m ON m.key = st.key AND m.bin = st.bin GROUP BY 1, 2)"""
add("a27_consensus", lambda s, d: r6(spectra.consensus(spectra.consensus_bins(V.peaks(s, d).withColumn("key", F.col("charge")), 1.0), 2, 1.0), "intensity"),
    f"{ABSORBED} SELECT key, CAST(bin AS DOUBLE) AS mz, round(v, 6) AS intensity, spectra FROM c")

# --- models ------------------------------------------------------------------------------------------------------

FEATS = ["mq_score", "delta", "length"]


def labelled(s, d):
    return V.psm(s, d).withColumn("label", (~F.col("is_decoy")).cast("int"))


add("a26_roc_auc", lambda s, d: r6(ml.roc_auc(labelled(s, d), "mq_score"), "auc"), f"WITH {V.PSM}, g AS (SELECT mq_score AS s, count(*) FILTER (NOT is_decoy) AS p, count(*) FILTER (is_decoy) AS n FROM psm GROUP BY 1), r AS (SELECT p, n, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM g) SELECT round(sum(n * (a + p / 2)) / (sum(p) * sum(n)), 6) AS auc FROM r")
add("a26_sensitivity", lambda s, d: r6(ml.sensitivity_at_fdr(labelled(s, d).withColumn("label", F.when(F.col("p_value") > 0.07, 0).otherwise(1)), "mq_score"), "sensitivity"),
    f"""WITH {V.PSM}, g AS (SELECT mq_score AS s, count(*) FILTER (p_value <= 0.07) AS p, count(*) FILTER (p_value > 0.07) AS n FROM psm GROUP BY 1), r AS (SELECT sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS a FROM g WINDOW w AS (ORDER BY s DESC))
 SELECT l AS fdr, round(coalesce(max(tp / a) FILTER (fp / (tp + fp) <= l), 0.0), 6) AS sensitivity FROM r, (SELECT unnest([0.01::DOUBLE, 0.03::DOUBLE, 0.05::DOUBLE, 0.07::DOUBLE, 0.10::DOUBLE]) AS l) GROUP BY 1""")
add("a31_mutual_information", lambda s, d: r6(ml.mutual_information(V.psm(s, d).select("charge", "sample", "is_decoy"), ["charge", "sample", "is_decoy"]), "h_a", "h_b", "mi", "su"),
    f"""WITH {V.PSM}, v AS (SELECT CAST(charge AS VARCHAR) AS charge, sample, CAST(is_decoy AS VARCHAR) AS is_decoy FROM psm), j AS (SELECT 'charge' AS a, 'sample' AS b, charge AS x, sample AS y FROM v UNION ALL SELECT 'charge', 'is_decoy', charge, is_decoy FROM v UNION ALL SELECT 'sample', 'is_decoy', sample, is_decoy FROM v),
 c AS (SELECT a, b, x, y, count(*)::DOUBLE AS n FROM j GROUP BY ALL), p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a, b) AS p, sum(n) OVER (PARTITION BY a, b, x) / sum(n) OVER (PARTITION BY a, b) AS px, sum(n) OVER (PARTITION BY a, b, y) / sum(n) OVER (PARTITION BY a, b) AS py FROM c),
 r AS (SELECT a, b, -sum(p * ln(px)) AS h_a, -sum(p * ln(py)) AS h_b, sum(p * ln(p / (px * py))) AS mi FROM p GROUP BY 1, 2) SELECT a, b, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(mi, 6) AS mi, round(2 * mi / (h_a + h_b), 6) AS su FROM r""")
add("m1_scale_features", lambda s, d: r6(ml.scale_features(labelled(s, d).select(*key, *FEATS), FEATS), *FEATS),
    f"""WITH {V.PSM}, c AS (SELECT count(*) AS n FROM psm), q AS (SELECT {', '.join(f"list_sort(list({c}))[least(CAST(floor(n * 0.025 + 0.5) AS BIGINT), n - 1) + 1] AS lo_{c}, list_sort(list({c}))[least(CAST(floor(n * 0.975 + 0.5) AS BIGINT), n - 1) + 1] AS hi_{c}" for c in FEATS)} FROM psm, c GROUP BY n)
 SELECT {KEY}, {', '.join(f'round(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 2) - 1 ELSE 0 END, 6) AS {c}' for c in FEATS)} FROM psm, q""")
PRIOR = "WITH {0}, n AS (SELECT count(*) FILTER (is_decoy) AS f, count(*) FILTER (NOT is_decoy) AS t FROM psm) SELECT r AS ratio, round(CASE WHEN f * r >= t THEN 0.99 ELSE (f + f * r) / (f + t) END, 6) AS prior FROM n, (VALUES (0.25), (1.0), (5.0)) v(r)"
add("m1_prior_false", lambda s, d: s.createDataFrame([(r, round(ml.prior_false(labelled(s, d), r), 6)) for r in (0.25, 1.0, 5.0)], "ratio double, prior double"), PRIOR.format(V.PSM).replace("r AS ratio", "CAST(r AS DOUBLE) AS ratio"))


def m2(s, d):
    w, k = ml.fit_lda(labelled(s, d), FEATS)
    return ml.apply_linear(labelled(s, d), FEATS, w, k).select(*key, F.round("score", 5).alias("score"))


add("m2_lda", m2,  # the pooled covariance of three features inverted by cofactors
    f"""WITH {V.PSM}, f AS (SELECT {KEY}, NOT is_decoy AS t, mq_score AS a, delta AS b, length AS c FROM psm),
 g AS (SELECT t, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c, {', '.join(f"covar_pop({x}, {y}) AS {x}{y}" for x, y in ("aa", "ab", "ac", "bb", "bc", "cc"))} FROM f GROUP BY 1),
 p AS (SELECT {', '.join(f"sum({x} * n) / sum(n) AS {x}" for x in ("aa", "ab", "ac", "bb", "bc", "cc"))} FROM g),
 i AS (SELECT (bb * cc - bc * bc) / e AS aa, (ac * bc - ab * cc) / e AS ab, (ab * bc - ac * bb) / e AS ac, (aa * cc - ac * ac) / e AS bb, (ab * ac - aa * bc) / e AS bc, (aa * bb - ab * ab) / e AS cc
  FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS e FROM p)),
 s AS (SELECT t, i.aa * a + i.ab * b + i.ac * c AS u, i.ab * a + i.bb * b + i.bc * c AS v, i.ac * a + i.bc * b + i.cc * c AS w, a, b, c FROM g, i),
 w AS (SELECT y.u - z.u AS u, y.v - z.v AS v, y.w - z.w AS w, -(y.u * y.a + y.v * y.b + y.w * y.c - z.u * z.a - z.v * z.b - z.w * z.c) / 2 AS k FROM s y, s z WHERE y.t AND NOT z.t)
 SELECT {KEY}, round(f.a * u + f.b * v + f.c * w.w + k, 5) + 0.0 AS score FROM f, w""")
add("m3_logit", lambda s, d: ml.predict_logit(ml.fit_logit(labelled(s, d), FEATS, 20), labelled(s, d), FEATS).select(*key, F.round("score", 4).alias("score")))
add("m5_score_to_p", lambda s, d: r6(ml.score_to_p(labelled(s, d).withColumn("score", F.col("mq_score"))), "p"),
    f"WITH {V.PSM}, h AS (SELECT CAST(floor(mq_score / 0.1) AS BIGINT) AS bin, count(*) FILTER (is_decoy) AS f, count(*) AS n FROM psm GROUP BY 1), e AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM h) SELECT e.bin, round(sum(coalesce(f, 0)) OVER w / greatest(sum(coalesce(n, 0)) OVER w, 1), 6) AS p FROM e LEFT JOIN h USING (bin) WINDOW w AS (ORDER BY e.bin DESC)")
add("m7_feature_stats", lambda s, d: r6(ml.feature_stats(labelled(s, d), FEATS), "mean", "sd", "low", "high"),
    f"WITH {V.PSM}, l AS (SELECT CAST(NOT is_decoy AS INT) AS label, unnest([{', '.join(f'{chr(39)}{c}{chr(39)}' for c in FEATS)}]) AS feature, unnest([mq_score, delta, length]) AS x FROM psm) SELECT feature, label, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high FROM l GROUP BY 1, 2")

from . import catalog_more, catalog_rest, catalog_sources  # noqa: E402,F401  the rest of the registrations
