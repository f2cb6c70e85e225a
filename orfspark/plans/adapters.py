"""Views of the driver's tables as evidence tables, in Spark and in SQL.

Each view exists twice, with the same columns: a function (spark, sf_dir) and a
SQL common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psm_of(table(spark, sf_dir, "lineitem"))


def psm_of(li: DataFrame, rank: Column | None = None) -> DataFrame:
    """Rows of lineitem as hits; rank: theirs where it is known."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_suppkey", "l_orderkey").orderBy(*order)
    price = F.col("l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("spectrum_file"), F.col("l_orderkey").alias("scan"), (F.row_number().over(w) if rank is None else rank).alias("rank"), F.col("l_partkey").alias("aminos"),
        (1 + F.col("l_partkey") % 3).alias("charge"), (price / 10000).alias("mq_score"), F.col("l_discount").alias("delta"), (F.col("l_returnflag") == "R").alias("is_decoy"),
        F.col("l_tax").alias("p_value"), F.col("l_suppkey").alias("protein"), F.col("l_quantity").alias("length"), (F.col("l_linestatus") == "O").alias("is_modified"),
        F.col("l_quantity").cast("long").alias("db_pos"), F.when(F.col("l_linenumber") > 3, F.col("l_tax") / 2).alias("lfdr"), F.col("l_linestatus").alias("sample"), F.col("l_shipdate").alias("seen_at"),
    )


def ranked(li: DataFrame) -> DataFrame:
    """The rows of `psm_of`, with several: whether others of their spectrum may be among them. Only rows of spectra that have several are put in order, if those spectra are few enough to be
    broadcast: others have rank 1 and leave no task. Hashes are counted, each as it is; two spectra with one hash are
    put in order as well."""
    hashed = li.withColumn("_h", F.xxhash64("l_suppkey", "l_orderkey"))
    several = ranges.stored(hashed.select("_h").repartition("_h").groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    if several.count() > 1_000_000:
        return psm_of(li).withColumn("several", F.lit(True))
    alone, others = (hashed.join(F.broadcast(several), "_h", how) for how in ("left_anti", "left_semi"))
    return psm_of(alone, F.lit(1)).withColumn("several", F.lit(False)).unionByName(psm_of(others).withColumn("several", F.lit(True)))


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `psm` with rank 1."""
    return ranked(table(spark, sf_dir, "lineitem")).where("rank = 1").drop("several")


PSM = """psm AS (SELECT l_suppkey AS spectrum_file, l_orderkey AS scan,
 row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rank,
 l_partkey AS aminos, 1 + l_partkey % 3 AS charge, l_extendedprice / 10000 AS mq_score, l_discount AS delta, l_returnflag = 'R' AS is_decoy, l_tax AS p_value,
 l_suppkey AS protein, l_quantity AS length, l_linestatus = 'O' AS is_modified, CAST(l_quantity AS BIGINT) AS db_pos,
 CASE WHEN l_linenumber > 3 THEN l_tax / 2 END AS lfdr, l_linestatus AS sample, l_shipdate AS seen_at FROM lineitem)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of whole documents as residues."""
    docs = table(spark, sf_dir, "documents")
    # letters one by one: Java looks single signs up in a table, and tries ranges in turn
    return docs.select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", f"[^{ALPHABET}{ALPHABET.lower()}]+", "")).alias("seq"))


SEQUENCES = "sequences AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"

ALPHABET, ON_BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select(F.col("seq_id").alias("chrom"), F.translate("seq", ALPHABET, ON_BASES).alias("seq"))


CONTIGS = f"contigs AS (SELECT doc_id AS chrom, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{ON_BASES}') AS seq FROM documents)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as strand features: orf, start, stop."""
    ev = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts").cast("long")
    return ev.select("event_id", F.col("event_type").alias("strand"), F.col("user_id").alias("orf_name"), start.alias("start"), (start + F.floor(F.abs("value")).cast("long")).alias("stop"), "value", "ts")


FEATURES = "features AS (SELECT event_id, event_type AS strand, user_id AS orf_name, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value)) AS BIGINT) AS stop, value, ts FROM events)"


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id").alias("spectrum"), F.col("label").alias("charge"), F.posexplode("embedding").alias("mz", "x")).select("spectrum", "charge", F.col("mz").cast("double").alias("mz"), F.abs(F.col("x").cast("double")).alias("intensity"))


PEAKS = "peaks AS (SELECT vec_id AS spectrum, label AS charge, CAST(i AS DOUBLE) AS mz, abs(CAST(embedding[i + 1] AS DOUBLE)) AS intensity FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"


def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("sample")).agg(F.sum("o_totalprice").alias("value"))


QUANT = "quant AS (SELECT o_custkey AS gene, o_orderpriority AS sample, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"
