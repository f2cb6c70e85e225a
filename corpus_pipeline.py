"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Every stage works on all rows that its predecessor kept, stored between stages.
All but the last return the columns of documents; further columns are dropped. A
null or empty text is not toxic, links with other empty texts, has no words to
remove and packs as the end id alone. Rows without doc_id stay in every stage.
Of a group of near copies the row with the least doc_id stays (of several rows
with that doc_id the one with the least hash of its text, once). An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfspark.llm import decontaminate, packing, simhash, substrings, toxicity
from orfspark.llm.common import read_table, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose predicted class is 0, by a model fitted on this stage's own labelled documents."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_first(docs).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without removed words keep their text as it is; the others become their kept words."""
    found = substrings.dedup(docs).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words stand in benchmark windows."""
    return decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per power-of-two piece, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The toxicity stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
